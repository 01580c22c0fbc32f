"""Associations from partial sums (A01-A04) against numpy, and splits whose key repeats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import associations as A
from tessera.operators.splitting import SplitConfig, split_assign


def test_all_pairs_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 500
    x = rng.normal(size=n)
    cols = {"x": x + 1e9, "y": x * 2 + rng.normal(size=n), "const": np.full(n, 0.1), "c": rng.choice(list("abé"), n), "d": rng.choice(list("pq"), n)}
    cols["e"] = np.where(x > 0, "hi", "lo")
    gone = {k: rng.random(n) < .1 for k in ("x", "y", "c")}
    rows = [tuple(None if k in gone and gone[k][i] else (v[i].item() if k in ("x", "y", "const") else str(v[i])) for k, v in cols.items()) for i in range(n)]
    rows += [(float("nan"), 1.0, 0.1, "a", "p", "hi"), (float("inf"), 1.0, 0.1, None, None, None)]
    df = spark.createDataFrame(rows, "x double, y double, const double, c string, d string, e string")
    roles = {k: "numeric" if k in ("x", "y", "const") else "category" for k in df.columns}
    got = {}
    for block in (65_536, 37):
        monkeypatch.setattr(A, "BLOCK_ROWS", block)
        table = A.association_table(df.repartition(3), roles).collect()
        assert len(table) == 15
        for r in table:
            got.setdefault((r["x"], r["y"]), []).append((r["value"], r["rows"], r["status"]))
    assert all(a[1:] == b[1:] and (a[0] is None) == (b[0] is None) and (a[0] is None or abs(a[0] - b[0]) < 1e-9) for a, b in got.values())
    both = ~gone["x"] & ~gone["y"]
    assert got["x", "y"][0][0] == pytest.approx(np.corrcoef(cols["x"][both], cols["y"][both])[0, 1], abs=1e-7) and got["x", "y"][0][1] == both.sum()
    assert got["x", "const"][0][2] == "undefined" and got["e", "const"][0][2] == "undefined"
    ok = ~gone["x"]
    own, group = cols["x"][ok] - 1e9, cols["e"][ok]
    between = sum((group == g).sum() * (own[group == g].mean() - own.mean()) ** 2 for g in ("hi", "lo"))
    assert got["e", "x"][0][0] == pytest.approx(np.sqrt(between / ((own - own.mean()) ** 2).sum()), abs=1e-6)
    cells = np.array([[((cols["d"] == a) & (cols["e"] == b)).sum() for b in ("hi", "lo")] for a in ("p", "q")], float)
    cells[0, 0] += 1  # the row with a missing number still has its categories
    want = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True) / cells.sum()
    assert got["d", "e"][0][0] == pytest.approx(np.sqrt(((cells - want) ** 2 / want).sum() / cells.sum()), abs=1e-9)
    assert A.pearson(df, []).collect() == [] and A.association_table(df.limit(0), roles).where("status = 'ok'").isEmpty()


def sizes(df, strategy="random", key="k", **how):
    out = split_assign(df, SplitConfig(strategy, 0.5, 0.3, 0.2), key, **how)
    return {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}


def test_repeated_keys_are_told_apart_by_the_other_columns(spark):
    one_key = spark.range(100).select(F.lit(7).alias("k"), F.col("id").alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("w"))
    assert sizes(one_key) == {"train": 50, "validation": 30, "test": 20}
    pairs = spark.range(100).select(F.floor(F.col("id") / 9).alias("k"), F.col("id").alias("v"), (F.col("id") % 2).alias("y"))
    assert sizes(pairs, "stratified", target="y") == {"train": 50, "validation": 30, "test": 20}


def test_equal_rows_across_a_cut_are_an_error(spark):
    same = spark.range(100).select(F.lit(7).alias("k"), F.lit(1).alias("v"))
    with pytest.raises(ValueError, match="Equal rows"):
        sizes(same)
    with pytest.raises(ValueError, match="Equal rows"):
        sizes(same.select("k"))
