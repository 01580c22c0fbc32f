import math
import statistics

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.operators import associations as A


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_nonfinite_counts(spark):
    x = [1.0, float("nan"), float("inf"), float("-inf"), -2.0, 0.0]
    df = spark.createDataFrame([(v, 4.0, float("nan")) for v in x], "x double, c double, e double")
    m = {r["column"]: r for r in rows(P.numeric_moments(df))}
    assert m["x"]["n"] == 3 and m["x"]["num_missing"] == 1 and m["x"]["num_infinity"] == 2
    assert math.isclose(m["x"]["mean"], -1 / 3)
    assert m["x"]["num_zeros"] == 1 and m["x"]["num_neg"] == 1
    assert m["c"]["skew"] is None and m["c"]["variance"] == 0
    assert m["e"]["mean"] is None and m["e"]["n"] == 0


def test_moments_match_numpy_any_partitioning(spark):
    rng = np.random.default_rng(12)
    vals = rng.gamma(2, 3, 537).tolist()
    base = spark.createDataFrame([(v,) for v in vals], "x double")
    for parts in (1, 3, 7):
        df = base.repartition(parts)
        m = rows(P.numeric_moments(df))[0]
        assert math.isclose(m["mean"], statistics.fmean(vals), rel_tol=1e-12)
        assert math.isclose(m["variance"], statistics.variance(vals), rel_tol=1e-9)
        q = rows(P.numeric_quantiles(df))[0]
        assert math.isclose(q["median"], float(np.median(vals)), rel_tol=1e-12)
        mad = float(np.median(np.abs(np.array(vals) - np.median(vals))))
        assert math.isclose(q["mad"], mad, rel_tol=1e-12)


def test_large_offset_variance(spark):
    vals = [1e9 + i / 10 for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    m = rows(P.numeric_moments(df))[0]
    assert round(m["variance"], 5) == round(statistics.variance(vals), 5)


def test_duplicates_nan_equal(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (1.0,), (float("nan"),), (2.0,), (2.0,)], "x double")
    assert rows(P.table_summary(df))[0]["duplicate_rows"] == 3


def test_role_threshold(spark):
    data = [(i % 10, i % 11, "yes" if i % 2 else "no") for i in range(110)]
    df = spark.createDataFrame(data, "ten long, eleven long, words string")
    roles = {r["column"]: r["role"] for r in rows(P.column_overview(df))}
    assert roles == {"ten": "category", "eleven": "numeric", "words": "category"}


def test_top_words(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("hello",)], "t string")
    got = {r["word"]: r["count"] for r in rows(P.top_words(df, "t"))}
    assert got == {"hello": 2, "world": 1}


def test_pairwise_pearson_uses_complete_finite_rows(spark):
    x = [1, 2, float("nan"), 4, 8, float("inf")]
    y = [3, float("nan"), 5, 8, 7, 9]
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double")
    r = rows(A.pearson(df, [("x", "y")]))[0]
    assert r["rows"] == 3
    assert math.isclose(r["value"], float(np.corrcoef([1, 4, 8], [3, 8, 7])[0, 1]), rel_tol=1e-9)


def test_cramers_v_and_eta(spark):
    xs = ["a"] * 30 + ["b"] * 30
    ys = ["c"] * 10 + ["d"] * 20 + ["c"] * 20 + ["d"] * 10
    df = spark.createDataFrame(list(zip(xs, ys)), "x string, y string")
    v = rows(A.cramers_v(df, [("x", "y")]))[0]["value"]
    assert math.isclose(v, 1 / 3, rel_tol=1e-12)
    g = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    assert math.isclose(rows(A.correlation_ratio(g, [("g", "v")]))[0]["value"], 1.0)
    one = spark.createDataFrame([("a", "c"), ("a", "d")], "x string, y string")
    assert rows(A.cramers_v(one, [("x", "y")]))[0]["value"] is None


def test_least_squares_and_spearman(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + 4) for i in range(20)], "x double, y double")
    r = rows(A.least_squares(df, "x", "y"))[0]
    assert math.isclose(r["slope"], 3) and math.isclose(r["intercept"], 4)
    s = spark.createDataFrame([(1.0, 5.0), (2.0, float("nan")), (3.0, 1.0), (4.0, 2.0), (5.0, 3.0)], "a double, b double")
    got = rows(A.spearman(s, "a", "b"))[0]["value"]
    # ranks after pairwise deletion: a = 1,3,4,5 -> 1..4 ; b = 5,1,2,3 -> 4,1,2,3
    assert math.isclose(got, float(np.corrcoef([1, 2, 3, 4], [4, 1, 2, 3])[0, 1]))
