"""Lags by halo exchange (W02, W06-W08) against plain Python."""

import random

import pytest

from tessera.functions.ranking import lagged


@pytest.mark.parametrize("parts,width", [(1, 3), (5, 1), (40, 4), (64, 9)])
def test_lags_across_slices(spark, parts, width):
    """Slices shorter than the lag, a series in many slices, a null series, null values."""
    rng = random.Random(parts)
    table = [(k, t, None if rng.random() < .2 else rng.randrange(100)) for k, n in (("a", 60), ("b", 1), (None, 7), ("c", 12)) for t in range(n)]
    df = spark.createDataFrame(rng.sample(table, len(table)), "k string, t int, v int")
    out = lagged(df, ["k"], ["t"], {f"l{i}": ("v", i) for i in range(1, width + 1)} | {"t2": ("t", 2)}, before="pos", partitions=parts)
    by = {}
    for k, t, v in table:
        by.setdefault(k, []).append((t, v))
    want = [(k, t, v, *(by[k][t - i][1] if t >= i else None for i in range(1, width + 1)), t - 2 if t > 1 else None, t) for k, t, v in table]
    got = out.select("k", "t", "v", *[f"l{i}" for i in range(1, width + 1)], "t2", "pos").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_one_series_and_none(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(30)], "t int, v int")
    got = {r["t"]: r["p"] for r in lagged(df, [], ["t"], {"p": ("v", 1)}, partitions=6).collect()}
    assert got == {t: (t - 1) ** 2 if t else None for t in range(30)}
    assert lagged(df.limit(0), [], ["t"], {"p": ("v", 1)}).collect() == []
