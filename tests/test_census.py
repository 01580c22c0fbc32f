"""Many files as one dataset."""

import gzip
import os

import pytest

from tessera.session import checkpoint_dir
from tessera.sources.readers import open_dataset, write_unified


@pytest.fixture(scope="module")
def base(spark):
    path = checkpoint_dir(spark).removeprefix("file:").rstrip("/") + "/census"
    os.makedirs(path)
    return path


def write(base, name, text):
    os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
    with (gzip.open if name.endswith(".gz") else open)(f"{base}/{name}", "wt") as f:
        f.write(text)
    return f"{base}/{name}"


def scans(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")


def jobs_of(spark, fn):
    """What ``fn`` returns and how many jobs it ran."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    out = fn()
    return out, len(set(tracker.getJobIdsForGroup(None)) - before)


def test_two_thousand_files_are_a_few_scans(spark, base):
    for i in range(2000):
        write(base, f"many/{i:04}.csv", f"b,a\nx{i},{i}\n" if i % 2 else f"a,b\n{i},x{i}\n")
    df, many = jobs_of(spark, lambda: open_dataset(spark, f"{base}/many"))
    assert scans(df) == 2 and df.columns == ["a", "b"]
    assert sorted(map(tuple, df.collect())) == [(i, f"x{i}") for i in range(2000)]
    _, few = jobs_of(spark, lambda: open_dataset(spark, [f"{base}/many/{i:04}.csv" for i in range(20)]))
    assert many <= few + 10  # Spark lists many paths by jobs of its own, whose number does not grow


def test_types_are_joined(spark, base):
    spark.createDataFrame([(1, "x")], "v int, s string").write.parquet(f"{base}/types/a")
    spark.createDataFrame([(2.5, "y")], "v double, s string").write.parquet(f"{base}/types/b")
    spark.createDataFrame([("z", 2**40)], "s string, v long").write.parquet(f"{base}/types/c")
    got = write_unified(spark, f"{base}/types/*/*.parquet", f"{base}/types_landed")
    assert got == {"rows": 3, "schema": {"v": "double", "s": "string"}}
    assert sorted(map(tuple, spark.read.parquet(f"{base}/types_landed").collect())) == [(1.0, "x"), (2.5, "y"), (2.0**40, "z")]
    ints = open_dataset(spark, f"{base}/types/[ac]/*.parquet")
    assert dict(ints.dtypes)["v"] == "bigint"


def test_text_and_numbers_do_not_meet(spark, base):
    a, b = write(base, "mixed/a.csv", "v\n1\n"), write(base, "mixed/b.tsv", "v\nword\n")
    with pytest.raises(ValueError, match="column v"):
        open_dataset(spark, [a, b])
    both = open_dataset(spark, [a, b], dtype={"v": "string"})
    assert sorted(r["v"] for r in both.collect()) == ["1", "word"]


def test_names_kinds_and_separators(spark, base):
    made = [write(base, "kinds/a.csv", "k,n\n1,x\n"), write(base, "kinds/b.txt", "n;k\ny;2\n"), write(base, "kinds/c.tsv", "k\tn\n3\tz\n"),
            write(base, "kinds/d.jsonl", '{"n": "w", "k": 4}\n')]
    got = open_dataset(spark, made)
    assert sorted(map(tuple, got.select("k", "n").collect())) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    assert open_dataset(spark, [made[0], made[0]]).count() == 2
    with pytest.raises(ValueError, match="names differ"):
        open_dataset(spark, [made[0], write(base, "kinds/e.csv", "k,m\n1,x\n")])
    with pytest.raises(ValueError, match="names differ"):
        open_dataset(spark, [made[3], write(base, "kinds/f.jsonl", '{"k": 1}\n')])
