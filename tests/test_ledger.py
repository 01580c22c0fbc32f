"""Run ledger and cohorts (V10), and drift between files."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tessera.operators.drift import drift, file_profiles
from tessera.operators.ledger import Ledger, Run, cohorts
from tessera.session import checkpoint_dir


def test_many_writers_lose_no_run(spark):
    path = checkpoint_dir(spark).rstrip("/") + "/ledger_writers"
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: Ledger(spark, path).record(Run(f"r{i:02}", "d", "t", "p", {"test": {"c": {"f1": i / 100}}})), range(40)))
    got = cohorts(Ledger(spark, path).runs(), "f1", "max").collect()
    assert [(r["run"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(f"r{39 - i:02}", i + 1) for i in range(40)]


def test_cohorts_keep_preparations_and_bases_apart(spark):
    ledger = Ledger(spark, checkpoint_dir(spark).rstrip("/") + "/ledger_cohorts")
    assert cohorts(ledger.runs(), "f1", "max").collect() == []
    for run in (Run("a", "d", "t", "p", {"validation": {"x": {"f1": .5}, "y": {"f1": float("nan")}}, "training": {"x": {"f1": .99}}}),
                Run("b", "d", "t", "p", {"training": {"x": {"f1": 1.}}}), Run("c", "d", "t", "q", {"validation": {"x": {"f1": .9}}}),
                Run("e", "d", "t", "p", {"validation": {"x": {"f1": .5, "mae": 3.}}}), Run("e", "d", "t", "p", {"validation": {"x": {"f1": .4}}})):
        ledger.record(run)
    got = sorted((r["preparation"], r["basis"], r["rank"], r["run"], r["candidate"], r["score"], r["fallback"])
                 for r in cohorts(ledger.runs(), "f1", "max").collect())
    assert got == [("p", "training", 1, "b", "x", 1., True), ("p", "validation", 1, "a", "x", .5, False), ("p", "validation", 2, "e", "x", .5, False),
                   ("p", "validation", 3, "a", "y", None, False), ("q", "validation", 1, "c", "x", .9, False)]
    for bad in (Run("a", "d", "t", "", {"test": {"x": {"f1": 1.}}}), Run("a", "d", "t", "p", {"guess": {}}), Run("a", "d", "t", "p")):
        with pytest.raises(ValueError):
            ledger.record(bad)


def test_drift_of_csv_files(spark):
    import os
    base = checkpoint_dir(spark).removeprefix("file:").rstrip("/") + "/drift_csv"
    os.makedirs(base)
    for i in range(5):
        with open(f"{base}/{i}.csv", "w") as f:
            f.write("k,v,w\n" + "".join(f"{j},{'' if i == 2 and j % 2 else j * 1.5},{500 + j if i == 4 else j}\n" for j in range(20)))
    got = drift(file_profiles(spark, base)).collect()
    assert sorted((r["file"][-5], r["column"], r["code"], r["own"], r["others"]) for r in got) == [
        ("2", "v", "missing_drift", "50.00%", "0.00%"), ("4", "w", "range_drift", "500.0..519.0", "0.0..19.0")]
    assert drift(file_profiles(spark, f"{base}/0.csv")).collect() == []
