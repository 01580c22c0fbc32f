"""Components of a user's making (K02): one exact, one sketch, on a table and on a stream."""

import hashlib
import sys

import pyarrow.compute as pc
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.operators import accumulators
from tessera.operators.accumulators import Component, run_component, stream_component
from tessera.session import checkpoint_dir
from tessera.streaming.streams import read_stream, run_available

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


class Cents(Component):
    """Exact sums of money: whole numbers of any size, however the rows are grouped."""

    columns = ("price",)
    result = "rows long, cents decimal(38,0), longest string"

    def empty(self):
        return 0, 0, ""

    def update(self, state, batch):
        values = [round(v * 100) for v in batch.column("price").to_pylist() if v is not None]
        return self.merge(state, (batch.num_rows, sum(values), max(map(str, values), key=lambda s: (len(s), s), default="")))

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1], max(a[2], b[2], key=lambda s: (len(s), s))

    def finalize(self, state):
        from decimal import Decimal
        return {"rows": state[0], "cents": Decimal(state[1]), "longest": state[2]}


class Distinct(Component):
    """The k smallest hashes of a column: exact below k distinct values, an estimate above."""

    columns = ("item",)
    result = "items double"

    def __init__(self, k):
        self.k = k

    def empty(self):
        return ()

    def update(self, state, batch):
        seen = {int.from_bytes(hashlib.blake2b(str(v).encode(), digest_size=8).digest(), "big")
                for v in pc.unique(batch.column("item")).to_pylist() if v is not None}
        return self.merge(state, seen)

    def merge(self, a, b):
        return tuple(sorted({*a, *b})[:self.k])

    def finalize(self, state):
        return {"items": float(len(state)) if len(state) < self.k else (self.k - 1) * 2.0**64 / state[-1]}


ROWS = [(i, ["a", "b", None][i % 3], None if i % 10 == 0 else i * 10**9 + 0.25, f"item {i % 70}") for i in range(900)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "i long, g string, price double, item string")


def want(rows):
    prices = [round(p * 100) for _, _, p, _ in rows if p is not None]
    return len(rows), sum(prices), max(map(str, prices), key=lambda s: (len(s), s))


def test_exact_component_by_key_and_whole(table, monkeypatch):
    for many in (10_000, 1):  # at most that many keys in a task before it hands its states on
        monkeypatch.setattr(accumulators, "MOST_KEYS", many)
        got = {r["g"]: tuple(r)[1:] for r in run_component(table.repartition(9), Cents(), ["g"], fan=2).collect()}
        assert got == {g: want([r for r in ROWS if r[1] == g]) for g in ("a", "b", None)}
    assert [tuple(r) for r in run_component(table.repartition(7), Cents(), fan=2).collect()] == [want(ROWS)]


def test_sketch_component(table):
    assert run_component(table, Distinct(100)).first()["items"] == 70
    got = run_component(table.repartition(5), Distinct(16), ["g"]).collect()
    assert len(got) == 3 and all(8 < r["items"] < 200 for r in got)
    assert len({run_component(table.repartition(n), Distinct(16)).first()["items"] for n in (1, 6)}) == 1


def test_empty_tables_and_names(table):
    assert [tuple(r) for r in run_component(table.limit(0), Cents()).collect()] == [(0, 0, "")]
    assert run_component(table.limit(0), Cents(), ["g"]).collect() == []
    for bad in (table.drop("price"), table.withColumnRenamed("g", "state")):
        with pytest.raises(ValueError):
            run_component(bad, Cents(), [bad.columns[1]])


@pytest.mark.parametrize("component,keys", [(Cents(), ["g"]), (Distinct(16), ["g"]), (Distinct(100), [])])
def test_stream_equals_batch(spark, table, component, keys):
    path = f"{checkpoint_dir(spark).rstrip('/')}/component_{type(component).__name__}_{len(keys)}_{getattr(component, 'k', 0)}"
    table.repartition(3, "i").write.parquet(path)
    stream = read_stream(spark, path, table.schema, max_files=1)
    steps = run_available(stream_component(stream, component, keys), "update")
    assert steps.select("_batch").distinct().count() == 3
    last = steps.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in steps.columns if c != "_batch"]), "_batch").alias("r")).select("r.*")
    batch = run_component(table, component, keys)
    assert sorted(map(str, last.collect())) == sorted(map(str, batch.collect()))
