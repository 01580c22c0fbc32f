"""User-defined profile components (K02): mergeable aggregates in four methods.

A component says how a state is updated by an Arrow batch, how two states become one and what a final state means; Spark
does the rest.  Tasks keep one state per key and hand it on when their input ends (or when they hold many keys), states
meet in a tree of ``fan`` at a time, so neither a hot key nor a large number of tasks gathers in one place, and
``finalize`` runs where the last states meet.  The same component runs on a stream, where the merged state of each key is
Spark's state of a stateful operator.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import cut_lineage, ship_package

FAN = 64
MOST_KEYS = 10_000


class Component(ABC):
    """One aggregate over ``columns``.  ``merge`` must not depend on the order or grouping of states, and ``update`` of a
    state must equal the merge with the state of the batch alone.  ``result``: DDL of the row that ``finalize`` returns as a dict."""

    columns: Sequence[str]
    result: str

    @abstractmethod
    def empty(self) -> Any:
        """The state of no rows."""

    @abstractmethod
    def update(self, state: Any, batch: pa.RecordBatch) -> Any:
        """The state with the rows of ``batch`` (the component's columns, nulls included) added."""

    @abstractmethod
    def merge(self, a: Any, b: Any) -> Any:
        """The state of the rows of both."""

    @abstractmethod
    def finalize(self, state: Any) -> dict:
        """The result of a state."""

    def dump(self, state: Any) -> bytes:
        """A state as bytes, to travel between tasks."""
        return pickle.dumps(state, protocol=pickle.HIGHEST_PROTOCOL)

    def load(self, data: bytes) -> Any:
        return pickle.loads(data)


def _checked(df: DataFrame, component: Component, keys: Sequence[str]) -> list[str]:
    missing = [c for c in (*keys, *component.columns) if c not in df.columns]
    clash = {f.name for f in T.StructType.fromDDL(component.result)} & {*keys, "state", "slot"} | {"state", "slot"} & set(keys)
    if missing or clash:
        raise ValueError(f"unknown columns {missing}, names used twice {sorted(clash)}")
    return list(dict.fromkeys([*keys, *component.columns]))


def _states(df: DataFrame, component: Component, keys: Sequence[str]) -> DataFrame:
    """keys and state: a row or more for each task and key."""
    names = _checked(df, component, keys)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("state", T.BinaryType())])
    held_as = to_arrow_schema(T.StructType([df.schema[k] for k in keys]))
    keys, columns = list(keys), list(component.columns)

    def run(batches: Iterator[pa.RecordBatch]):
        states: dict[tuple, list] = {}

        def emit():
            rows = [s[0] for s in states.values()]
            own = pa.Table.from_batches(rows, schema=held_as).combine_chunks()
            dumped = pa.array([component.dump(s[1]) for s in states.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in own.columns), dumped],
                                              names=[*keys, "state"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.select(columns)
            if keys:
                own = batch.select(keys).cast(held_as) if batch.select(keys).schema != held_as else batch.select(keys)
                group = pd.DataFrame({k: own.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys})
                parts = [np.asarray(at) for at in group.groupby(keys, sort=False).indices.values()]
            else:
                own, parts = None, [None]
            for at in parts:
                if at is None:
                    name, one, rows = (), None, values
                else:
                    one = own.slice(int(at[0]), 1)
                    name, rows = tuple(c[0].as_py() for c in one.columns), values.take(pa.array(at))
                name = tuple("nan" if isinstance(v, float) and v != v else v for v in name)
                state = states.setdefault(name, [one, component.empty()])
                state[1] = component.update(state[1], rows)
            if len(states) > MOST_KEYS:
                yield emit()
                states.clear()
        if states:
            if keys:
                yield emit()
            else:
                yield pa.RecordBatch.from_arrays([pa.array([component.dump(states[()][1])], pa.binary())], names=["state"])

    ship_package(df.sparkSession)
    return df.select(*names).mapInArrow(run, schema)


def _merged(states: DataFrame, component: Component, keys: Sequence[str]) -> DataFrame:
    """One row for each (keys, slot) of ``states``; equal ones follow each other in a partition and are merged as they pass."""
    keys = list(keys)
    schema = states.schema

    def run(batches):
        last, state, row = None, None, None

        def out():
            return pa.RecordBatch.from_pylist([{**row, "state": component.dump(state)}], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                name = tuple("nan" if isinstance(r[k], float) and r[k] != r[k] else r[k] for k in (*keys, "slot"))
                if name != last:
                    if row is not None:
                        yield out()
                    last, state, row = name, component.load(r["state"]), r
                else:
                    state = component.merge(state, component.load(r["state"]))
        if row is not None:
            yield out()

    arrow = to_arrow_schema(schema)
    parts = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return states.repartition(parts, *keys, "slot").sortWithinPartitions(*keys, "slot").mapInArrow(run, schema)


def run_component(df: DataFrame, component: Component, keys: Sequence[str] = (), fan: int = FAN) -> DataFrame:
    """keys and the component's result, one row per key; without keys one row, also for an empty table.  A null key is a key."""
    states = _states(df, component, keys)
    states = states.withColumn("slot", F.spark_partition_id().cast("long"))
    if not keys:
        none = df.sparkSession.createDataFrame([(component.dump(component.empty()), 0)], "state binary, slot long")
        states = states.unionByName(none)
    states = cut_lineage(states)
    slots = states.agg(F.max("slot")).first()[0] or 0
    while True:
        slots //= fan
        states = _merged(states.withColumn("slot", F.call_function("div", F.col("slot"), F.lit(fan))), component, keys)
        if not slots:
            break
    return _finalized(states, component, keys)


def _finalized(states: DataFrame, component: Component, keys: Sequence[str]) -> DataFrame:
    schema = T.StructType([*(states.schema[k] for k in keys), *T.StructType.fromDDL(component.result)])
    arrow, keys = to_arrow_schema(schema), list(keys)

    def run(batches):
        for batch in batches:
            rows = [{**{k: r[k] for k in keys}, **component.finalize(component.load(r["state"]))} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return states.select(*keys, "state").mapInArrow(run, schema)


def stream_component(stream: DataFrame, component: Component, keys: Sequence[str] = ()) -> DataFrame:
    """The running result of the component on a stream, in update mode: after each batch, the keys that it changed."""
    states = _states(stream, component, keys)
    keys = list(keys)
    by = keys or ["slot"]
    if not keys:
        states = states.withColumn("slot", F.lit(0))
    schema = T.StructType([*(states.schema[k] for k in keys), *T.StructType.fromDDL(component.result)])

    def merge(key, parts, held):
        state = component.load(bytes(held.get[0])) if held.exists else component.empty()
        for part in parts:
            for data in part["state"]:
                state = component.merge(state, component.load(bytes(data)))
        held.update((component.dump(state),))
        row = {**dict(zip(keys, key, strict=False)), **component.finalize(state)}
        yield pd.DataFrame({f.name: pd.Series([row[f.name]], dtype=object) for f in schema})

    return states.groupBy(*by).applyInPandasWithState(merge, schema, "state binary", "update", "NoTimeout")
