"""Sampling, previews and top-k (Q01-Q08) and order-dependent operators.

Samples are *priority* samples: each row's priority is the SHA-256 of ``seed '\\0' key`` and the
sample is the ``n`` smallest priorities -- identical however the data is partitioned (unlike
``DataFrame.sample``), and planned as ``TakeOrderedAndProject`` (per-partition heaps of n rows,
then one merge of ``partitions x n`` rows), never a global sort.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import priority


def row_key_text(cols: Sequence[str]) -> Column:
    cols = list(cols)
    if len(cols) == 1:
        return F.col(cols[0]).cast("string")
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])


def tie_break(df: DataFrame, exclude: Sequence[str]) -> list[Column]:
    """The remaining orderable columns, in schema order: when the sampling key is not unique,
    rows sharing it are ordered by their values, so the sample does not depend on partitioning."""
    from pyspark.sql import types as T
    atomic = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [F.col(f.name) for f in df.schema.fields
            if f.name not in set(exclude) and isinstance(f.dataType, atomic)]


def priority_sample(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Q01: exactly min(n, N) rows without replacement, the same rows for any partitioning."""
    k = row_key_text(key or df.columns)
    pr = priority(seed, k)
    ties = tie_break(df, key or df.columns)
    return df.withColumn("_pr", pr).withColumn("_tk", k).orderBy("_pr", "_tk", *ties).limit(n).drop("_pr", "_tk")


def per_group_sample(df: DataFrame, group: str, n: int, seed: int = 42, key: Sequence[str] | None = None,
                     salts: int = 64) -> DataFrame:
    """Q02: n rows per group by smallest priority.  Two window stages over (group, salt) then
    group, so a group holding a third of all rows is split ``salts`` ways before ranking."""
    from tessera.operators.profile import top_k
    key = key or [c for c in df.columns if c != group]
    k = row_key_text(key)
    staged = df.withColumn("_pr", priority(seed, k)).withColumn("_tk", k)
    order = [F.col("_pr"), F.col("_tk"), *tie_break(df, [*key, group])]
    out = top_k(staged, [group], order, n, salt_of="_pr", salts=salts, rank_name="_rank")
    return out.drop("_pr", "_tk", "_rank")


def preview(df: DataFrame, order: Sequence[str], max_rows: int = 200) -> tuple[DataFrame, bool]:
    """Q03: first ``max_rows`` rows in key order and whether more exist (fetches max_rows + 1)."""
    head = df.orderBy(*order).limit(max_rows + 1)
    rows = head.collect()  # bounded by max_rows + 1
    truncated = len(rows) > max_rows
    return df.sparkSession.createDataFrame(rows[:max_rows], df.schema), truncated


def changed_rows(before: DataFrame, after: DataFrame, row_id: str, limit: int = 5) -> DataFrame:
    """J05 + Q04: rows whose values differ after a transformation (null-safe), including rows the
    transformation removed; first ``limit`` by row id."""
    cols = [c for c in before.columns if c != row_id and c in after.columns]
    a = after.select(row_id, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(True).alias("_kept"))
    j = before.join(a, row_id, "left")
    same = None
    for c in cols:
        eq = F.col(c).eqNullSafe(F.col(f"_a_{c}"))
        same = eq if same is None else same & eq
    changed = F.col("_kept").isNull() | ~same if same is not None else F.col("_kept").isNull()
    return j.where(changed).select(row_id, *cols, F.col("_kept").isNull().alias("removed")) \
        .orderBy(row_id).limit(limit)


def leaderboard(df: DataFrame, score: str, direction: str, ties: Sequence[str] = ("run", "candidate")) -> DataFrame:
    """Q06: score by metric direction, NULL last, then run and candidate."""
    o = F.col(score).desc_nulls_last() if direction == "max" else F.col(score).asc_nulls_last()
    return df.orderBy(o, *[F.col(t) for t in ties if t in df.columns])


# ---------------------------------------------------------------- windows

def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Zero-based ordinal over files in sorted path order, then row order in each file.

    For Parquet sources: ``_metadata.file_path`` + ``_metadata.row_index`` and per-file row
    counts, summed by the rank core over files -- no sort of the data, and no window or broadcast that grows with the
    files.  ``df`` must be a plain Parquet scan (so ``_metadata`` is available)."""
    from tessera.functions.ranking import cumulative
    meta = df.select("*", F.col("_metadata.file_path").alias("_fp"), F.col("_metadata.row_index").alias("_ri"))
    files = meta.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n"))
    offs = cumulative(files, [], ["_fp"], weight="_n", before="_off").select("_fp", "_off")
    return meta.join(offs, "_fp").withColumn(name, (F.col("_off") + F.col("_ri")).cast("bigint")) \
        .drop("_fp", "_ri", "_off")


def row_number_by(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """1-based position of each row in ``order`` (a unique key), from the distributed rank core
    (range slices + offsets), not a single-partition window."""
    from tessera.functions.ranking import cumulative
    staged = df.withColumn("_one", F.lit(1))
    ranked = cumulative(staged, [], list(order), weight="_one", before="_before", total="_total")
    return ranked.withColumn(name, F.col("_before") + 1).drop("_one", "_before", "_total")


def row_views(df: DataFrame, row_id: str, total: int, width: int = 10) -> DataFrame:
    """First / middle / last ``width`` rows with 1-based row numbers (by range filter on
    the row id, no sort of the table)."""
    first = (0, min(width, total))
    mid0 = max(0, (total - width) // 2)
    middle = (mid0, min(total, mid0 + width))
    last = (max(0, total - width), total)
    parts = []
    for name, (a, b) in (("first", first), ("middle", middle), ("last", last)):
        parts.append(df.where((F.col(row_id) >= a) & (F.col(row_id) < b))
                     .withColumn("view", F.lit(name)).withColumn("row_number", F.col(row_id) + 1))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lags(df: DataFrame, ts: str, value: str, window: int, series: str | None = None) -> DataFrame:
    """Lag features ``value_lag_1 .. value_lag_w`` over time within each series (see
    ``series.lag_features``: positions + one keyed aggregate, no per-series window)."""
    from tessera.operators.series import lag_features
    return lag_features(df, ts, value, window, series).drop("pos")


ROW_RANGE = re.compile(r"([0-9]+)(?:\s*-\s*([0-9]+))?", re.ASCII)


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """P20: '1, 3-10' -> [(1, 1), (3, 10)] (1-based, inclusive); ranges are never expanded and blank
    parts are passed over."""
    out = []
    for part in filter(None, map(str.strip, text.split(","))):
        found = ROW_RANGE.fullmatch(part)
        first, last = (int(found[1]), int(found[2] or found[1])) if found else (0, 0)
        if not 1 <= first <= last:
            raise ValueError(f"{part!r} is neither a row number from 1 nor a range of them")
        out.append((first, last))
    if not out:
        raise ValueError("No row numbers are given")
    return out


def filter_ranges(df: DataFrame, row_number: Column, include: str | None = None, exclude: str | None = None,
                  total: int | None = None) -> DataFrame:
    """P20: keep 1-based row numbers in ``include`` then drop those in ``exclude``; a range
    that reaches past the end is an error when ``total`` (the number of rows) is given."""
    def cond(text):
        c = None
        for lo, hi in parse_ranges(text):
            if total is not None and hi > total:
                raise ValueError(f"Row {hi} is past the end ({total} rows)")
            part = row_number.between(lo, hi)
            c = part if c is None else c | part
        return c
    out = df
    if include:
        out = out.where(cond(include))
    if exclude:
        out = out.where(~cond(exclude))
    return out
