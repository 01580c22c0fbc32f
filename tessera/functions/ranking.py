"""Exact global order statistics without a single-partition window.

The shared core of quantiles, MAD, box plots, ECDF, Spearman ranks, ROC AUC and the random /
stratified / chronological splits: for each row of a (usually pre-aggregated) table, the total
weight of the rows strictly before it in ``order`` within ``keys``.

Plan shape (all DataFrame operators):

1. ``repartitionByRange(P, *keys, *order)`` -- a sampled range exchange, so a hot key (or a
   table with no key at all) is cut across many partitions instead of landing in one task;
2. ``spark_partition_id()`` tags each row with its range slice; the tagged table is
   checkpointed once so every later use sees the same slices;
3. per-slice totals (at most ``P + #keys`` rows) get running offsets by a window over
   ``keys`` ordered by slice id, i.e. over at most ``P`` rows per key;
4. inside each (key, slice) a running sum gives the local offset; local + slice offset = rank.

No step holds more than one range slice in a task, and nothing is collected to the driver.
Inputs should be aggregated to distinct values first (``value_counts``) so repeated values --
including a value holding a third of all rows -- collapse map-side before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

PID = "_rk_pid"


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return int(partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def value_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 name: str = "cnt") -> DataFrame:
    """Distinct (keys, order) with their row counts; partial aggregation happens map-side."""
    return df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias(name))


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], weight: str = "cnt",
               before: str = "before", total: str = "total", partitions: int | None = None) -> DataFrame:
    """Add ``before`` = sum of ``weight`` over rows strictly earlier in ``order`` within ``keys``
    and ``total`` = sum of ``weight`` within ``keys``.  Ties in ``order`` must not occur (use
    distinct values or add a unique tie-break column)."""
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    p = _partitions(df, partitions)
    # The slice id must be identical in both uses below (slice totals and local running sums),
    # so the range-partitioned, slice-tagged table is materialised once by a reliable checkpoint
    # (shared checkpoint folder; survives executor loss) instead of trusting exchange reuse.
    ranged = cut_lineage(df.repartitionByRange(p, *[F.col(k) for k in keys], *order_cols)
                         .withColumn(PID, F.spark_partition_id()))
    slices = ranged.groupBy(*keys, PID).agg(F.sum(weight).alias("_rk_slice"))
    w_keys = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    slices = slices.select(
        *keys, PID,
        F.coalesce(F.sum("_rk_slice").over(
            w_keys.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_rk_off"),
        F.sum("_rk_slice").over(w_keys).alias(total))
    w_local = Window.partitionBy(*keys, PID).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_rk_loc", F.coalesce(F.sum(weight).over(w_local), F.lit(0)))
    out = local.join(slices, on=[*keys, PID], how="inner")
    return out.withColumn(before, (F.col("_rk_off") + F.col("_rk_loc")).cast("bigint")) \
        .withColumn(total, F.col(total).cast("bigint")) \
        .drop(PID, "_rk_off", "_rk_loc")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
                    partitions: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy default, DuckDB ``quantile_cont``).

    ``df`` holds non-missing ``value`` rows.  Returns (keys..., ``p``, ``q``).  Each row of the
    distinct-value table checks, from its own rank range, whether it holds one of the two order
    statistics each requested probability interpolates between -- no join with targets.
    """
    keys = list(keys)
    counts = value_counts(df, keys, [value])
    return ranked_quantiles(cumulative(counts, keys, [value], partitions=partitions), value, probs, keys)


def ranked_quantiles(ranked: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` from a distinct-value table already ranked by ``cumulative`` (columns
    keys, value, cnt, before, total), so callers can aggregate other per-value columns from the
    same materialised table."""
    keys = list(keys)
    hits = []
    for p in probs:
        h = (F.col("total") - 1).cast("double") * F.lit(float(p))
        lo = F.floor(h)
        hi = F.ceil(h)
        start, end = F.col("before"), F.col("before") + F.col("cnt")
        hits.append(F.when((start <= lo) & (lo < end),
                           F.struct(F.lit(float(p)).alias("p"), F.lit("lo").alias("k"), h.alias("h"))))
        hits.append(F.when((start <= hi) & (hi < end),
                           F.struct(F.lit(float(p)).alias("p"), F.lit("hi").alias("k"), h.alias("h"))))
    found = ranked.select(*keys, value, F.explode(F.filter(F.array(*hits), lambda s: s.isNotNull())).alias("t"))
    agg = found.groupBy(*keys, F.col("t.p").alias("p")).agg(
        F.max(F.when(F.col("t.k") == "lo", F.col(value))).alias("_lo"),
        F.max(F.when(F.col("t.k") == "hi", F.col(value))).alias("_hi"),
        F.max("t.h").alias("_h"))
    frac = F.col("_h") - F.floor(F.col("_h"))
    q = F.when(F.col("_hi") == F.col("_lo"), F.col("_lo")) \
        .otherwise(F.col("_lo") + frac * (F.col("_hi") - F.col("_lo")))
    return agg.select(*keys, "p", q.cast("double").alias("q"))


def quantile_columns(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
                     names: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``exact_quantiles`` pivoted to one column per probability (pivot values are given, so no
    extra job to discover them)."""
    keys = list(keys)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    long = exact_quantiles(df, value, probs, keys, partitions)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n) for p, n in zip(probs, names)]
    if keys:
        return long.groupBy(*keys).agg(*aggs)
    return long.agg(*aggs)


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank",
                 partitions: int | None = None) -> DataFrame:
    """Distinct (keys, value) with the 1-based average rank of ties (pandas ``rank()``)."""
    counts = value_counts(df, keys, [value])
    ranked = cumulative(counts, keys, [value], partitions=partitions)
    return ranked.select(*keys, value, "cnt", "total",
                         (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(name))


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], lags: dict[str, tuple[str, int]], before: str | None = None,
           partitions: int | None = None) -> DataFrame:
    """``df`` with the columns ``lags`` (name -> (column, distance): its value that many rows earlier in ``order`` within ``keys``,
    null where there are fewer) and, if named, ``before`` (rows earlier).

    Range slices as in ``cumulative``; lags are taken inside a slice, and the first rows of a slice find theirs in its
    halo: the last rows of the slices before, one array per (key, slice) of at most as many rows as the largest distance.  Nothing is joined by
    position and no row is sent more than once.  A null key is a key; ties in ``order`` must not occur."""
    keys, width = list(keys), max(d for _, d in lags.values())
    columns = list(dict.fromkeys(c for c, _ in lags.values()))
    order_cols = [F.col(o) for o in order]
    ranged = cut_lineage(df.repartitionByRange(_partitions(df, partitions), *[F.col(k) for k in keys], *order_cols)
                         .withColumn(PID, F.spark_partition_id()))
    local = Window.partitionBy(*keys, PID).orderBy(*order_cols)
    numbered = ranged.withColumn("_rk_at", F.row_number().over(local))
    values = F.struct("_rk_at", *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    ends = numbered.withColumn("_rk_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, PID))).where(
        F.col("_rk_at") > F.col("_rk_n") - width).groupBy(*keys, PID).agg(
        F.max("_rk_n").alias("_rk_n"), F.sort_array(F.collect_list(values), asc=False).alias("_rk_end"))
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(PID)
    halo = ends.select(
        *[F.col(k).alias(f"_rk_k{i}") for i, k in enumerate(keys)], F.col(PID).alias("_rk_slice"),
        F.coalesce(F.sum("_rk_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_rk_before"),
        F.slice(F.flatten(F.reverse(F.collect_list("_rk_end").over(earlier.rowsBetween(-width, -1)))), 1, width).alias("_rk_halo"))
    same = F.col(PID) == F.col("_rk_slice")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_rk_k{i}"))
    inside = {name: F.lag(c, d).over(local) for name, (c, d) in lags.items()}
    joined = numbered.withColumns(inside).join(halo, same)
    found = {name: F.when(F.col("_rk_at") > d, F.col(name)).otherwise(
        F.get("_rk_halo", F.lit(d) - F.col("_rk_at"))[f"c{columns.index(c)}"]) for name, (c, d) in lags.items()}
    if before:
        found[before] = (F.col("_rk_before") + F.col("_rk_at") - 1).cast("bigint")
    return joined.withColumns(found).drop(PID, "_rk_at", "_rk_slice", "_rk_before", "_rk_halo", *[f"_rk_k{i}" for i in range(len(keys))])
