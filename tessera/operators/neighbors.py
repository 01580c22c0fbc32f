"""Exact k nearest neighbours (M10) with pivot pruning, as equi-joins on cells.

1. ``P`` pivots: a priority sample of training rows (P x dim literals -- bounded).
2. Every training row goes to the cell of its nearest pivot; per cell the radius R_c (largest
   member distance) and size (P rows).
3. Every query lists its pivot distances d(q, p_c).  Round 1 joins it with the nearest cells
   holding at least k points in total, which gives an upper bound D(q) on its k-th distance.
   Round 2 adds every other cell whose triangle-inequality lower bound d(q, p_c) - R_c is <= D(q).
   Cells outside both rounds cannot contain a closer point, so the result is exact.
4. Top k per query by (distance, id) and a majority vote (uniform) or inverse-distance vote.

Only query x candidate-cell pairs are met, never all query x training pairs (unless the data
really has no structure the pivots can use).  A cell is cut into parts and its queries into slices, a task holds a part and its
queries stream past in matrix products; what rounding leaves open is measured, and only the k nearest of a part leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import priority
from tessera.session import cut_lineage


#: training rows of a part, queries of a slice, and queries of one matrix product
PART = 8_192
SLICE = 50_000
ROWS = 256


def _dist(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def _first(x: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x``, rows of ``v`` and distances of the k rows of ``v`` nearest to each row of ``x``; ties to earlier rows."""
    x2, v2 = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", v, v)
    d2 = x @ v.T
    d2 *= -2
    d2 += x2[:, None]
    d2 += v2[None, :]
    slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (float(x2.max(initial=0)) + float(v2.max(initial=0)))
    kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
    rows, at = np.nonzero(~(d2 > kth[:, None] + 2 * slack))  # also where the product is not a number
    exact = np.zeros(len(rows))
    for d in range(x.shape[1]):
        exact += np.square(x[rows, d] - v[at, d])
    exact = np.sqrt(exact)
    order = np.lexsort((at, exact, rows))
    rows, at, exact = rows[order], at[order], exact[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], at[kept], exact[kept]


def _meeter(k: int):
    """The k nearest training rows of a part for each query that comes to it: _qid, _tid, distance.  The part's rows come first, by
    id, and are held.  A query without a vector has no distances."""
    def near(ids, v, piece):
        n = min(k, len(v))
        given, valid = piece.column(6), np.flatnonzero(np.asarray(piece.column(6).is_valid()))
        rows, at, dist = _first(np.asarray(given.flatten(), float).reshape(len(valid), v.shape[1]), v, n)
        without = np.setdiff1d(np.arange(len(given)), valid)
        rows = np.concatenate((valid[rows], np.repeat(without, n)))
        at = np.concatenate((at, np.tile(np.arange(n), len(without))))
        known = np.arange(len(rows)) < len(dist)
        dist = np.concatenate((dist, np.zeros(len(rows) - len(dist))))
        return pa.RecordBatch.from_arrays([piece.column(4).take(pa.array(rows)), ids.take(pa.array(at)), pa.array(dist, mask=~known)],
                                          names=["_qid", "_tid", "distance"])

    def run(batches):
        unit, held, part = None, [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column(i)) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                own = tuple(keys[lo, :3])
                if own != unit:
                    unit, held, part = own, [], None
                if keys[lo, 3] == 0:
                    held.append(b.slice(lo, hi - lo))
                    continue
                if part is None and held:
                    n = sum(h.num_rows for h in held)
                    part = (pa.concat_arrays([h.column(5) for h in held]),
                            np.concatenate([np.asarray(h.column(6).flatten(), float) for h in held]).reshape(n, -1))
                    held = []
                if part is not None:
                    for at in range(lo, hi, ROWS):
                        yield near(*part, b.slice(at, min(ROWS, hi - at)))

    return run


def knn(train: DataFrame, query: DataFrame, k: int, vec: str = "vec", tid: str = "id", qid: str = "qid",
        pivots: int = 32, seed: int = 42) -> DataFrame:
    """(qid, neighbour id, distance, rank) for the k nearest training rows of each query."""
    t = train.select(F.col(tid).alias("_tid"), F.col(vec).cast("array<double>").alias("_v"), *[c for c in train.columns
                                                                                              if c not in (tid, vec)])
    q = query.select(F.col(qid).alias("_qid"), F.col(vec).cast("array<double>").alias("_qv"))
    piv = t.withColumn("_pr", priority(seed, F.col("_tid").cast("string"))).orderBy("_pr", "_tid") \
        .limit(pivots).select("_v").collect()  # P x dim values, bounded by ``pivots``
    plist = F.array(*[F.array(*[F.lit(float(x)) for x in r["_v"]]) for r in piv])
    pd = F.transform(plist, lambda p: _dist(F.col("_v"), p))
    t = t.withColumn("_pd", pd).withColumn("_cell", F.array_position("_pd", F.array_min("_pd")).cast("int") - 1) \
        .withColumn("_r", F.array_min("_pd")).drop("_pd")
    t = cut_lineage(t)  # cell statistics and both join rounds read it: pivot distances once
    cells = t.groupBy("_cell").agg(F.max("_r").alias("_R"), F.count(F.lit(1)).alias("_n")).collect()  # <= P rows
    radius = {r["_cell"]: float(r["_R"]) for r in cells}
    size = {r["_cell"]: int(r["_n"]) for r in cells}
    qp = q.withColumn("_qd", F.transform(plist, lambda p: _dist(F.col("_qv"), p)))
    # all (query, cell) with d(q, p_c); P rows per query
    qc = qp.select("_qid", "_qv", F.posexplode("_qd").alias("_cell", "_dqc")) \
        .where(F.col("_cell").isin(list(size))).withColumn("_cell", F.col("_cell").cast("int"))
    R = F.create_map(*[x for c, r in radius.items() for x in (F.lit(c), F.lit(r))])
    N = F.create_map(*[x for c, n in size.items() for x in (F.lit(c), F.lit(n))])
    w = Window.partitionBy("_qid").orderBy("_dqc", "_cell")
    qc = qc.withColumn("_before", F.coalesce(F.sum(F.element_at(N, F.col("_cell"))).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = qc.where(F.col("_before") < k)  # nearest cells until >= k points are covered
    t_small = t.select("_tid", "_v", "_cell")

    kinds = dict(first.dtypes)["_qid"], dict(t_small.dtypes)["_tid"]
    slices = max(1, -(-q.count() // SLICE))
    parts = {c: max(1, -(-n // PART)) for c, n in size.items()}
    cut = F.element_at(F.create_map(*[x for c, n in parts.items() for x in (F.lit(c), F.lit(n))]), F.col("_cell")) if parts else F.lit(1)
    units = max(1, min(2 * slices * sum(parts.values()), 4 * train.sparkSession.sparkContext.defaultParallelism))
    held = t_small.select("_cell", F.pmod(F.xxhash64("_tid"), cut).cast("int").alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(
        slices - 1))).alias("_slice"), F.lit(0).alias("_kind"), F.lit(None).cast(kinds[0]).alias("_qid"), "_tid", F.col("_v"))
    whole = F.when(~F.exists("_qv", lambda x: x.isNull()), F.col("_qv"))

    def pairs(sel):
        come = sel.select("_cell", F.explode(F.sequence(F.lit(0), cut - 1)).alias("_part"), F.pmod(F.xxhash64("_qid"), F.lit(slices)).cast(
            "int").alias("_slice"), F.lit(1).alias("_kind"), "_qid", F.lit(None).cast(kinds[1]).alias("_tid"), whole.alias("_v"))
        unit = ["_cell", "_part", "_slice"]
        met = held.unionByName(come).repartition(units, *unit).sortWithinPartitions(*unit, "_kind", "_tid")
        return met.mapInArrow(_meeter(k), f"_qid {kinds[0]}, _tid {kinds[1]}, distance double")
    d1 = cut_lineage(pairs(first))  # feeds the k-th distance bound and the final ranking
    kth = d1.withColumn("_rk", F.row_number().over(Window.partitionBy("_qid").orderBy("distance", "_tid"))) \
        .where(F.col("_rk") == min(k, sum(size.values()))).select("_qid", F.col("distance").alias("_bound"))
    second = qc.where(F.col("_before") >= k).join(kth, "_qid") \
        .where(F.greatest(F.lit(0.0), F.col("_dqc") - F.element_at(R, F.col("_cell"))) <= F.col("_bound")) \
        .drop("_bound")
    allp = d1.unionByName(pairs(second.select(*first.columns)))
    ranked = allp.withColumn("rank", F.row_number().over(Window.partitionBy("_qid").orderBy("distance", "_tid")))
    return ranked.where(F.col("rank") <= k).select(F.col("_qid").alias(qid), F.col("_tid").alias("neighbor"),
                                                   "distance", F.col("rank").cast("int").alias("rank"))


def knn_predict(train: DataFrame, query: DataFrame, k: int, label: str, weights: str = "uniform",
                vec: str = "vec", tid: str = "id", qid: str = "qid", pivots: int = 32) -> DataFrame:
    """Class by majority of the k nearest labels (ties -> smallest label), or by summed
    inverse distance (``weights='distance'``; an exact match wins outright)."""
    nb = knn(train, query, k, vec, tid, qid, pivots)
    lab = train.select(F.col(tid).alias("neighbor"), F.col(label).alias("_lab"))
    j = nb.join(lab, "neighbor")
    if weights == "distance":
        wt = F.when(F.col("distance") == 0, F.lit(1e300)).otherwise(1.0 / F.col("distance"))
    else:
        wt = F.lit(1.0)
    votes = j.groupBy(qid, "_lab").agg(F.sum(wt).alias("_w"))
    best = votes.withColumn("_r", F.row_number().over(Window.partitionBy(qid).orderBy(F.col("_w").desc(), "_lab"))) \
        .where(F.col("_r") == 1)
    return best.select(qid, F.col("_lab").alias("prediction"), F.col("_w").alias("votes"))


def knn_regress(train: DataFrame, query: DataFrame, k: int, label: str, weights: str = "uniform",
                vec: str = "vec", tid: str = "id", qid: str = "qid", pivots: int = 32) -> DataFrame:
    """M10 for values: the mean of the k nearest labels, or with ``weights='distance'`` the mean weighted by
    inverse distance, where exact matches alone count."""
    nb = knn(train, query, k, vec, tid, qid, pivots)
    near = nb.join(train.select(F.col(tid).alias("neighbor"), F.col(label).cast("double").alias("_lab")), "neighbor")
    if weights == "uniform":
        return near.groupBy(qid).agg(F.avg("_lab").alias("prediction"))
    exact = F.col("distance") == 0
    weighted = F.sum(F.col("_lab") / F.nullif(F.col("distance"), F.lit(0.0))) / F.sum(1 / F.nullif(F.col("distance"), F.lit(0.0)))
    return near.groupBy(qid).agg(F.coalesce(F.avg(F.when(exact, F.col("_lab"))), weighted).alias("prediction"))
