"""Exact top-k by inner product without scoring all users by all items.

Items stand in buckets by falling norm, each bucket twice as large as the one before.  Users meet the buckets in turn, a
block of items at a time as one matrix product per batch of users; a user whose k-th score is above what any later item can
reach (its norm times the largest norm left) is finished, and only open users go on.  Inside a task users stop the same way.
Items that a user has seen stand beside it as their places in the bucket, and items of the user's own group are known by
it: both are passed over where they are scored, so that no more than k rows a user leave a task.  The result equals that of
scoring every pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranking import cumulative
from tessera.session import cut_lineage, release

FIRST = 1_024
BLOCK = 16_384
#: users and items of one matrix product; a call that asks for smaller blocks gets them in products of this width
ROWS = 256
COLUMNS = 4_096
#: numbers of a part of a bucket that tasks hold
HELD = 8_000_000
#: relative room for rounding in the bound
SLACK = 1e-9


def _norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def _best(score: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """The first k of a user's scores, larger first, then by place."""
    if len(score) > k:
        least = np.partition(score, -k)[-k]
        own = np.flatnonzero(score >= least)
    else:
        own = np.arange(len(score))
    return own[np.lexsort((pos[own], -score[own]))[:k]]


def _scorer(held, start: int, k: int, block: int):
    """The first k unseen items of a part of a bucket for each user, as far as they pass its floor: user, pos, score.

    ``held``: vectors, norms and groups of the items from place ``start`` on.  A row has the user, x, its norm, the floor (its
    k-th score so far: items of later places must pass it), the rising places it has seen and its group."""
    def run(batches):
        y, norm, group = held.value
        codes = {g: c for c, g in enumerate(dict.fromkeys(g for g in group if g is not None))} if group is not None else {}
        theirs = np.array([codes.get(g, -1) for g in group], np.int64) if group is not None else None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                own, floor = np.array(part.column(2)), np.array(part.column(3))
                seen = part.column(4)
                ends = np.concatenate(([0], np.cumsum(np.asarray(seen.value_lengths().fill_null(0)))))
                seen_at = np.asarray(seen.flatten()) - start
                seen_row = np.repeat(np.arange(len(x)), np.diff(ends))
                order = np.argsort(seen_at, kind="stable")
                seen_at, seen_row = seen_at[order], seen_row[order]
                mine = np.array([codes.get(g, -2) for g in part.column(5).to_pylist()], np.int64) if theirs is not None else None
                scores = [np.zeros(0)] * len(x)
                places = [np.zeros(0, np.int64)] * len(x)
                for at in range(0, len(y), block):
                    to = min(at + block, len(y))
                    bound = own * norm[at]
                    go = np.flatnonzero(~(bound + np.abs(bound) * SLACK < floor))
                    if not len(go):
                        break
                    s = x[go] @ y[at:to].T
                    new = np.full(len(x), -1)
                    new[go] = np.arange(len(go))
                    a, b = np.searchsorted(seen_at, (at, to))
                    rows, columns = new[seen_row[a:b]], seen_at[a:b] - at
                    able = s > floor[go, None]
                    able |= floor[go, None] == -np.inf
                    able[rows[rows >= 0], columns[rows >= 0]] = False
                    if theirs is not None:
                        able &= mine[go, None] != theirs[None, at:to]
                    for i in np.flatnonzero(able.any(axis=1)):
                        u = go[i]
                        found = np.flatnonzero(able[i])
                        score = np.concatenate((scores[u], s[i, found]))
                        pos = np.concatenate((places[u], found + (start + at)))
                        first = _best(score, pos, k)
                        scores[u], places[u] = score[first], pos[first]
                        if len(first) == k:
                            floor[u] = max(floor[u], scores[u][-1])
                rows = np.repeat(np.arange(len(x)), [len(p) for p in places])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.concatenate(places)),
                                                  pa.array(np.concatenate(scores))], names=["user", "pos", "score"])
    return run


def top_items(users: DataFrame, items: DataFrame, k: int, seen: DataFrame | None = None, first: int = FIRST,
              block: int = BLOCK, apart: str | None = None) -> tuple[DataFrame, dict]:
    """(user, item, score, rank from 1) of each user's k items of largest inner product that are not in ``seen`` (user, item), and
    what it took: items, users, buckets met and pairs scored (as many, at most).

    users: user, x; items: item, x (arrays of finite numbers of one width; one row each).  ``apart``: a column of both; items that
    have the user's value of it count as seen (a null is no value).  Equal scores are ranked by larger
    item norm, then by item.  A user with fewer than k unseen items gets them all; one without gets no row."""
    spark = users.sparkSession
    x = F.col("x").cast("array<double>")
    group = F.col(apart).alias("of") if apart else F.lit(None).cast("int").alias("of")
    one = items.select("item", x.alias("x"), group).withColumns({"norm": _norm(F.col("x")), "one": F.lit(1).cast("long")})
    ranked = cut_lineage(cumulative(one, [], [F.desc("norm"), F.asc("item")], weight="one", before="pos").select("item", "x", "norm", "pos", "of"))
    about = ranked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    n_items, width = about["n"], max(1, about["width"] or 1)
    met = {"items": n_items, "users": 0, "buckets": 0, "pairs": 0}
    kind = dict(users.dtypes)["user"]
    best = spark.createDataFrame([], f"user {kind}, pos long, score double")
    open_ = users.select("user", x.alias("x"), _norm(x).alias("own"), group, F.lit(0).cast("long").alias("found"),
                         F.lit(float("-inf")).alias("floor"))
    open_ = cut_lineage(open_)
    met["users"] = open_.count()
    places = None
    if seen is not None:
        places = cut_lineage(seen.select("user", "item").join(ranked.select("item", "pos"), "item").select("user", "pos"))
    none = F.array().cast("array<long>")
    most = max(1, HELD // width)
    start, size = 0, first
    while start < n_items and met["users"] and k > 0:
        end = min(start + size, n_items)
        left = open_.count()
        if not left:
            break
        met["buckets"] += 1
        met["pairs"] += left * (end - start)
        found = best
        for lo in range(start, end, most):
            inside = (F.col("pos") >= lo) & (F.col("pos") < min(lo + most, end))
            rows = ranked.where(inside).orderBy("pos").select("x", "norm", "of").toArrow()  # at most ``HELD`` numbers
            held = spark.sparkContext.broadcast((
                np.asarray(rows.column(0).combine_chunks().flatten(), float).reshape(rows.num_rows, -1), np.asarray(rows.column(1)),
                rows.column(2).to_pylist() if apart else None))
            asked = open_.withColumn("places", none)
            if places is not None:
                by_user = places.where(inside).groupBy("user").agg(F.collect_list("pos").alias("places"))
                asked = open_.join(by_user, "user", "left").withColumn("places", F.coalesce("places", none))
            asked = asked.select("user", "x", "own", "floor", "places", "of")
            found = found.unionByName(asked.mapInArrow(_scorer(held, lo, k, max(block, COLUMNS)), f"user {kind}, pos long, score double"))
        rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "pos"))
        new = cut_lineage(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        release(best)
        best = new
        top = ranked.where(F.col("pos") >= end).agg(F.max("norm")).first()[0]
        if top is not None:
            kth = best.groupBy("user").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least"))
            bound = F.col("own") * top
            bound = bound + F.abs(bound) * SLACK
            full = F.col("found") >= k
            next_ = open_.drop("found", "floor").join(kth, "user", "left").select(
                "user", "x", "own", "of", F.coalesce("found", F.lit(0)).alias("found"),
                F.when(full, F.col("least")).otherwise(float("-inf")).alias("floor"))
            next_ = cut_lineage(next_.where((F.col("found") < k) | (bound >= F.col("floor"))))
            release(open_)
            open_ = next_
        start, size = end, 2 * size
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "pos"))
    out = best.withColumn("rank", rank.cast("long")).join(ranked.select("pos", "item"), "pos")
    return out.select("user", "item", "score", "rank"), met
