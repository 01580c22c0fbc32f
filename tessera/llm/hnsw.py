"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph per
shard, stored as flat neighbour arrays, and shard results merged.

Equal vectors share a node (with the smallest ids that could ever be returned), nodes are dealt to shards of about
``SHARD_NODES`` by a hash, and every shard gets a graph in one task.  Inner products become
distances by one more coordinate that gives all vectors of a shard one length.  The graph is the one that
insertion in a hashed order gives: each node links to nodes inserted before it, chosen for diversity, and these link back.
Because a shard is small, the candidates of an insertion are exact and all of them come from one matrix product.

Every block of queries meets every shard in a task of its own; a beam search runs for the whole block at once.  Each shard
returns its best rows with exact double-precision scores, ranks over the shards' rows give the answer.  Measured recall
stands in the README; ``beam`` trades it for time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

SHARD_NODES = 4096
BLOCK_QUERIES = 1024
LINKS = 16
BEAM = 96


# -- graph -------------------------------------------------------------------------------------
def _diverse(dist: np.ndarray, cand: np.ndarray, to_node: np.ndarray, most: int) -> np.ndarray:
    """Choose up to ``most`` of each row's candidates (nearest first, -1 none): one nearer to a chosen one than to the
    node waits, and fills a free place only at the end."""
    n, c = cand.shape
    out = np.full((n, most), -1, np.int32)
    for lo in range(0, n, 512):
        ids, own = cand[lo:lo + 512], to_node[lo:lo + 512]
        between = dist[ids[:, :, None], ids[:, None, :]]
        valid = ids >= 0
        chosen = np.zeros(ids.shape, bool)
        for j in range(c):
            clear = (~chosen | (between[:, j, :] > own[:, j, None])).all(1)
            chosen[:, j] = valid[:, j] & clear & (chosen.sum(1) < most)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        picked = np.take_along_axis(ids, order, 1)
        out[lo:lo + 512, :picked.shape[1]] = np.where(np.take_along_axis(valid, order, 1), picked, -1)
    return out


def _layer(dist: np.ndarray, links: int, most: int) -> np.ndarray:
    """Neighbours of each node (rows; -1 fills) if nodes are inserted in their order."""
    n = len(dist)
    if n == 1:
        return np.full((1, most), -1, np.int32)
    width = min(4 * links, n - 1)
    earlier = np.where(np.tri(n, k=-1, dtype=bool), dist, np.inf)
    cand = np.argpartition(earlier, width - 1, axis=1)[:, :width] if width < n else np.argsort(earlier, axis=1)
    near = np.take_along_axis(earlier, cand, 1)
    order = np.argsort(near, axis=1, kind="stable")
    cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
    cand = np.where(np.isfinite(near), cand, -1)
    ahead = _diverse(dist, cand, near, links)
    a = np.repeat(np.arange(n), ahead.shape[1])
    b = ahead.ravel()
    a, b = a[b >= 0], b[b >= 0]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((dist[src, dst], src))
    src, dst = src[order], dst[order]
    first = np.searchsorted(src, np.arange(n))
    place = np.arange(len(src)) - first[src]
    # nearest links, and of a node that many later ones chose a spread of the farther ones
    size = np.bincount(src, minlength=n)
    room = 3 * most
    step = np.maximum(1, (size[src] - most) / (room - most))
    slot = np.where(place < most, place, most + ((place - most) / step).astype(np.int64))
    both = np.full((n, room), -1, np.int64)
    keep = slot < room
    both[src[keep], slot[keep]] = dst[keep]
    far = np.where(both >= 0, dist[np.arange(n)[:, None], both], np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    return _diverse(dist, np.take_along_axis(both, order, 1), np.take_along_axis(far, order, 1), most)


def build_graph(vectors: np.ndarray, order: np.ndarray, links: int = LINKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers, the lowest first: the nodes of the layer and their neighbours (positions in ``vectors``)."""
    norms = (vectors * vectors).sum(1)
    lift = np.sqrt(np.maximum(norms.max() - norms, 0))
    x = np.concatenate([vectors, lift[:, None]], 1)
    scale = np.abs(x).max() or 1.0
    x = (x / scale).astype(np.float32)
    square = (x * x).sum(1)
    rank = np.argsort(order, kind="stable")
    layers, nodes = [], rank
    while True:
        own = x[nodes]
        dist = np.maximum(square[nodes][:, None] + square[nodes][None, :] - 2 * (own @ own.T), 0)
        np.fill_diagonal(dist, np.inf)
        near = _layer(dist, links, 2 * links if not layers else links)
        layers.append((nodes.astype(np.int32), np.where(near >= 0, nodes[near], -1).astype(np.int32)))
        if len(nodes) <= links:
            return layers
        nodes = nodes[:max(1, len(nodes) // links)]  # the first inserted reach the higher layers


def _beam(vectors, near, queries, seeds, width) -> np.ndarray:
    """The ``width`` best nodes found for each query (rows of positions, best first, -1 fills)."""
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # what -1 points at
    rows = np.arange(q)[:, None]
    seen[rows, seeds] = True
    ids = seeds
    sims = np.where(ids >= 0, np.einsum("qsd,qd->qs", vectors[ids], queries), -np.inf)
    done = ids < 0
    while True:
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims, done = (np.take_along_axis(v, order, 1) for v in (ids, sims, done))
        act = np.flatnonzero(~done.all(1))
        if not len(act):
            return ids
        step = np.argsort(done[act], axis=1, kind="stable")[:, :4]  # the best four not yet expanded
        fresh = ~np.take_along_axis(done[act], step, 1)
        nodes = np.where(fresh, np.take_along_axis(ids[act], step, 1), -1)
        done[act[:, None], step] = True
        nxt = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(act), -1)
        nxt = np.sort(nxt, axis=1)
        nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = -1
        nxt[seen[act[:, None], nxt]] = -1
        seen[act[:, None], nxt] = True
        found = np.where(nxt >= 0, np.einsum("qsd,qd->qs", vectors[nxt], queries[act]), -np.inf)
        more_ids = np.full((q, nxt.shape[1]), -1, ids.dtype)
        more_sims = np.full((q, nxt.shape[1]), -np.inf, sims.dtype)
        more_ids[act], more_sims[act] = nxt, found
        ids, sims = np.concatenate([ids, more_ids], 1), np.concatenate([sims, more_sims], 1)
        done = np.concatenate([done, more_ids < 0], 1)


def search_graph(vectors: np.ndarray, layers, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Positions of about the ``beam`` vectors of largest inner product with each query."""
    small = (vectors / (np.abs(vectors).max() or 1.0)).astype(np.float32)
    q = (queries / np.maximum(np.abs(queries).max(1, keepdims=True), 1e-300)).astype(np.float32)
    seeds = np.broadcast_to(layers[-1][0].astype(np.int64), (len(q), len(layers[-1][0]))).copy()
    for level in range(len(layers) - 1, -1, -1):
        nodes, near = layers[level]
        table = np.full((len(vectors), near.shape[1]), -1, np.int64)
        table[nodes] = near
        seeds = np.concatenate([_beam(small, table, q[lo:lo + 256], seeds[lo:lo + 256], beam if level == 0 else 24)
                                for lo in range(0, len(q), 256)])
    return seeds


# -- Spark -------------------------------------------------------------------------------------
def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (double) of the rows that take part: not null, not zero, all components finite."""
    return (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
            .where("vec_id is not null and vector is not null")
            .where(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
                   & F.exists("vector", lambda v: v != 0)))


def nodes(vectors: DataFrame, ids: int) -> DataFrame:
    """Distinct vectors with their ``ids`` smallest distinct vec_ids.  Equal vectors are combined in each
    batch, then over salted groups, so that copies are never gathered in one place."""

    def combine(batches):
        for batch in batches:
            frame = batch.to_pandas()
            key = [np.asarray(v, np.float64) + 0.0 for v in frame["vector"]]
            frame["key"] = [v.tobytes() for v in key]
            best = frame.drop_duplicates(["key", "vec_id"]).sort_values("vec_id").groupby("key", sort=False)["vec_id"].apply(
                lambda s: s.to_numpy()[:ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.frombuffer(k, np.float64) for k in best.index], pa.list_(pa.float64())),
                 pa.array(list(best), pa.list_(pa.int64()))], names=["vector", "ids"])

    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids).alias("ids")
    part = vectors.mapInArrow(combine, "vector array<double>, ids array<long>")
    return part.groupBy("vector", F.pmod(F.col("ids")[0], F.lit(64)).alias("salt")).agg(merged).groupBy("vector").agg(merged)


def index(distinct: DataFrame, links: int = LINKS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per shard: shard, dim, and its nodes and graph as flat binary arrays."""
    shards = max(1, -(-distinct.count() // shard_nodes))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["vector"].to_numpy()).astype(np.float64)
        layers = build_graph(x, frame["order"].to_numpy(), links)
        ids = [np.asarray(i, np.int64) for i in frame["ids"]]
        sizes = [(len(n), m.shape[1]) for n, m in layers]
        return pd.DataFrame({
            "shard": [frame["shard"].iloc[0]], "dim": [x.shape[1]], "vectors": [x.tobytes()],
            "ids": [np.concatenate(ids).tobytes()], "id_counts": [np.array([len(i) for i in ids], np.int32).tobytes()],
            "layer_sizes": [np.array(sizes, np.int32).tobytes()],
            "neighbours": [b"".join(n.tobytes() + m.tobytes() for n, m in layers)]})

    dealt = distinct.select(F.struct(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("no"))
                            .alias("s"), "vector", "ids", F.xxhash64("vector", F.lit(5)).alias("order"))
    dealt = dealt.select(F.concat_ws("/", "s.dim", "s.no").alias("shard"), "vector", "ids", "order")
    return dealt.groupBy("shard").applyInPandas(
        build, "shard string, dim int, vectors binary, ids binary, id_counts binary, layer_sizes binary, neighbours binary")


def _layers(row):
    flat = np.frombuffer(row["neighbours"], np.int32)
    at, out = 0, []
    for n, m in np.frombuffer(row["layer_sizes"], np.int32).reshape(-1, 2):
        out.append((flat[at:at + n], flat[at + n:at + n + n * m].reshape(n, m)))
        at += n + n * m
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows nearest to each row of ``vectors`` (vec_id, embedding) where ``is_query`` (a condition on vec_id)
    holds, itself left out; nearest means the largest inner product, ties go to the smaller vec_id.

    Null or zero vectors, and those with null or non-finite components, take no part; vectors of unlike length
    are never compared; repeated rows count once; fewer candidates than k give fewer rows.  Other
    columns are ignored."""
    rows = cut_lineage(usable(vectors))
    distinct = cut_lineage(nodes(rows, k + 1))
    graphs = cut_lineage(index(distinct))
    asked = cut_lineage(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct())
    wanted = cut_lineage(asked.select("vector").distinct().withColumn("query", F.xxhash64("vector"))
                         .withColumn("dim", F.size("vector")))
    blocks = max(1, -(-wanted.count() // BLOCK_QUERIES))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("vector", F.lit(3)), F.lit(blocks)).cast("int"))
    left = wanted.join(graphs.select(F.col("shard").alias("home"), "dim"), "dim").select("home", "block", "query", "vector")
    right = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "vector": [], "vec_id": [], "score": []}
        if len(asked) and len(graph):
            row = graph.iloc[0]
            x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            ids = np.frombuffer(row["ids"], np.int64)
            end = np.cumsum(np.frombuffer(row["id_counts"], np.int32))
            q = np.stack(asked["vector"].to_numpy()).astype(np.float64)
            found = search_graph(x, _layers(row), q, beam)
            for i, (own, hits) in enumerate(zip(q, found, strict=True)):
                hits = hits[hits >= 0]
                score = x[hits] @ own
                top = np.argsort(-score, kind="stable")
                if len(top) > k + 1:
                    top = top[score[top] >= score[top[k]]]
                pick = np.concatenate([ids[end[h - 1] if h else 0:end[h]] for h in hits[top]])
                each = np.repeat(score[top], [end[h] - (end[h - 1] if h else 0) for h in hits[top]])
                best = np.lexsort((pick, -each))[:k + 1]
                out["query"].append(np.full(len(best), asked["query"].iloc[i]))
                out["vec_id"].append(pick[best])
                out["score"].append(each[best])
                out["vector"] += [own] * len(best)
        cols = {c: np.concatenate(out[c]) if out[c] else [] for c in ("query", "vec_id", "score")}
        return pd.DataFrame({"query": cols["query"], "vector": out["vector"], "vec_id": cols["vec_id"], "score": cols["score"]})

    hits = left.groupBy("home", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        search, "query long, vector array<double>, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    hits = (hits.withColumn("n", F.row_number().over(Window.partitionBy("query", "vector").orderBy(*order)))
            .where(F.col("n") <= k + 1).drop("n"))
    hits = asked.withColumn("query", F.xxhash64("vector")).join(hits, ["query", "vector"]).where("query_id <> vec_id")
    return (hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int"))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
