"""Exact substring deduplication over a compacted de Bruijn graph of word windows.

Edges are the windows of 35 consecutive words.  Each window is owned by the first smallest (by
hash) of its 8-word k-mers, so equal windows have equal owners, and consecutive windows with the
same owner occurrence form a nonbranching path, which its task writes as one row (about one for 14 words).  A path
that follows itself, as in a short line written many times over, is one row for all of them:

1. paths travel as (owner k-mer, hash of the path's words, hashes of the paths before and behind, source coordinates);
2. an owner seen once cannot carry a repeated window: a grouped count and a join drop it;
3. paths with equal words repeat as a whole: grouped counts with map-side combine find them and their neighbours;
4. a join of repeated paths with themselves links those that always follow each other.  All paths of such a nonbranching
   run have their first occurrence in one document, side by side, so the source coordinates number the runs, and each
   compacts to its first path and its length in words: a document has one row per passage;
5. where an owner has a path that occurs once beside others, paths diverge inside it: those are
   opened at their source coordinates, window by window, against one occurrence of each other
   path of that owner, and again counted by grouping.

Every step is a grouped count or an equi-join; a passage that a third of all documents share is
combined before it is shuffled and never gathered, and keys that hold many rows are joined apart (``_join_hot``).  Window and path
hashes have 64 bits and are compared within one owner
k-mer (another 64 bits) only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import Words, as_long, checked_broadcast, row_key, text_chunks
from tessera.session import cut_lineage, release

WINDOW = 35
OWNER = 8
#: keys that hold more than one in HOT of all rows are joined by broadcast: there are fewer than HOT of them
HOT = 100_000


def _owners(words: Words, window: int, owner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each path of consecutive windows with one owner occurrence: first and last window start
    (positions in the batch), the owner's position and its hash."""
    none = np.zeros(0, np.int64)
    if len(words.hash) < window:
        return none, none, none, np.zeros(0, np.uint64)
    grams = words.runs(np.arange(len(words.hash) - owner + 1), np.arange(owner, len(words.hash) + 1))
    span = window - owner + 1  # k-mers in a window
    best, width = np.arange(len(grams)), 1
    while width < span:  # first smallest of the next `width` k-mers, doubled
        step = min(width, span - width)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        width += step
    start = np.arange(len(best))
    inside = words.doc[start] == words.doc[start + window - 1]
    start, best = start[inside], best[inside]
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return start[at], start[np.append(at[1:], len(start)) - 1], best[at], grams[best[at]]


def paths(docs: DataFrame, window: int = WINDOW, owner: int = OWNER) -> DataFrame:
    """The paths of all documents: key (see ``row_key``), a and b (first and last window
    start, in words from the document's start), n (how often it stands there, each time right behind
    itself), last (b of the last of them), owner, path (hashes), prv and nxt (hashes of the
    other paths before and behind them in their document, 0 at the ends)."""

    def run(batches):
        for part, texts in text_chunks(batches):
            words = Words(texts)
            a, b, at, own = _owners(words, window, owner)
            hashes = words.runs(a, b + window) ^ (at - a).astype(np.uint64)
            doc = words.doc[a] if len(a) else a
            base = words.first[doc]
            prv, nxt = np.zeros_like(hashes), np.zeros_like(hashes)
            same = np.flatnonzero(doc[1:] == doc[:-1])
            nxt[same], prv[same + 1] = hashes[same + 1], hashes[same]
            new = np.ones(len(hashes), bool)
            new[same + 1] = (hashes[same + 1] != hashes[same]) | (own[same + 1] != own[same])
            at = np.flatnonzero(new)
            end = np.append(at[1:], len(hashes))[:len(at)] - 1
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc[at])), pa.array((a - base)[at].astype(np.int32)),
                 pa.array((b - base)[at].astype(np.int32)), pa.array((end - at + 1).astype(np.int32)),
                 pa.array((b - base)[end].astype(np.int32)), as_long(own[at]), as_long(hashes[at]), as_long(prv[at]), as_long(nxt[end])],
                names=["key", "a", "b", "n", "last", "owner", "path", "prv", "nxt"])

    return docs.select("key", "text").mapInArrow(
        run, "key long, a int, b int, n int, last int, owner long, path long, prv long, nxt long")


def unitigs(distinct: DataFrame, window: int = WINDOW) -> DataFrame:
    """The maximal nonbranching runs of repeated paths: owner and path of the first one, times, size (words).

    distinct: owner, path, times, at (first occurrence: key, a, b), and the least and greatest prv and nxt
    of each repeated path.  Two paths are linked if each occurrence of the one is followed by the other, and each of the other
    follows the one."""
    one_behind = distinct.where("least_nxt = most_nxt").select(
        F.col("path").alias("least_prv"), F.col("least_nxt").alias("path"), F.lit(1).alias("linked")).distinct()
    nodes = distinct.join(one_behind, ["least_prv", "path"], "left").select(
        "owner", "path", "times", F.col("at.key").alias("key"), F.col("at.a").alias("a"), F.col("at.b").alias("b"),
        F.when((F.col("linked") == 1) & (F.col("least_prv") == F.col("most_prv")), 0).otherwise(1).alias("first"))
    run = F.sum("first").over(Window.partitionBy("key").orderBy("a", "owner", "path"))
    return (nodes.withColumn("run", run).groupBy("key", "run")
            .agg(F.min(F.struct("a", "owner", "path", "times")).alias("head"), F.max("b").alias("b"))
            .select("head.owner", "head.path", "head.times", (F.col("b") - F.col("head.a") + window).alias("size")))


def _join_hot(rows: DataFrame, keys: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """``rows`` joined with ``keys`` (unique ``on``; ``times``: how many rows a key has).  Keys with more than one in HOT
    of ``total`` rows are fewer than HOT and broadcast, so none of them fills a task; the others are shuffled."""
    hot = keys.where(F.col(times) * HOT > total).drop(times)
    cold = keys.where(F.col(times) * HOT <= total).drop(times)
    met = rows.join(F.broadcast(hot), on)
    return met.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on).select(*met.columns))


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """Hashes of the single windows of opened paths; docs: key, text, opened (array of structs)."""

    def run(batches):
        for part, texts in text_chunks(batches):
            words = Words(texts)
            own = [(i, p["a"], p["b"], p["owner"], 2 if p["whole"] else 1)
                   for i, opened in enumerate(part.column(2).to_pylist()) for p in opened]
            doc, a, b, owner, weight = np.array(own, np.int64).reshape(-1, 5).T
            each = b - a + 1
            start = np.repeat(a - np.cumsum(each) + each, each) + np.arange(each.sum())
            at = start + words.first[np.repeat(doc, each)]
            key = np.asarray(part.column(0))[np.repeat(doc, each)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(start.astype(np.int32)), pa.array(np.repeat(owner, each)),
                 pa.array(np.repeat(weight, each)), as_long(words.runs(at, at + window))],
                names=["key", "a", "owner", "weight", "hash"])

    return docs.select("key", "text", "opened").mapInArrow(
        run, "key long, a int, owner long, weight long, hash long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, owner: int = OWNER) -> DataFrame:
    """key and spans (array of structs a, e: words a to e - 1 lie in repeated windows) for each row of ``docs``
    (key, text) that has any.  Overlapping spans of a row are joined, so they are few."""
    first = cut_lineage(paths(docs, window, owner))
    met = cut_lineage(first.groupBy("owner").agg(F.sum("n").alias("met")).where("met > 1"))
    total = first.agg(F.sum("n")).first()[0] or 0
    every = cut_lineage(_join_hot(first, met, ["owner"], "met", total))
    release(first, met)
    itself = F.when(F.col("n") > 1, F.col("path"))  # stands before and behind it as well
    distinct = cut_lineage(every.groupBy("owner", "path").agg(
        F.sum("n").alias("times"), F.min(F.struct("key", "a", "b")).alias("at"), F.min(F.least("prv", itself)).alias("least_prv"),
        F.max(F.greatest("prv", itself)).alias("most_prv"), F.min(F.least("nxt", itself)).alias("least_nxt"),
        F.max(F.greatest("nxt", itself)).alias("most_nxt")))
    heads = cut_lineage(unitigs(distinct.where("times > 1"), window))
    whole = _join_hot(every.select("key", "a", "last", "owner", "path"), heads, ["owner", "path"], "times", total).select(
        "key", "a", F.greatest(F.col("a") + F.col("size"), F.col("last") + window).alias("e"))
    forks = cut_lineage(distinct.groupBy("owner").agg(F.count("*").alias("n"), F.min("times").alias("least")).where(
        "n > 1 and least = 1").select("owner", "n"))
    opened = cut_lineage(_join_hot(distinct.select("owner", "path", "times", "at"), forks, ["owner"], "n", total).groupBy(
        F.col("at.key").alias("key")).agg(
        F.collect_list(F.struct(F.col("at.a").alias("a"), F.col("at.b").alias("b"), "owner",
                                (F.col("times") > 1).alias("whole"))).alias("opened")))
    release(forks)
    # repeated rows share a key: their paths repeat as a whole, one of them stands for all
    sources = docs.join(_small(opened, "opened"), "key")
    if _has_repeats(every):
        sources = sources.dropDuplicates(["key"])
    single = cut_lineage(_windows(sources, window))
    release(opened)
    again = single.groupBy("owner", "hash").agg(F.sum("weight").alias("w")).where("w > 1").select("owner", "hash")
    partial = single.where("weight = 1").join(again, ["owner", "hash"]).select(
        "key", "a", (F.col("a") + window).alias("e"))
    order = Window.partitionBy("key").orderBy("a", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (whole.unionByName(partial).withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1))
            .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("key", "run").agg(F.min("a").alias("a"), F.max("e").alias("e")))
    return runs.groupBy("key").agg(F.collect_list(F.struct("a", "e")).alias("spans"))


def _small(df: DataFrame, items: str) -> DataFrame:
    """The small side of a join with texts: broadcast below a checked size, else the hash side of a shuffled join,
    which sorts no texts."""
    marked = checked_broadcast(df, items=items)
    return marked if marked is not df else df.hint("shuffle_hash")


def _has_repeats(every: DataFrame) -> bool:
    """Whether any key has the same path twice, which only repeated rows do."""
    return not every.groupBy("key", "a").count().where("count > 1").limit(1).isEmpty()


def _keep(words: Words, i: int, spans) -> tuple[int, np.ndarray]:
    """Number of removed words of document i, and a mask of the kept ones."""
    n = int(words.count[i])
    change = np.zeros(n + 1, np.int64)
    for s in spans or ():
        change[s["a"]] += 1
        change[s["e"]] -= 1
    keep = np.cumsum(change[:n]) == 0
    return n - int(keep.sum()), keep


def deduplicate(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Remove each word of ``docs`` (doc_id, text) covered by a window of ``window`` words whose word
    sequence also starts anywhere else, the same document included.

    One row per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, with ``texts``,
    kept_text: the text itself where nothing is removed, else its kept runs in their own spacing, joined by
    one space.  Null and empty texts have no words; texts shorter than a window lose none; repeated rows
    are copies of each other and lose every window.  Other columns are ignored."""
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    spans = cut_lineage(repeated_spans(keyed.select("key", "text"), window))
    joined = keyed.join(_small(spans, "spans"), "key", "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts

    def run(batches):
        for part, values in text_chunks(batches):
            words = Words(values)
            raw = words.bytes.tobytes()
            n_removed, shas, kept_texts = [], [], []
            for i, spans_ in enumerate(part.column(2).to_pylist()):
                lo, hi = words.first[i], words.first[i + 1]
                own = raw[words.text_at[i]:words.text_at[i + 1] - 1]
                if not spans_:
                    n_removed.append(0)
                    shas.append(hashlib.sha256(b" ".join(own.split())).hexdigest())
                    kept_texts.append(own)
                    continue
                gone, keep = _keep(words, i, spans_)
                n_removed.append(gone)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], keep.view(np.int8), [0]))))
                runs = [raw[words.starts[lo + s]:words.ends[lo + e - 1]]
                        for s, e in zip(edge[0::2], edge[1::2], strict=True)]
                text = b" ".join(runs)
                shas.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                kept_texts.append(text)
            cols = [part.column(0), pa.array(words.count.astype(np.int64)), pa.array(n_removed, pa.int64()),
                    pa.array(shas, pa.string())]
            if texts:
                cols.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return joined.mapInArrow(run, schema)
