"""Collocation mining: phrases of two to four words, counted by multikey three-way quicksort of suffix pointers.

A suffix pointer stands for a word position and the words that follow it in its piece of text, up to the greatest depth.
Pointers are routed over the cluster by their leading words, so all pointers that share a phrase meet in one
task; there a three-way quicksort on one word after the other splits them into less, equal and greater: the size of
an equal partition is the count of its phrase, and partitions smaller than the floor are abandoned unsorted.

1. Words are counted per language.  Pointers whose next word is infrequent go no further.
2. Pairs of frequent words are routed by both words and counted.
3. Pointers that begin with a frequent pair and go on with frequent pairs are routed by three words and
   counted to a depth of four.

Tasks combine equal pointers before they send them, so a passage that a third of all documents share is a few pointers
for each task.  The frequent words and pairs reach the tasks as bitmaps of bounded size: a bit set by chance only sends
pointers that are then abandoned, it changes no count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import _BASE, _BASE_INV, _BYTE, _spans, as_long, mix, text_chunks
from tessera.session import cut_lineage, release

FLOOR = 30
DEPTH = 4
FIRST = 2000
SHARE = 80
#: pointers that a task combines at once, and pointers in a task that sorts, on average
POINTERS = 1_000_000
#: log2 of the bits of a bitmap, at most (16 MB), and bits for each entry below that
MOST_BITS = 27
ROOM = 16
SALTS = 16
#: different words whose first hashes are equal; expected below one for 10^9 words
MOST_CLASHES = 10_000

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_APART = _BREAK.copy()
_APART[[32, 9]] = True
_BYTE2 = np.random.default_rng(77).integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
_PAIR = np.uint64(0xA24BAED4963EE407)


class Pointers:
    """The words of a batch of texts in order: where they lie, their ids, the pieces they belong to."""

    def __init__(self, texts: list[bytes], langs: list[str], bits: int, clashes: np.ndarray | None = None, second: bool = False):
        buf = (b"\n".join(texts) + b"\n").lower()  # bytes.lower() changes A-Z alone
        self.bytes = np.frombuffer(buf, np.uint8)
        apart = _APART[self.bytes]
        edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        if not apart[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc = np.searchsorted(np.cumsum(sizes), self.starts, side="right")
        names = {x: np.frombuffer(hashlib.blake2b(x.encode(), digest_size=8).digest(), np.uint64)[0] for x in set(langs)}
        self.lang = np.array([names[x] for x in langs], np.uint64)[self.doc]
        self.piece = np.cumsum(_BREAK[self.bytes])[self.starts]
        first = _spans(_BYTE[self.bytes], _BASE, _BASE_INV, self.starts, self.ends)
        self.id = np.maximum(mix(first + self.lang) >> np.uint64(64 - bits), np.uint64(1))
        if second or clashes is not None and len(clashes):
            other = _spans(_BYTE2[self.bytes], _BASE, _BASE_INV, self.starts, self.ends)
            self.id2 = np.maximum(mix(other + self.lang), np.uint64(1))
            if clashes is not None and len(clashes):
                self.id = np.where(np.isin(self.id, clashes), self.id2, self.id)

    def words(self, at: np.ndarray) -> pa.Array:
        """The words at these positions."""
        size = self.ends[at] - self.starts[at]
        offsets = np.concatenate(([0], np.cumsum(size)))
        data = self.bytes[np.arange(offsets[-1]) + np.repeat(self.starts[at] - offsets[:-1], size)]
        return pa.Array.from_buffers(pa.large_utf8(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _combine(columns: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one of each equal row, and their summed weights (rows that share a hash but are unlike may come in parts)."""
    key = columns[0]
    for c in columns[1:]:
        key = mix(key * _PAIR + c)
    order = np.argsort(key)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(weight[order], at) if len(at) else weight[:0]


def word_counts(docs: DataFrame, bits: int) -> DataFrame:
    """lang, word, id, id2 and n of each word per task; docs: lang, text."""

    def run(batches):
        held, size = [], 0

        def emit():
            id1, id2, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            at, total = _combine([id1, id2], n)
            words = pa.chunked_array([h[3] for h in held]).take(pa.array(at))
            langs = pa.chunked_array([h[4] for h in held]).take(pa.array(at))
            table = pa.table([langs, words.cast(pa.utf8()), as_long(id1[at]), as_long(id2[at]), pa.array(total)],
                             names=["lang", "word", "id", "id2", "n"])
            return table.to_batches(max_chunksize=100_000)

        for part, texts in text_chunks(batches):
            langs = part.column(0).to_pylist()
            p = Pointers(texts, langs, bits, second=True)
            at, n = _combine([p.id, p.id2], np.ones(len(p.id), np.int64))
            held.append((p.id[at], p.id2[at], n, p.words(at), part.column(0).take(pa.array(p.doc[at]))))
            size += len(at)
            if size >= POINTERS // 4:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()

    return docs.mapInArrow(run, "lang string, word string, id long, id2 long, n long")


def _bitmap(ids: DataFrame) -> tuple[int, np.ndarray]:
    """log2 of its bits, and a bitmap that has every value of ``h`` (its leading bits)."""
    entries = ids.count()
    log = min(MOST_BITS, max(16, (ROOM * max(entries, 1)).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - log)
    words = ids.groupBy(F.shiftright(slot, 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits"))
    out = np.zeros((1 << log) // 64, np.uint64)
    table = words.toArrow()  # at most 2^21 rows
    out[np.asarray(table["at"])] = np.asarray(table["bits"]).view(np.uint64)
    return log, out


def _has(bitmap: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    log, words = bitmap
    slot = h >> np.uint64(64 - log)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _PAIR + b)


def pointers(docs: DataFrame, bits: int, clashes: np.ndarray, words, pairs, buckets: int) -> DataFrame:
    """Combined suffix pointers by bucket of their leading words: pairs of frequent words (``pairs`` is None), else three and,
    where the last pair is frequent, four words (0 where the pointer ends).  words, pairs: broadcast bitmaps."""
    depth = 2 if pairs is None else DEPTH
    lead = min(depth, 3)

    def run(batches):
        held, size = [], 0

        def emit():
            columns = [np.concatenate([h[i] for h in held]) for i in range(depth)]
            at, n = _combine(columns, np.ones(len(columns[0]), np.int64))
            columns = [c[at] for c in columns]
            key = columns[0]
            for c in columns[1:lead]:
                key = pair_hash(key, c)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            own, first = np.unique(bucket[order], return_index=True)
            offsets = pa.array(np.append(first, len(order)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, as_long(c[order])) for c in columns]
            lists.append(pa.ListArray.from_arrays(offsets, pa.array(n[order])))
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *lists],
                                              names=["bucket", *(f"w{i}" for i in range(depth)), "n"])

        for part, texts in text_chunks(batches):
            p = Pointers(texts, part.column(0).to_pylist(), bits, clashes)
            good = _has(words.value, mix(p.id))
            met = good[:-1] & good[1:] & (p.piece[:-1] == p.piece[1:])
            if pairs is not None:
                at = np.flatnonzero(met)
                met[at] = _has(pairs.value, pair_hash(p.id[at], p.id[at + 1]))
                at = np.flatnonzero(met[:-1] & met[1:])
                last = np.append(met, [False, False])[at + 2]
                held.append((p.id[at], p.id[at + 1], p.id[at + 2], np.where(last, np.append(p.id, np.uint64(0))[at + 3], np.uint64(0))))
            else:
                at = np.flatnonzero(met)
                held.append((p.id[at], p.id[at + 1]))
            size += len(at)
            if size >= POINTERS:
                yield emit()
                held, size = [], 0
        if size:
            yield emit()

    columns = "".join(f"w{i} array<long>, " for i in range(depth))
    return docs.mapInArrow(run, f"bucket int, {columns}n array<long>")


def quicksort(columns: np.ndarray, weight: np.ndarray, floor: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of the pointers to the columns of ``columns`` (a row per depth; 0: no word).

    Returns for every prefix of ``least`` words or more that weighs ``floor`` or more: one of its pointers, its depth
    and its weight.  All partitions of a round are split together: each takes the word of its middle pointer as pivot; equal ones
    go on with the next word, and a partition that weighs less than the floor is abandoned."""
    most, n = columns.shape
    ptr, part = np.arange(n), np.zeros(n, np.int64)
    starts, depth = np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    found = [(np.zeros(0, np.int64),) * 3]
    while len(ptr):
        value = columns[depth[part], ptr]
        middle = (starts + np.append(starts[1:], len(ptr))) // 2
        pivot = value[middle][part]
        side = (value >= pivot).astype(np.int8) + (value > pivot)  # 0 less, 1 equal, 2 greater
        key = 3 * part + side
        size = np.bincount(key, minlength=3 * len(starts))
        to = np.cumsum(size) - size
        place = np.empty(len(ptr), np.int64)
        for s in range(3):
            own = side == s
            seen = np.cumsum(own)
            before = seen[starts] - own[starts]
            place[own] = to[key[own]] + seen[own] - 1 - before[part[own]]
        moved, words = np.empty_like(ptr), np.empty_like(value)
        moved[place], words[place] = ptr, value
        weights = np.zeros(len(size), np.int64)
        full = np.flatnonzero(size)
        weights[full] = np.add.reduceat(weight[moved], to[full])
        equal = np.arange(len(size)) % 3 == 1
        below = np.repeat(depth, 3)
        first = np.minimum(to, len(ptr) - 1)
        heavy = (weights >= floor) & (size > 0)
        phrase = heavy & equal & (words[first] != 0)
        out = phrase & (below + 1 >= least)
        found.append((moved[first[out]], below[out] + 1, weights[out]))
        stay = heavy & (~equal | (phrase & (below + 1 < most)))
        kept = np.repeat(stay, size)
        ptr = moved[kept]
        part = np.repeat(np.cumsum(stay) - 1, size)[kept]
        depth = (below + equal)[stay]
        starts = np.cumsum(size[stay]) - size[stay]
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def phrases(routed: DataFrame, depth: int, floor: int, buckets: int) -> DataFrame:
    """p (ids of the words), a (its count) and h (hash of a pair) of the phrases of the greatest routed depths."""
    least = min(depth, 3)

    def run(batches):
        held = []
        for b in batches:
            held.append([np.asarray(b.column(i).flatten()) for i in range(1, depth + 2)])
        if not held:
            return
        *columns, weight = (np.concatenate(c) for c in zip(*held, strict=True))
        columns = np.stack(columns).view(np.uint64)
        del held
        at, deep, a = quicksort(columns, weight, floor, least)
        offsets = np.concatenate(([0], np.cumsum(deep)))
        column = np.arange(offsets[-1]) - np.repeat(offsets[:-1], deep)
        ids = columns[column, np.repeat(at, deep)]
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), as_long(ids)), pa.array(a),
             as_long(pair_hash(columns[0][at], columns[1][at]))], names=["p", "a", "h"])

    return routed.repartition(buckets, "bucket").mapInArrow(run, "p array<long>, a long, h long")


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def mine(docs: DataFrame, floor: int = FLOOR, first: int = FIRST, share: int = SHARE, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``first`` collocations of two to four words; docs: lang, text.

    A-Z are lower-cased, texts are split at ``. , ; : ! ?`` and line ends into pieces and those at spaces and tabs into words;
    a phrase lies inside a piece.  Candidates occur ``floor`` times or more (a); cut after its first k words, a candidate
    scores floor(2000000 * a / (l + r)), l and r being the counts of both parts; its lowest cut counts (the first of equal
    ones).  A candidate inside a longer one that has ``share`` percent of its count is dropped.  Order: score and a descending, then
    the phrase by its bytes.  A null text is empty, a null language ``und``; repeated rows count as often as they stand; an
    empty table has no phrases.  Other columns are ignored.  ``bits`` of a word's first hash are used (tests lower it): words that
    clash in them are told apart by their second hash, and clashing in both is an error."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    spark = docs.sparkSession
    counted = cut_lineage(word_counts(docs, bits).groupBy("lang", "word", "id", "id2").agg(F.sum("n").alias("f")))
    clashes = np.sort(np.array([r["id"] for r in counted.groupBy("id").count().where("count > 1").select("id")
                                .limit(MOST_CLASHES + 1).collect()], np.int64).view(np.uint64))
    if len(clashes) > MOST_CLASHES:
        raise ValueError("too many words clash in the bits used of their hashes")
    if len(clashes):
        told = cut_lineage(counted.withColumn("id", F.when(F.col("id").isin(clashes.view(np.int64).tolist()), F.col("id2"))
                                              .otherwise(F.col("id"))))
        release(counted)
        counted = told
        if not counted.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("different words clash in both hashes")
    totals = cut_lineage(counted.groupBy("lang").agg(F.sum("f").alias("n")))
    words = cut_lineage(counted.where(F.col("f") >= floor).select("id", "lang", "word", "f"))
    release(counted)
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-tokens // (POINTERS // 2)))

    hashed = words.select("id").mapInArrow(_mixed, "h long")
    known = spark.sparkContext.broadcast(_bitmap(hashed))
    pairs = cut_lineage(phrases(pointers(docs, bits, clashes, known, None, buckets), 2, floor, buckets))
    paired = spark.sparkContext.broadcast(_bitmap(pairs.select("h")))
    longer = cut_lineage(phrases(pointers(docs, bits, clashes, known, paired, buckets), DEPTH, floor, buckets))
    candidates = pairs.unionByName(longer).select("p", "a")
    counts = candidates.select("p", F.col("a").alias("f")).unionByName(words.select(F.array("id").alias("p"), "f"))
    ranked = _ranked(_whole(_scored(candidates, counts), longer.select("p", "a"), share), words, first)
    out = ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return out


def _mixed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([as_long(mix(np.asarray(b.column(0)).view(np.uint64)))], names=["h"])


def _salted(df: DataFrame) -> DataFrame:
    """``df`` once for each salt, so that the rows that meet one of its keys are spread."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """p, a and the values of the cut that scores lowest."""
    cuts = F.explode(F.sequence(F.lit(1), F.size("p") - 1))
    parts = candidates.select("p", "a", cuts.alias("k"), F.pmod(F.xxhash64("p"), F.lit(SALTS)).alias("salt"))
    parts = parts.withColumns({"left": F.expr("slice(p, 1, k)"), "right": F.expr("slice(p, k + 1, size(p) - k)")})
    table = _salted(counts)
    both = parts.join(table.select(F.col("p").alias("left"), F.col("f").alias("l"), "salt"), ["left", "salt"]).join(
        table.select(F.col("p").alias("right"), F.col("f").alias("r"), "salt"), ["right", "salt"])
    score = F.call_function("div", _exact(F.col("a")) * F.lit(2_000_000), _exact(F.col("l")) + _exact(F.col("r")))
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return both.groupBy("p", "a").agg(lowest.alias("c")).select("p", "a", "c.score", "c.l", "c.r")


def _whole(scored: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """Without the phrases that lie inside a longer one of nearly their count."""
    inner = F.explode(F.expr("flatten(transform(sequence(2, size(p) - 1), s -> transform(sequence(1, size(p) - s + 1), i -> slice(p, i, s))))"))
    around = longer.select("a", inner.alias("p")).groupBy("p").agg(F.max("a").alias("around"))
    inside = _exact(F.col("around")) * 100 >= _exact(F.col("a")) * share
    return scored.join(around, "p", "left").where(~F.coalesce(inside, F.lit(False))).drop("around")


def _ranked(scored: DataFrame, words: DataFrame, first: int) -> DataFrame:
    """Each language's first phrases, in words."""
    spelt = scored.select("*", F.posexplode("p").alias("i", "id"), F.pmod(F.xxhash64("p"), F.lit(SALTS)).alias("salt")).join(
        _salted(words.select("id", "lang", "word")), ["id", "salt"]).groupBy("p").agg(
        *(F.first(c).alias(c) for c in ("lang", "a", "l", "r", "score")),
        F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words"))
    spelt = spelt.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "l", "r", "score",
                         F.pmod(F.xxhash64("p"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        spelt = spelt.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first)
    return spelt
