"""Best-fit packing of tokenised documents into sequences of a fixed length.

Lengths are integers up to the capacity, so the packing is decided on the histogram of lengths: a table of
at most ``capacity`` counts, whatever the number of documents.  Pieces above one third of the
capacity are matched first, greedily: the longest with the longest that still fits beside it, so at most two
share a sequence.  Smaller pieces then go, longest first, to the fullest sequence that has room
(best fit); a new sequence opens when none has.  Both work on whole runs of equal sequences, so the plan is a short list of
rules: "pieces of length s with ranks [from, to) go, k to a sequence, to the sequences from b on, at
offset o".

Spark counts lengths by slices of the pieces' ids, ranks pieces inside (slice, length) and adds the counts of the
slices before, so a length that a third of all documents have is never sorted in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import text_chunks
from tessera.session import cut_lineage

CAPACITY = 2048
SLICE_ROWS = 100_000

Rule = tuple[int, int, int, int, int, int]  # length, rank from, rank to, sequence, pieces in each, offset


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Rule], int]:
    """Rules that place ``counts[s]`` pieces of each length s, and the number of sequences."""
    left = {s: c for s, c in counts.items() if s > 0 and c > 0}
    used = dict.fromkeys(left, 0)
    rules: list[Rule] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    rooms: list[int] = []
    opened = 0

    def put(s: int, sequence: int, bins: int, each: int, offset: int) -> None:
        rules.append((s, used[s], used[s] + bins * each, sequence, each, offset))
        used[s] += bins * each
        left[s] -= bins * each

    def free(room: int, sequence: int, bins: int) -> None:
        if room > 0:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((sequence, bins))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        if not left[s]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - s) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            bins = left[s]
            put(s, opened, bins, 1, 0)
            free(capacity - s, opened, bins)
        else:
            t = large[at]
            bins = left[s] // 2 if t == s else min(left[s], left[t])
            if not bins:  # one piece left that would only fit beside its like: the next smaller one serves
                t = next((x for x in reversed(large[:at]) if left[x]), 0)
                bins = 1
            if t == s:
                put(s, opened, bins, 2, 0)
                free(capacity - 2 * s, opened, bins)
            elif t:
                put(s, opened, bins, 1, 0)
                put(t, opened, bins, 1, s)
                free(capacity - s - t, opened, bins)
            else:
                put(s, opened, 1, 1, 0)
                free(capacity - s, opened, 1)
        opened += bins
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                each = capacity // s
                bins = max(1, left[s] // each)
                sequence, room = opened, capacity
                opened += bins
            else:
                room = rooms[at]
                sequence, bins = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room]
                    rooms.pop(at)
                each = room // s
                if left[s] < bins * each:  # whole sequences as far as they go, the rest stays free
                    whole = left[s] // each
                    take = max(1, whole)
                    if bins > take:
                        free(room, sequence + take, bins - take)
                    bins = take
            each = min(each, left[s])
            put(s, sequence, bins, each, capacity - room)
            free(room - each * s, sequence, bins)
    return rules, opened


def tokenized(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], end_id: int = 0,
              capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        encode = encoder()
        for part, texts in text_chunks(batches):
            ids = part.column(0).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(ids, texts, strict=True):
                tokens = np.append(encode(text.decode()), end_id).astype("<u4")
                raw = tokens.tobytes()
                rest = len(tokens) % capacity
                cuts = [0, *range(rest or capacity, len(tokens) + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for col, value in zip(cols, (doc, i, a, b - a, zlib.crc32(raw[4 * a:4 * b])), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def bpe_encoder(json_path: str, ranks_path: str, pattern: str, end: tuple[str, int]):
    """Encoder factory for executors: the ids of the byte-level vocabulary in ``json_path``.  The same
    vocabulary as ranks gives the same ids about four times as fast through tiktoken; a text that its
    pattern engine refuses (it gives up on very long runs of white space) goes through tokenizers."""

    def make():
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={end[0]: end[1]})
        slow: list = []

        def encode(text: str) -> np.ndarray:
            if len(text) < 100_000 or " " * 1000 not in text:
                try:
                    return fast.encode_to_numpy(text, allowed_special="all")
                except BaseException as e:  # a panic of the pattern engine is no Exception
                    if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                        raise
            if not slow:
                slow.append(Tokenizer.from_file(json_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

        return encode

    return make


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length, any others).

    Lengths must be 1 to ``capacity``.  Ties are ranked by doc_id and piece; repeated rows and null ids
    are pieces like others.  An empty table gives an empty table."""
    pieces = cut_lineage(pieces)
    slices = max(1, pieces.count() // SLICE_ROWS) * 8
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    per_slice = cut_lineage(sliced.groupBy("length", "_slice").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rules, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per_slice.select("length", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece")
    ranked = (sliced.join(base, ["length", "_slice"])
              .withColumn("_rank", F.col("_base") + F.row_number().over(inside) - 1).drop("_slice", "_base"))
    table = np.array(sorted(rules), np.int64).reshape(-1, 6)
    start = table[:, 0] << 44 | table[:, 1]  # rules are few thousand rows, bounded by the capacity
    columns = pieces.columns
    schema = pieces.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def run(batches):
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            rank = batch["_rank"].to_numpy()
            length = batch["length"].to_numpy()
            rule = table[np.searchsorted(start, length << 44 | rank, side="right") - 1] if len(rank) else table[:0]
            nth = rank - rule[:, 1]
            out = batch.drop_columns(["_rank"]).select(columns)
            out = out.append_column("sequence_id", pa.array(rule[:, 3] + nth // rule[:, 4]))
            out = out.append_column("offset", pa.array(rule[:, 5] + nth % rule[:, 4] * rule[:, 0]))
            yield from out.to_batches()

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str, pattern: str,
                   end: tuple[str, int] = ("<|endoftext|>", 50256), end_id: int = 0,
                   capacity: int = CAPACITY) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into as few sequences of ``capacity`` tokens as best fit finds.

    A document is its ids and then ``end_id``; null text reads as empty (one token).  A document longer than ``capacity`` is cut into
    pieces of that length, the first of which may be shorter.  One row per piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset.  Repeated rows and rows without id are packed too; other columns are ignored."""
    return pack(tokenized(docs, bpe_encoder(json_path, ranks_path, pattern, end), end_id, capacity), capacity)
