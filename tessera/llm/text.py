"""Vectorised word hashing over batches of documents, and helpers every operator of ``llm`` shares.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A batch of texts is laid out as
one byte array; word hashes and hashes of word runs come from prefix sums of a polynomial modulo
2^64 over random byte values, so the cost is a few numpy passes per byte whatever the word and
document lengths are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1024
BATCH_ROWS = 1000
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_RUN = np.uint64(0xD1342543DE82EF95)
_RUN_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, base: np.uint64, inverse: np.uint64, starts, ends) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, shifted back to a common origin."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    raw = (total[ends] - total[starts]) * _powers(inverse, len(values) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Words:
    """The words of a batch of texts: their hashes, and where each document's words lie."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        buf = b"\n".join(texts) + b"\n"
        if lower:
            buf = buf.lower()  # bytes.lower() changes A-Z alone
        self.bytes = np.frombuffer(buf, np.uint8)
        space = _SPACE[self.bytes]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.hash = _spans(_BYTE[self.bytes], _BASE, _BASE_INV, self.starts, self.ends)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(sizes)))
        #: document i has words first[i]:first[i + 1]
        self.first = np.searchsorted(self.starts, self.text_at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the word runs starts[i]:ends[i]."""
        return _spans(self.hash, _RUN, _RUN_INV, starts, ends)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions of all runs of k words inside one document, and their hashes."""
        if len(self.hash) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(len(self.hash) - k + 1)
        at = at[self.doc[at] == self.doc[at + k - 1]]
        return at, self.runs(at, at + k)


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES,
                rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into pieces of about ``size`` bytes of text (one text at least) and at most
    ``rows`` rows; a null text reads as empty."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives freed buffers back, unlike the pooling ones
    for whole in batches:
        at = whole.schema.get_field_index(column)
        for first in range(0, whole.num_rows, rows):
            batch = whole.slice(first, rows)
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(at).cast(pa.binary())), 0))
            piece = np.cumsum(lengths, dtype=np.int64) // size
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], len(lengths)], strict=True):
                part = batch.slice(lo, hi - lo)
                yield part, [v or b"" for v in part.column(at).cast(pa.binary()).to_pylist()]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` (narrow) rows, and at most five times as
    many elements in the array column ``items``; else unchanged, so that the join shuffles.  ``df`` should read a written
    table, as it is counted first."""
    size = F.sum(F.size(items)) if items else F.lit(0)
    n, elements = df.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= rows and (elements or 0) <= 5 * rows else df


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit key of a row by its id and text: equal for repeated rows only, null-safe."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ship(spark) -> None:
    """Give executors this package, once per application (an installed package needs no shipping), and have Spark
    hand texts to Python in batches that fit: the default of 10,000 rows is meant for narrow ones."""
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_tessera_shipped", False):
        return
    import os
    import tempfile
    import zipfile

    import tessera

    top = os.path.dirname(os.path.abspath(tessera.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    context.addPyFile(path)  # Spark's own file service hands it to the executors
    context._tessera_shipped = True
