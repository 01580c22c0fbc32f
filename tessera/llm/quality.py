"""Quality scores by naive Bayes support vectors.

A document's features are indicators of the character n-grams of its outline: letters become a or
A, digits 0, white space a blank, every other sign stays, runs shrink to one sign; further indicators tell in which tenth the shares of repeated words,
repeated word runs and words per line fall.  Spark sums each feature's document counts by class over all training rows; the log ratio of the smoothed class shares scales
the indicators.  A linear hinge-loss model is fitted on them by dual coordinate descent, on a
bounded sample of training rows, and Platt's sigmoid, fitted on the other half of that sample's margins,
turns margins into scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import Words, checked_broadcast, text_chunks

BITS = 14
SAMPLE_ROWS = 20_000

_OUTLINE = np.arange(256, dtype=np.uint8)
_OUTLINE[97:123] = 97
_OUTLINE[128:] = 97
_OUTLINE[65:91] = 65
_OUTLINE[48:58] = 48
_OUTLINE[[9, 11, 12, 13]] = 32


def _bucket(share: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(share) * 10, 0, 10).astype(np.int64)


def indicators(texts: list[bytes], bits: int = BITS) -> np.ndarray:
    """Boolean matrix texts x 2^bits of hashed n-gram indicators; the last 64 columns hold the
    indicators of repetition and layout.  An empty text has those of layout alone."""
    words = Words(texts)
    n, width = len(texts), 1 << bits
    out = np.zeros((n, width), bool)
    signs = _OUTLINE[words.bytes]
    keep = np.ones(len(signs), bool)
    keep[1:] = signs[1:] != signs[:-1]
    keep[words.text_at[1:-1]] = True
    at = np.flatnonzero(keep)
    signs = signs[at].astype(np.uint64)
    doc = np.searchsorted(words.text_at, at, side="right") - 1
    code = np.zeros(len(signs), np.uint64)
    for k in range(1, 6):
        code = (code[:len(signs) - k + 1] << np.uint64(8)) | signs[k - 1:]
        same = doc[:len(code)] == doc[k - 1:]
        slot = (code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)
        slot = (slot >> np.uint64(32)) % np.uint64(width - 64)
        out[doc[:len(code)][same], slot[same].astype(np.int64)] = True
    tail = width - 64
    rows = np.arange(n)
    count = np.maximum(words.count, 1)

    def repeated(hashes, owner):
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        dup = np.zeros(len(h), bool)
        dup[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
        return np.bincount(o[dup], minlength=n)

    out[rows, tail + _bucket(repeated(words.hash, words.doc) / count)] = True
    grams, hashes = words.grams(3)
    out[rows, tail + 11 + _bucket(repeated(hashes, words.doc[grams]) / count)] = True
    beside = np.zeros(0, np.int64) if len(words.hash) < 2 else words.doc[1:][
        (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])]
    out[rows, tail + 22 + _bucket(np.bincount(beside, minlength=n) / count)] = True
    out[rows, tail + 33 + np.minimum(np.log2(count).astype(np.int64), 15)] = True
    return out


@dataclass
class Model:
    weights: np.ndarray  # with the log-count ratios multiplied in
    bias: float
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = x.astype(np.float32) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit_svm(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, passes: int = 12,
            seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss over indicators scaled by ``ratio``;
    rows hold the columns that are set, ``cost`` the bound of each row's dual variable."""
    w, b = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    scaled = [ratio[r] for r in rows]
    norm = np.array([s @ s + 1.0 for s in scaled])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ scaled[i] + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                moved = max(moved, abs(step) * norm[i] ** 0.5)
                alpha[i] = new
                w[rows[i]] += step * scaled[i]
                b += step
        if moved < 1e-3:
            break
    return w * ratio, b


def fit_sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, v = p - target, p * (1 - p) + 1e-9
        g = np.array([d @ margin + 1e-3 * (a - 1), d.sum()])
        h = np.array([[v @ margin**2 + 1e-3, v @ margin], [v @ margin, v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str, training: Column, sample_rows: int = SAMPLE_ROWS,
        bits: int = BITS) -> Model:
    """Learn ``label`` (0 or 1; other values are left out) of the rows of ``labels`` where ``training`` (a condition on doc_id) holds.

    Class counts of features cover every training row; the hinge-loss fit takes at most ``sample_rows`` of them, the
    first by a hash of the id.  Without training rows of both classes every score is the share of ones (1 if none)."""
    marked = (labels.where(training & F.col(label).isin(0, 1)).groupBy("doc_id")
              .agg(F.max(label).cast("int").alias("y")))
    used = docs.select("doc_id", "text").join(checked_broadcast(marked), "doc_id")

    def counted(batches):
        total = np.zeros((2, 1 << bits), np.int64)
        rows = np.zeros(2, np.int64)
        for part, texts in text_chunks(batches, rows=256):
            y = np.asarray(part.column(2))
            x = indicators(texts, bits)
            for c in (0, 1):
                total[c] += x[y == c].sum(0)
                rows[c] += (y == c).sum()
        for c in (0, 1):
            at = np.flatnonzero(total[c])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at) + 1, c, np.int32)), pa.array(np.append(at, -1).astype(np.int32)),
                 pa.array(np.append(total[c][at], rows[c]))], names=["y", "feature", "n"])

    counts = used.mapInArrow(counted, "y int, feature int, n long").groupBy("y", "feature").agg(
        F.sum("n").alias("n")).toPandas()  # at most 2 x (2^bits + 1) rows
    seen = np.zeros((2, (1 << bits) + 1))
    seen[counts["y"], counts["feature"]] = counts["n"]
    rows_of = seen[:, -1]
    if not rows_of.all():
        share = 1.0 if not rows_of.sum() else rows_of[1] / rows_of.sum()
        return Model(np.zeros(1 << bits, np.float32), 0.0, 1.0, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    p, q = (seen[1, :-1] + 1) / (rows_of[1] + 2), (seen[0, :-1] + 1) / (rows_of[0] + 2)
    ratio = np.log(p / q)
    ratio[seen[:, :-1].sum(0) == 0] = 0

    take = min(1.0, 1.2 * sample_rows / rows_of.sum())
    chosen = used.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(take * (1 << 30)))

    def packed(batches):
        for part, texts in text_chunks(batches, rows=256):
            x = indicators(texts, bits)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(
                [np.flatnonzero(r).astype("<u2").tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    sample = (chosen.mapInArrow(packed, "doc_id long, y int, x binary")
              .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample_rows).toPandas())
    y = np.where(sample["y"].to_numpy() == 1, 1.0, -1.0)
    rows = [np.frombuffer(r, "<u2").astype(np.int64) for r in sample["x"]]
    margins = np.zeros(len(y))
    half = np.arange(len(y)) % 2
    cost = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-6), 0.5 / max((y < 0).mean(), 1e-6)) * 0.1
    for side in (0, 1):  # margins for the sigmoid come from a fit on the other half
        use = np.flatnonzero(half != side)
        w, b = fit_svm([rows[i] for i in use], y[use], ratio, cost[use], 6)
        for i in np.flatnonzero(half == side):
            margins[i] = w[rows[i]].sum() + b
    slope, shift = fit_sigmoid(margins, y)
    w, b = fit_svm(rows, y, ratio, cost)
    return Model(w.astype(np.float32), float(b), slope, shift)


def score(docs: DataFrame, model: Model, threshold: float, bits: int = BITS) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``threshold`` on), one row per row of ``docs``.  Null
    texts score as empty ones; other columns are ignored."""

    def run(batches):
        for part, texts in text_chunks(batches, rows=256):
            s = model.score(indicators(texts, bits)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
