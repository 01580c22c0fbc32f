"""Toxicity scores by weak supervision.

1. Terms (words, and word beginnings as patterns) are mined from a bounded sample of labelled
   training rows: those that mark toxic rows strongly and stand in many different surroundings there, so
   that copies of one toxic document do not make their own words terms.
2. The terms are dealt to many voters: word lexicons, pattern lexicons, and two patterns of how
   terms occur (several different ones; densely).
3. A generative label model estimates how often each voter votes for toxic and for clean documents by EM over the counts of
   vote patterns of all training documents (at most 2^voters rows), then the voters' remaining
   correlations within a class; a voter's evidence is divided by its share of correlated votes.
4. A logistic model over the terms is trained on the posterior labels of the sample's documents; a
   sigmoid fitted on the sample's own labels calibrates it.

Scoring needs the model (a few thousand terms) and one pass over the texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality import fit_sigmoid
from tessera.llm.text import checked_broadcast, text_chunks
from tessera.session import cut_lineage

SAMPLE_ROWS = 20_000
TERMS = 2_000
LEXICONS, PATTERNS = 8, 6
VOTERS = LEXICONS + PATTERNS + 2
PREFIXES = (4, 5, 6)
CACHE_WORDS = 300_000

_WORD = regex.compile(r"\w+")


def _words(text: bytes) -> list[str]:
    return _WORD.findall(text.decode().lower())


def word_terms(word: str) -> list[str]:
    """The word itself (marked by a trailing blank) and its beginnings."""
    return [word + " ", *(word[:k] for k in PREFIXES if len(word) > k)]


class Finder:
    """Finds the terms of a text; remembers words."""

    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: bytes) -> tuple[set[int], int, int]:
        """Terms of the text, how often one of its words has a term, its number of words."""
        words = _words(text)
        found, times = set(), 0
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w, n in Counter(words).items():
            hit = known.get(w)
            if hit is None:
                hit = known[w] = tuple(self.index[t] for t in word_terms(w) if t in self.index)
            if hit:
                found.update(hit)
                times += n
        return found, times, len(words)


@dataclass
class Model:
    terms: list[str]
    voter: np.ndarray  # of each term
    weights: np.ndarray
    bias: float

    def votes(self, found: set[int], times: int, words: int) -> int:
        """Bit j is set if voter j votes for toxic."""
        bits = 0
        for i in found:
            bits |= 1 << int(self.voter[i])
        whole = sum(1 for i in found if self.terms[i].endswith(" "))
        bits |= (whole >= 2) << (VOTERS - 2)
        return bits | ((times * 200 >= words and times > 0) << (VOTERS - 1))

    def score(self, found: set[int]) -> float:
        z = self.bias + sum(self.weights[i] for i in found)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def label_model(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, passes: int = 60) -> np.ndarray:
    """P(toxic | votes) of each pattern (bit masks).  ``start``: first guess of the same, which
    anchors the two classes."""
    votes = (patterns[:, None] >> np.arange(VOTERS) & 1).astype(float)
    post = start.astype(float)
    total = counts.sum()

    def rates(post):
        on, off = counts * post, counts * (1 - post)
        a = (on @ votes + 0.5) / (on.sum() + 1)
        b = (off @ votes + 0.05) / (off.sum() + 1)
        return a, np.minimum(b, a * 0.5), np.clip(on.sum() / total, 1e-4, 0.5)

    def posterior(a, b, prior, share):
        odds = votes @ (share * np.log(a / b)) + (1 - votes) @ (share * np.log((1 - a) / (1 - b)))
        return 1 / (1 + np.exp(-np.clip(odds + np.log(prior / (1 - prior)), -30, 30)))

    share = np.ones(VOTERS)
    for step in range(passes):
        a, b, prior = rates(post)
        if step == passes // 2:  # correlations that the classes do not explain
            correlated = np.zeros((VOTERS, VOTERS))
            for weight, rate in ((counts * post, a), (counts * (1 - post), b)):
                centred = votes - rate
                cov = (centred * weight[:, None]).T @ centred / max(weight.sum(), 1e-9)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                correlated = np.maximum(correlated, np.abs(cov / sd[:, None] / sd))
            np.fill_diagonal(correlated, 0)
            share = 1 / (1 + np.where(correlated > 0.1, correlated, 0).sum(1))
        new = posterior(a, b, prior, share)
        if step > passes // 2 and np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def _fit_logistic(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, width: int,
                  penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps with Adam over sparse rows."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    weight = weight / weight.sum()
    w = np.zeros(width + 1)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, 401):
        z = w[-1] + np.bincount(at, w[col], minlength=len(rows))
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        g = np.append(np.bincount(col, d[at], minlength=width) + penalty * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str, training: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn ``label`` (0 or 1) of the rows of ``labels`` where ``training`` (a condition on doc_id)
    holds.  Terms and weights come from at most ``sample_rows`` of them, half of each class, the first by
    a hash of the id; the label model counts the votes of every training document, labelled
    or not.  Without toxic training rows every score is below 1/2."""
    marked = labels.where(training & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(13))
    half = sample_rows // 2
    picked = None
    for y in (0, 1):
        one = marked.where(F.col("y") == y).orderBy(order, "doc_id").limit(half)
        picked = one if picked is None else picked.unionByName(one)
    sample = docs.select("doc_id", "text").join(checked_broadcast(picked), "doc_id")
    rows_of = [max(1, min(half, share.get(y, 0))) for y in (0, 1)]

    def term_counts(batches):
        counts = [Counter(), Counter()]
        for part, texts in text_chunks(batches):
            for text, y in zip(texts, part.column(2).to_pylist(), strict=True):
                counts[y].update({t for w in set(_words(text)) for t in word_terms(w)})
        for y in (0, 1):
            items = list(counts[y].items())
            for lo in range(0, len(items), 50_000):
                cut = items[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in cut], pa.string()), pa.array([y] * len(cut), pa.int32()),
                                                  pa.array([n for _, n in cut], pa.int64())], names=["term", "y", "n"])

    tox, clean = (F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)) for y in (1, 0))
    tallied = cut_lineage(sample.mapInArrow(term_counts, "term string, y int, n long").groupBy("term")
                          .agg(tox.alias("tox"), clean.alias("clean")).where("tox > 1"))
    # a term counts if its share of toxic rows would be a surprise for any of that many terms
    chance = rows_of[1] / sum(rows_of)
    surprise = float(np.log(tallied.count() + 10))
    part = F.col("tox") / (F.col("tox") + F.col("clean"))
    evidence = (F.col("tox") * F.log(part / chance)
                + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - part) / (1 - chance))).otherwise(0.0))
    candidates = {r["term"]: (r["tox"], r["clean"]) for r in
                  tallied.where(part > 0.5 + chance / 2).orderBy(F.desc(evidence), "term").limit(10 * TERMS).collect()}

    def surroundings(batches):
        index = set(candidates)
        for part, texts in text_chunks(batches):
            met = set()
            for text in texts:
                words = _words(text)
                for before, w in zip(["", *words], words, strict=False):
                    met.update((t, before) for t in word_terms(w) if t in index)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in met], pa.string()), pa.array([b for _, b in met], pa.string())],
                                             names=["term", "before"])

    varied = (sample.where("y = 1").mapInArrow(surroundings, "term string, before string").distinct()
              .groupBy("term").count().collect())  # at most 10 * TERMS
    strength = {}
    for r in varied:
        tox, clean = candidates[r["term"]]
        rate = tox / (tox + clean)
        strength[r["term"]] = r["count"] * np.log(rate / chance) + (clean and clean * np.log((1 - rate) / (1 - chance)))
    terms = sorted((t for t in strength if strength[t] > surprise), key=lambda t: (-strength[t], t))[:TERMS]
    voter = np.zeros(len(terms), np.int64)
    for first, voters, own in ((0, LEXICONS, [i for i, t in enumerate(terms) if t.endswith(" ")]),
                               (LEXICONS, PATTERNS, [i for i, t in enumerate(terms) if not t.endswith(" ")])):
        for n, i in enumerate(own):  # bands of like strength, so that a voter's accuracy is its terms'
            voter[i] = first + n * voters // len(own)
    model = Model(terms, voter, np.zeros(len(terms)), -10.0)
    if not terms:
        return model

    def vote(batches):
        finder, counts = Finder(terms), Counter()
        for _, texts in text_chunks(batches):
            counts.update(model.votes(*finder(t)) for t in texts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                                         names=["votes", "n"])

    ballots = (docs.where(training).select("doc_id", "text").mapInArrow(vote, "votes long, n long").groupBy("votes")
               .agg(F.sum("n").alias("n")).orderBy("votes").toPandas())  # at most 2^VOTERS rows
    patterns, counts = ballots["votes"].to_numpy(), ballots["n"].to_numpy()
    post = dict(zip(patterns.tolist(), label_model(patterns, counts, (patterns > 0) * 0.9 + 0.001).tolist(), strict=True))

    def features(batches):
        finder = Finder(terms)
        for part, texts in text_chunks(batches):
            found = [finder(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([model.votes(*f) for f in found], pa.int64()),
                 pa.array([np.array(sorted(f[0]), "<u2").tobytes() for f in found], pa.binary())], names=["doc_id", "y", "votes", "x"])

    got = sample.mapInArrow(features, "doc_id long, y int, votes long, x binary").orderBy("doc_id").toPandas()
    target = np.array([post.get(v, 0.0) for v in got["votes"]])
    weight = np.where(got["y"] == 1, share.get(1, 0) / rows_of[1], share.get(0, 0) / rows_of[0])
    rows = [np.frombuffer(x, "<u2").astype(np.int64) for x in got["x"]]
    weights, bias = _fit_logistic(rows, target, weight, len(terms))
    z = np.array([weights[r].sum() + bias for r in rows])
    slope, shift = fit_sigmoid(z, np.where(got["y"] == 1, 1.0, -1.0))
    model.weights, model.bias = slope * weights, slope * bias + shift
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``threshold`` on), one row per row of ``docs``.  Null
    texts score as empty ones; other columns are ignored."""

    def run(batches):
        finder = Finder(model.terms)
        for part, texts in text_chunks(batches):
            s = np.array([model.score(finder(t)[0]) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
