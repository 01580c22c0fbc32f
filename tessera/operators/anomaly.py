"""Isolation forest (X05), after Liu, Ting and Zhou (2008).

* Training data: one priority sample of at most ``n_estimators * 256`` rows (bounded, independent of
  the table size); each tree draws its own min(256, rows) of them without replacement.  Missing
  values are filled with the exact medians of all rows, in fitting and in scoring.
* Trees: random feature, random split between the subsample's min and max, depth limit
  ceil(log2(256)) -- built on the driver from the bounded sample (small arrays).
* Scoring: every row, in Arrow batches through ``mapInPandas``, vectorised with numpy per tree;
  score = 2^(-E[h(x)] / c(256)).
* Flag: rows whose score is at or above the exact (1 - contamination) quantile of all scores,
  from the distributed rank core; with ``contamination='auto'`` rows that score above 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import is_finite
from tessera.functions.ranking import exact_quantiles
from tessera.operators.sampling import priority_sample
from tessera.session import cut_lineage

EULER = 0.5772156649015329


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _build(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> list:
    """Tree as nested lists: ["leaf", size] or ["node", feature, threshold, left, right]."""
    if depth >= limit or len(x) <= 1:
        return ["leaf", len(x)]
    lo, hi = x.min(axis=0), x.max(axis=0)
    usable = np.flatnonzero(hi > lo)
    if len(usable) == 0:
        return ["leaf", len(x)]
    f = int(rng.choice(usable))
    t = float(rng.uniform(lo[f], hi[f]))
    left = x[:, f] < t
    return ["node", f, t, _build(x[left], rng, depth + 1, limit), _build(x[~left], rng, depth + 1, limit)]


def _path(tree: list, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    stack = [(tree, np.arange(len(x)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        if len(idx) == 0:
            continue
        if node[0] == "leaf":
            out[idx] = depth + _c(node[1])
            continue
        _, f, t, left, right = node
        go_left = x[idx, f] < t
        stack.append((left, idx[go_left], depth + 1))
        stack.append((right, idx[~go_left], depth + 1))
    return out


def _filled(x: np.ndarray, medians: list) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.array(medians))


def fit_isolation_forest(df: DataFrame, features: Sequence[str], n_estimators: int = 100,
                         max_samples: int = 256, seed: int = 42, key: Sequence[str] | None = None) -> dict:
    cols = list(features)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                                        for c in cols]))).where(is_finite("x"))
    found = {r["column"]: r["q"] for r in exact_quantiles(long, "x", [0.5], ["column"]).collect()}  # one per column
    medians = [float(found.get(c, 0.0)) for c in cols]
    sample = priority_sample(df.select(*dict.fromkeys([*(key or []), *cols])), n_estimators * max_samples, seed,
                             key or cols)
    rows = sample.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).collect()  # bounded
    data = _filled(np.array(rows, dtype=float).reshape(-1, len(cols)), medians)
    rng = np.random.default_rng(seed)
    size = min(max_samples, len(data))
    limit = int(math.ceil(math.log2(max(size, 2))))
    trees = []
    for _ in range(n_estimators):
        chunk = data[rng.choice(len(data), size=size, replace=False)]
        trees.append(_build(chunk, rng, 0, limit))
    return {"features": cols, "medians": medians, "trees": trees, "c": _c(size)}


def score_isolation_forest(df: DataFrame, model: dict, contamination: float | str = "auto") -> DataFrame:
    """Adds ``anomaly_score`` (higher = more anomalous) and ``is_anomaly`` to every row."""
    cols, trees, c, medians = model["features"], model["trees"], model["c"], model["medians"]
    schema = T.StructType([*df.schema.fields, T.StructField("anomaly_score", T.DoubleType())])
    bc = df.sparkSession.sparkContext.broadcast(trees)  # the fitted forest: bounded by trees x 2^depth nodes

    def run(batches):
        forest = bc.value
        for pdf in batches:
            x = _filled(pdf[cols].astype(float).to_numpy(), medians)
            h = np.mean([_path(t, x) for t in forest], axis=0) if len(x) else np.zeros(0)
            out = pdf.copy()
            out["anomaly_score"] = np.power(2.0, -h / c) if c > 0 else 0.5
            yield out
    scored = df.mapInPandas(run, schema)
    if contamination == "auto":
        return scored.withColumn("is_anomaly", F.col("anomaly_score") > 0.5)
    scored = cut_lineage(scored)  # scores are needed twice: for the threshold and for the rows
    found = exact_quantiles(scored.select("anomaly_score"), "anomaly_score", [1 - contamination]).first()
    return scored.withColumn("is_anomaly", F.col("anomaly_score") >= F.lit(found["q"] if found else None))
