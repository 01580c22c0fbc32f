"""Unsupervised exploration (X01, X02, X04, X06-X08) on ``pyspark.ml``.

Tables enter through the feature encoder (missing numbers become the median, categories one-hot slots,
numbers are scaled), so every row comes out again.  Documented differences: k-means uses k-means||
initialisation and keeps the best of ``n_init`` seeded fits by training cost; PCA scores are centred
explicitly (MLlib does not subtract the mean on transform); hierarchical clustering is re-aimed as
bisecting k-means (divisive).  Transductive methods (t-SNE, agglomerative, DBSCAN) are not offered
for new rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.encoding import fit_encoder, infer_feature_schema
from tessera.operators.sampling import priority_sample

TRANSDUCTIVE = {"dbscan", "tsne", "agglomerative"}
#: rows of a part that iterations hold and read again as a whole
HELD_ROWS = 250_000


def as_vectors(df: DataFrame, columns: Sequence[str] | str, output: str = "features") -> DataFrame:
    """Feature vectors of every row: from table columns through the encoder (imputed, one-hot, scaled),
    or from one array column (e.g. embeddings)."""
    if isinstance(columns, str):
        return df.withColumn(output, array_to_vector(F.col(columns).cast("array<double>")))
    encoder = fit_encoder(df, infer_feature_schema(df, columns), scale=True)
    return encoder.transform(df, output)


def kmeans(df: DataFrame, k: int = 8, n_init: int = 10, seed: int = 42, max_iter: int = 20):
    """Best of ``n_init`` seeded k-means|| fits (lowest training cost); returns
    (model, assignments with ``cluster``)."""
    best, held = None, _in_parts(df)
    for i in range(n_init):
        m = KMeans(k=k, seed=seed + i, maxIter=max_iter, predictionCol="cluster").fit(held)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m)
    model = best[1]
    return model, model.transform(df)


def _in_parts(df: DataFrame, features: str = "features") -> DataFrame:
    """The vectors of ``df`` for a fit that keeps its parts in memory: a table of many rows, whose files Spark may read as few
    large parts, is dealt into parts of ``HELD_ROWS`` rows on average, as many as there are cores at least."""
    rows = df.count()
    if rows <= HELD_ROWS:
        return df
    parts = max(-(-rows // HELD_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.select(features).repartition(parts)


def cluster_sizes(assigned: DataFrame, col: str = "cluster") -> DataFrame:
    return assigned.groupBy(col).agg(F.count(F.lit(1)).alias("size"))


def gaussian_mixture(df: DataFrame, k: int = 2, seed: int = 42):
    """Gaussian mixture (full covariance); assignments plus membership probabilities."""
    model = GaussianMixture(k=k, seed=seed, predictionCol="cluster", probabilityCol="_prob").fit(df)
    out = model.transform(df).withColumn("probability", vector_to_array("_prob")).drop("_prob")
    return model, out


def pca_scores(df: DataFrame, n_components: int = 2, features: str = "features"):
    """Centred PCA scores and explained variance ratio.  The mean vector is one aggregate
    (width = feature count); scores = (x - mean) projected on the components."""
    arr = df.withColumn("_a", vector_to_array(features))
    width = len(arr.select("_a").first()["_a"])
    means = arr.agg(*[F.avg(F.col("_a")[i]).alias(f"m{i}") for i in range(width)]).first()
    mean = F.array(*[F.lit(float(means[f"m{i}"])) for i in range(width)])
    centred = arr.withColumn("_c", array_to_vector(F.zip_with("_a", mean, lambda a, b: a - b)))
    model = PCA(k=n_components, inputCol="_c", outputCol="_scores").fit(centred)
    out = model.transform(centred).withColumn("scores", vector_to_array("_scores")).drop("_a", "_c", "_scores")
    return model, out, list(model.explainedVariance.toArray())


def silhouette(assigned: DataFrame, key: Sequence[str], features: str = "features", col: str = "cluster",
               sample: int = 2000, seed: int = 42) -> dict:
    """Mean Euclidean silhouette of a priority sample of ``sample`` rows (the operator's feature:
    every sampled row meets every other one), noise (-1) excluded.  Returns ``silhouette`` (None with
    fewer than 2 clusters in the sample), ``sampled`` and ``rows``, the number of rows sampled from."""
    data = assigned.where(F.col(col) >= 0).select(*key, F.col(col).alias("_c"), vector_to_array(features).alias("_x"))
    rows = data.count()
    points = priority_sample(data, sample, seed, list(key)).select("_c", "_x")
    held = points.collect()  # at most ``sample`` rows
    x = np.array([r["_x"] for r in held], float)
    names, own = np.unique([r["_c"] for r in held], return_inverse=True)
    if len(names) < 2:
        return {"silhouette": None, "sampled": len(held), "rows": rows}
    spark = assigned.sparkSession
    others = spark.sparkContext.broadcast((x, own))  # bounded by ``sample``
    parts = spark.sparkContext.defaultParallelism

    def widths(batches):
        x, own = others.value
        member = np.eye(own.max() + 1)[own]
        size = member.sum(axis=0)
        for batch in batches:
            at = batch["id"].to_numpy()
            away = np.stack([np.sqrt(((x - x[i]) ** 2).sum(axis=1)) for i in at]) @ member
            mine, row = own[at], np.arange(len(at))
            a = away[row, mine] / np.maximum(size[mine] - 1, 1)
            away = away / size
            away[row, mine] = np.inf
            b = away.min(axis=1)
            width = np.where(size[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            yield pd.DataFrame({"width": width})

    mean = spark.range(0, len(held), 1, parts).mapInPandas(widths, "width double").agg(F.avg("width")).first()[0]
    return {"silhouette": float(mean), "sampled": len(held), "rows": rows}


def bisecting(df: DataFrame, k: int = 2, seed: int = 42):
    """Hierarchical clustering re-aimed as divisive bisecting k-means."""
    model = BisectingKMeans(k=k, seed=seed, predictionCol="cluster").fit(df)
    return model, model.transform(df)


def predict_new(model, method: str, df: DataFrame) -> DataFrame:
    """Assign new rows with an inductive model; transductive methods refuse."""
    if method in TRANSDUCTIVE:
        raise ValueError(f"{method} is transductive and cannot assign new rows")
    return model.transform(df)
