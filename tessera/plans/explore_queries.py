"""Registered exploration, scoring and time-series queries (X*, Y*, Z*)."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import density
from tessera.operators import encoding as E
from tessera.operators import exploration as X
from tessera.operators import models as M
from tessera.operators import scoring as Y
from tessera.operators import series as Z
from tessera.operators.assignments import open_assignments, store_assignments
from tessera.plans.recipe import Recipe, fit_recipe
from tessera.plans.registry import lineitem_with_nulls, register, rounded, table
from tessera.session import checkpoint_dir


def _embeddings(spark, d):
    return X.as_vectors(table(spark, d, "embeddings"), "embedding")


@register("X01_kmeans_cluster_sizes")
def q_kmeans(spark, d):
    _, assigned = X.kmeans(_embeddings(spark, d), k=10, n_init=2)
    return X.cluster_sizes(assigned)


@register("X08_assign_new_rows")
def q_assign_new(spark, d):
    """K-means fitted on the training rows assigns the held-out rows (an inductive model)."""
    from tessera.operators.splitting import SplitConfig, split_assign
    emb = split_assign(_embeddings(spark, d), SplitConfig("random", 0.8, 0.2, 0.0), "vec_id")
    model, _ = X.kmeans(emb.where(F.col("split") == "train"), k=10, n_init=2)
    return X.predict_new(model, "kmeans", emb.where(F.col("split") == "validation")).select("vec_id", "cluster")


@register("X08_assign_new_rows_checks", """
SELECT round(count(*) * 0.2)::BIGINT AS rows, round(count(*) * 0.2)::BIGINT AS nearest, true AS refuses_transductive FROM embeddings""")
def q_assign_new_checks(spark, d):
    """Every held-out row goes to the nearest centre of the model that was fitted without it."""
    from tessera.operators.splitting import SplitConfig, split_assign
    emb = split_assign(_embeddings(spark, d), SplitConfig("random", 0.8, 0.2, 0.0), "vec_id")
    model, _ = X.kmeans(emb.where(F.col("split") == "train"), k=10, n_init=2)
    held = emb.where(F.col("split") == "validation")
    away = [F.aggregate(F.zip_with("x", F.lit(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in model.clusterCenters()]
    out = X.predict_new(model, "kmeans", held).withColumn("x", vector_to_array("features")).withColumn("away", F.array(*away))
    try:
        X.predict_new(model, "dbscan", held)
        refused = False
    except ValueError:
        refused = True
    nearest = F.get("away", F.col("cluster")) <= F.array_min("away") + 1e-9
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(nearest).alias("nearest")).withColumn("refuses_transductive", F.lit(refused))


@register("X02_gaussian_mixture")
def q_gmm(spark, d):
    emb = table(spark, d, "embeddings")
    _, out, _ = X.pca_scores(X.as_vectors(emb, "embedding"), 4)
    _, gm = X.gaussian_mixture(X.as_vectors(out, "scores"), k=3)
    return gm.select("vec_id", "cluster", "probability")


@register("X04_pca_scores")
def q_pca(spark, d):
    _, out, ratio = X.pca_scores(_embeddings(spark, d), 3)
    return out.select("vec_id", "label", "scores").withColumn("explained_variance", F.array(*[F.lit(r) for r in ratio]))


@register("X06_silhouette", """
WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
           ORDER BY sha256('42' || chr(0) || CAST(vec_id AS VARCHAR)), CAST(vec_id AS VARCHAR) LIMIT 2000),
n AS (SELECT label, count(*) AS n FROM s GROUP BY 1),
d AS (SELECT p.vec_id, p.label AS own, q.label, sum(list_distance(p.x, q.x)) AS away FROM s p, s q GROUP BY ALL),
m AS (SELECT vec_id, max(away) FILTER (WHERE own = label) / max(greatest(n - 1, 1)) FILTER (WHERE own = label) AS a,
             max(n) FILTER (WHERE own = label) AS mine, min(away / n) FILTER (WHERE own <> label) AS b
      FROM d JOIN n USING (label) GROUP BY vec_id)
SELECT round(avg(CASE WHEN mine > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette,
       (SELECT count(*) FROM s) AS sampled, (SELECT count(*) FROM embeddings) AS rows FROM m""")
def q_silhouette(spark, d):
    got = X.silhouette(_embeddings(spark, d).withColumn("cluster", F.col("label")), ["vec_id"])
    out = spark.createDataFrame([(got["silhouette"], got["sampled"], got["rows"])],
                                "silhouette double, sampled long, rows long")
    return rounded(out, {"silhouette": 6})


MIXED = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]  # two hold missing values


def _covered(out, ok):
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("answered"))


ALL_ROWS = "SELECT count(*) AS rows, count(*) AS answered FROM {}"


@register("X01_kmeans_mixed_table", ALL_ROWS.format("lineitem"))
def q_kmeans_mixed(spark, d):
    """Every row of a mixed table with missing values gets one of the four clusters."""
    _, out = X.kmeans(X.as_vectors(lineitem_with_nulls(spark, d), MIXED), k=4, n_init=1)
    return _covered(out, F.col("cluster").between(0, 3))


@register("X02_gaussian_mixture_checks", ALL_ROWS.format("embeddings"))
def q_gmm_checks(spark, d):
    """Memberships of every row add up to 1 and the cluster is the likeliest."""
    p = F.col("probability")
    total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    return _covered(q_gmm(spark, d), (F.abs(total - 1) < 1e-6) & (F.element_at(p, F.col("cluster") + 1) == F.array_max(p)))


@register("X04_pca_checks", "SELECT count(*) AS rows, true AS centred, true AS uncorrelated, true AS ordered FROM embeddings")
def q_pca_checks(spark, d):
    """Scores have mean 0, are uncorrelated, and their variances fall."""
    a, b = F.col("scores")[0], F.col("scores")[1]
    return q_pca(spark, d).agg(
        F.count(F.lit(1)).alias("rows"), (F.abs(F.avg(a)) < 1e-6).alias("centred"),
        (F.abs(F.corr(a, b)) < 1e-6).alias("uncorrelated"), (F.var_pop(a) >= F.var_pop(b)).alias("ordered"))


DBSCAN_SQL = """
WITH RECURSIVE p AS ({points}),
pair AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON {near}),
core AS (SELECT a AS k FROM pair GROUP BY a HAVING count(*) >= {least}),
edge AS (SELECT a, b FROM pair JOIN core x ON a = x.k JOIN core y ON b = y.k WHERE a <> b),
cc(k, root) USING KEY (k) AS (
  SELECT k, k FROM core
  UNION
  SELECT e.b, min(cc.root) FROM cc JOIN edge e ON cc.k = e.a JOIN recurring.cc AS old ON old.k = e.b
  WHERE cc.root < old.root GROUP BY e.b),
named AS (SELECT k, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM cc),
border AS (SELECT a AS k, min(cluster) AS cluster FROM pair JOIN named ON b = named.k WHERE a NOT IN (SELECT k FROM core) GROUP BY a)
SELECT p.k AS {key}, coalesce(named.cluster, border.cluster, -1)::BIGINT AS cluster, named.k IS NOT NULL AS core{more}
FROM p LEFT JOIN named ON p.k = named.k LEFT JOIN border ON p.k = border.k"""
NEAR_2D = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {0} * {0} AND b.x BETWEEN a.x - {0} AND a.x + {0}"
NEAR_VECTORS = "list_distance(a.x, b.x) <= {0}"
EVENT_POINTS = "SELECT event_id AS k, epoch_us(ts) / 86400000000.0 AS x, value / 100 AS y FROM events"
VECTOR_POINTS = "SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"


def _event_points(spark, d):
    events = table(spark, d, "events")
    days = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000.0)
    return events.select("event_id", F.array(days, F.col("value") / F.lit(100)).alias("point"))


@register("X03_dbscan_events", DBSCAN_SQL.format(points=EVENT_POINTS, near=NEAR_2D.format("0.06"), least=5, key="event_id", more=""))
def q_dbscan_events(spark, d):
    """Every event by its day and value: a dense band of small values, and a sparse tail."""
    return density.dbscan(_event_points(spark, d), "event_id", "point", 0.06, 5)


@register("X03_dbscan_vectors", DBSCAN_SQL.format(points=VECTOR_POINTS, near=NEAR_VECTORS.format("1.17"), least=5, key="vec_id", more=""))
def q_dbscan_vectors(spark, d):
    return density.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", 1.17, 5)


@register("Y05_stored_assignments", DBSCAN_SQL.format(
    points=VECTOR_POINTS, near=NEAR_VECTORS.format("1.17"), least=5, key="vec_id", more=", 'assigned' AS status, p.k % 7 AS note"))
def q_stored_assignments(spark, d):
    """Clusters of the vectors, stored, opened again against their source and looked up by row."""
    vectors = table(spark, d, "embeddings")
    path = f"{checkpoint_dir(spark).rstrip('/')}/assignments/{uuid.uuid4().hex}"
    store_assignments(q_dbscan_vectors(spark, d), "vec_id", vectors, path)
    return open_assignments(spark, path, vectors).lookup(vectors.select("vec_id", (F.col("vec_id") % 7).alias("note")))


@register("X07_bisecting_checks", "SELECT count(*) AS rows, 6 AS clusters FROM embeddings")
def q_bisect_checks(spark, d):
    return q_bisect(spark, d).agg(F.sum("size").alias("rows"), F.count(F.lit(1)).cast("int").alias("clusters"))


@register("X05_isolation_forest_checks", ALL_ROWS.format("lineitem"))
def q_iforest_checks(spark, d):
    """Rows with missing values are scored too."""
    from tessera.operators.anomaly import fit_isolation_forest, score_isolation_forest
    li = lineitem_with_nulls(spark, d).select("l_orderkey", "l_linenumber", *MIXED[:3])
    model = fit_isolation_forest(li, MIXED[:3], n_estimators=20, key=["l_orderkey", "l_linenumber"])
    out = score_isolation_forest(li, model)
    return _covered(out, F.col("anomaly_score").between(0, 1) & (F.col("is_anomaly") == (F.col("anomaly_score") > 0.5)))


@register("X07_bisecting_kmeans")
def q_bisect(spark, d):
    _, out = X.bisecting(_embeddings(spark, d), k=6)
    return X.cluster_sizes(out)


DOCS_Y = ("(SELECT d.doc_id, CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE d.n_chars END AS n_chars, l.quality "
          "FROM documents d LEFT JOIN labels l USING (doc_id))")


def _docs_y(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("n_chars")).alias("n_chars")) \
        .join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


def _dummy_scored(spark, d):
    df = _docs_y(spark, d)
    labeled = df.where(F.col("quality").isNotNull())
    classes = E.target_classes(labeled, "quality")
    r = Recipe()
    r.add("drop_missing", columns=["n_chars"])
    fitted = fit_recipe(r.approve_all(), labeled.select("n_chars"))
    enc = E.fit_encoder(fitted.apply(labeled.select("n_chars")), {"n_chars": "numeric"})
    from tessera.plans.prepare import _apply_carrying
    kept = _apply_carrying(fitted, labeled.select("n_chars", "quality"), ["quality"])
    train = enc.transform(E.encode_target(kept, "quality", classes))
    model = M.fit_model(M.ModelConfig("sklearn", "dummy"), train, "classification", n_classes=len(classes))
    scored = Y.score_table(df.select("doc_id", "n_chars"), "doc_id", fitted, enc, model, classes)
    return df, scored


@register("Y01_score_table", f"""
WITH t AS (SELECT * FROM {DOCS_Y} x), lab AS (SELECT quality FROM t WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
pri AS (SELECT quality, count(*) / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY 1),
maj AS (SELECT quality FROM pri ORDER BY p DESC, quality LIMIT 1)
SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'excluded_by_preprocessing' ELSE 'predicted' END AS status,
  CASE WHEN n_chars IS NOT NULL THEN CAST((SELECT quality FROM maj) AS DOUBLE) END AS prediction,
  CASE WHEN n_chars IS NOT NULL THEN '["number", "' || (SELECT quality FROM maj) || '"]' END AS predicted_class,
  CASE WHEN n_chars IS NOT NULL THEN round((SELECT p FROM pri WHERE quality = 0), 10) END AS probability_0,
  CASE WHEN n_chars IS NOT NULL THEN round((SELECT p FROM pri WHERE quality = 1), 10) END AS probability_1
FROM t""")
def q_score(spark, d):
    _, scored = _dummy_scored(spark, d)
    return rounded(scored, {"probability_0": 10, "probability_1": 10})


@register("Y02_scoring_counts", f"""
SELECT CASE WHEN n_chars IS NULL THEN 'excluded_by_preprocessing' ELSE 'predicted' END AS status, count(*) AS count
FROM {DOCS_Y} x GROUP BY 1""")
def q_score_counts(spark, d):
    """Rows scored per status for a batch (one grouped count over the scored table)."""
    _, scored = _dummy_scored(spark, d)
    return scored.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


@register("Y03_append_predictions", f"""
WITH t AS (SELECT * FROM {DOCS_Y} x), lab AS (SELECT quality FROM t WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
pri AS (SELECT quality, count(*) / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY 1),
maj AS (SELECT quality FROM pri ORDER BY p DESC, quality LIMIT 1)
SELECT doc_id, n_chars, quality AS quality_actual,
  CASE WHEN n_chars IS NOT NULL THEN CAST((SELECT quality FROM maj) AS DOUBLE) END AS prediction,
  CASE WHEN n_chars IS NULL THEN 'excluded_by_preprocessing' ELSE 'predicted' END AS status,
  CASE WHEN quality IS NOT NULL AND n_chars IS NOT NULL THEN quality = (SELECT quality FROM maj) END AS correct
FROM t""")
def q_append(spark, d):
    df, scored = _dummy_scored(spark, d)
    out = Y.append_predictions(df, scored.select("doc_id", "prediction", "status"), "doc_id", "quality")
    return Y.with_residuals(out, "quality_actual", "classification")


DAILY_SQL = ("(SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, "
             "CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2)")


def _daily(spark, d):
    ev = table(spark, d, "events")
    return ev.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type") \
        .agg(F.count(F.lit(1)).cast("double").alias("n"))


@register("Z01_chronological_series_cut", f"""
SELECT day, event_type, n, CASE WHEN pos < floor(cnt * 0.7) THEN 'train'
  WHEN pos < floor(cnt * 0.7) + floor(cnt * 0.15) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS pos,
             count(*) OVER (PARTITION BY event_type) AS cnt FROM {DAILY_SQL} t)""")
def q_series_cut(spark, d):
    daily = _daily(spark, d)
    Z.validate_series(daily, "day", "n", "event_type")
    return Z.chronological_cut(daily, "day", (0.7, 0.15), "event_type").drop("pos")


CUT_SQL = f"""(SELECT day, event_type, n, CASE WHEN pos < floor(cnt * 0.7) THEN 'train'
  WHEN pos < floor(cnt * 0.7) + floor(cnt * 0.15) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS pos,
             count(*) OVER (PARTITION BY event_type) AS cnt FROM {DAILY_SQL} t))"""


@register("Z02_last_value_baseline", f"""
WITH c AS {CUT_SQL},
l AS (SELECT event_type, arg_max(n, day) AS last FROM c WHERE split = 'train' GROUP BY 1)
SELECT event_type, round(avg(abs(n - last)), 8) AS mae, round(sqrt(avg((n - last) * (n - last))), 8) AS rmse,
       count(*) AS rows FROM c JOIN l USING (event_type) WHERE split = 'validation' GROUP BY 1""")
def q_last_value(spark, d):
    cut = Z.chronological_cut(_daily(spark, d), "day", (0.7, 0.15), "event_type")
    return rounded(Z.last_value_baseline(cut, "day", "n", "event_type"), {"mae": 8, "rmse": 8})


@register("Z03_naive_one_step", f"""
WITH c AS {CUT_SQL}, l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM c)
SELECT event_type, round(avg(abs(n - prev)), 8) AS mae, round(sqrt(avg((n - prev) * (n - prev))), 8) AS rmse,
       count(*) AS rows FROM l WHERE split = 'validation' AND prev IS NOT NULL GROUP BY 1""")
def q_naive(spark, d):
    cut = Z.chronological_cut(_daily(spark, d), "day", (0.7, 0.15), "event_type")
    return rounded(Z.naive_baseline(cut, "day", "n", "event_type"), {"mae": 8, "rmse": 8})


@register("Z05_standardise", f"""
WITH c AS {CUT_SQL}
SELECT event_type, round(avg(n), 8) AS mean,
       round(CASE WHEN stddev_pop(n) > 0 THEN stddev_pop(n) ELSE 1.0 END, 8) AS std FROM c WHERE split = 'train' GROUP BY 1""")
def q_standardise(spark, d):
    cut = Z.chronological_cut(_daily(spark, d), "day", (0.7, 0.15), "event_type")
    return rounded(Z.standardise(cut.where(F.col("split") == "train"), "n", "event_type"), {"mean": 8, "std": 8})


@register("Z04_ar_forecast")
def q_ar(spark, d):
    daily = _daily(spark, d)
    model = Z.fit_ar(daily, "day", "n", p=2, d=1, series="event_type")
    return Z.forecast_ar(daily, model, "day", "n", p=2, d=1, horizon=3, step_seconds=86400, series="event_type")


@register("Z04_ar1_coefficients", f"""
WITH l AS (SELECT event_type, n, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM {DAILY_SQL} t)
SELECT event_type, count(*) AS n, round(regr_intercept(n, prev), 6) AS intercept, round(regr_slope(n, prev), 6) AS phi_1
FROM l WHERE prev IS NOT NULL GROUP BY 1""")
def q_ar1(spark, d):
    model = Z.fit_ar(_daily(spark, d), "day", "n", p=1, d=0, series="event_type")
    return model.select("event_type", "n", F.round(F.col("coef")[0], 6).alias("intercept"),
                        F.round(F.col("coef")[1], 6).alias("phi_1"))


@register("Z06_ar1_residuals", f"""
WITH l AS (SELECT day, event_type, n, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM {DAILY_SQL} t),
c AS (SELECT event_type, regr_intercept(n, prev) AS a, regr_slope(n, prev) AS b FROM l WHERE prev IS NOT NULL GROUP BY 1)
SELECT event_type, day, n, round(a + b * prev, 6) AS prediction, round(n - (a + b * prev), 6) AS residual
FROM l JOIN c USING (event_type)""")
def q_ar_residuals(spark, d):
    daily = _daily(spark, d)
    model = Z.fit_ar(daily, "day", "n", p=1, d=0, series="event_type")
    out = Z.ar_residuals(daily, model, "day", "n", 1, "event_type")
    return rounded(out, {"prediction": 6, "residual": 6})


@register("X05_isolation_forest")
def q_iforest(spark, d):
    from tessera.operators.anomaly import fit_isolation_forest, score_isolation_forest
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                            "l_discount")
    feats = ["l_quantity", "l_extendedprice", "l_discount"]
    model = fit_isolation_forest(li, feats, n_estimators=50, key=["l_orderkey", "l_linenumber"])
    scored = score_isolation_forest(li, model, contamination=0.05)
    return scored.select("l_orderkey", "l_linenumber", "anomaly_score", "is_anomaly")
