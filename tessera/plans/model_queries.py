"""Registered encoding, model and evaluation queries (E*, M*, V*)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import encoding as E
from tessera.operators import evaluation as V
from tessera.operators import models as M
from tessera.operators.dictionary import with_slots
from tessera.operators.search import fit_validated, race
from tessera.operators.splitting import SplitConfig, split_assign
from tessera.plans.prep_queries import ORDERS_NULLS_SQL, _rank_split_sql, orders_with_nulls
from tessera.plans.registry import register, rounded, table


@register("E07_target_index", """SELECT c_custkey,
  CAST(dense_rank() OVER (ORDER BY '["string", "' || c_mktsegment || '"]') - 1 AS DOUBLE) AS label FROM customer""")
def q_target_index(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    classes = E.target_classes(c, "c_mktsegment")
    return E.encode_target(c, "c_mktsegment", classes).select("c_custkey", "label")


@register("E02_median_impute_and_scale", f"""
WITH s AS ({_rank_split_sql(ORDERS_NULLS_SQL, "o_orderkey", "''")}),
j AS (SELECT o.o_orderkey, o.o_totalprice, s.split FROM {ORDERS_NULLS_SQL} o JOIN s USING (o_orderkey)),
m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM j WHERE split = 'train'),
sd AS (SELECT stddev_pop(coalesce(o_totalprice, med)) AS sdev FROM j, m WHERE split = 'train')
SELECT o_orderkey, round(coalesce(o_totalprice, med) / sdev, 10) AS o_totalprice FROM j, m, sd""")
def q_impute_scale(spark, d):
    o = orders_with_nulls(spark, d).select("o_orderkey", "o_totalprice")
    assigned = split_assign(o, SplitConfig("random"), "o_orderkey")
    train = assigned.where(F.col("split") == "train")
    enc = E.fit_encoder(train, {"o_totalprice": "numeric"}, scale=True)
    out = enc.prepare(assigned).select("o_orderkey", F.col("_num_o_totalprice").alias("o_totalprice"))
    return rounded(out, {"o_totalprice": 10})


@register("E04_one_hot_slots", f"""
WITH s AS ({_rank_split_sql("part", "p_partkey", "''")}),
tok AS (SELECT DISTINCT 'value:' || p_type AS t FROM part JOIN s USING (p_partkey) WHERE split = 'train'),
idx AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS slot FROM tok)
SELECT p_partkey, 'value:' || p_type AS token, slot, (SELECT count(*) FROM tok) AS width
FROM part LEFT JOIN idx ON idx.t = 'value:' || p_type""")
def q_one_hot(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type")
    assigned = split_assign(p, SplitConfig("random"), "p_partkey")
    enc = E.fit_encoder(assigned.where(F.col("split") == "train"), {"p_type": "categorical"})
    out = enc.transform(assigned)
    arr = vector_to_array("features")
    slot = F.array_position(arr, F.lit(1.0)) - 1
    return out.select("p_partkey", F.concat(F.lit("value:"), F.col("p_type")).alias("token"),
                      F.when(slot >= 0, slot).cast("int").alias("slot"),
                      F.lit(enc.width).cast("bigint").alias("width"))


@register("E04_dictionary_slots", """
WITH tok AS (
  SELECT DISTINCT 0 AS c, 'value:' || l_orderkey AS t FROM lineitem WHERE l_orderkey % 3 <> 0
  UNION ALL SELECT DISTINCT 1, 'value:' || l_returnflag FROM lineitem WHERE l_orderkey % 3 <> 0),
idx AS (SELECT c, t, CAST(row_number() OVER (ORDER BY c, t) AS INTEGER) AS slot FROM tok)
SELECT l_orderkey, l_linenumber, l_returnflag, a.slot AS order_slot, b.slot AS flag_slot, (SELECT count(*) + 1 FROM tok)::BIGINT AS width
FROM lineitem LEFT JOIN idx a ON a.c = 0 AND a.t = 'value:' || l_orderkey LEFT JOIN idx b ON b.c = 1 AND b.t = 'value:' || l_returnflag""")
def q_dictionary_slots(spark, d):
    """One-hot slots of a key with many tokens beside a few, numbered in a distributed dictionary fitted on two thirds of the keys."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    schema = {"l_quantity": "numeric", "l_orderkey": "categorical", "l_returnflag": "categorical"}
    enc = E.fit_encoder(li.where("l_orderkey % 3 <> 0"), schema, literal_slots=1_000)
    out = with_slots(enc.prepare(li), enc.slots, {c: f"_tok_{c}" for c in enc.slots.columns})
    edge = enc.slots.first + enc.slots.sizes["l_orderkey"]
    return out.select("l_orderkey", "l_linenumber", "l_returnflag",
                      F.get(F.filter("slots", lambda s: s < edge), 0).alias("order_slot"),
                      F.get(F.filter("slots", lambda s: s >= edge), 0).alias("flag_slot"), F.lit(enc.width).cast("bigint").alias("width"))


@register("E07_many_classes", """
WITH k AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS t FROM orders WHERE o_custkey % 5 <> 0),
idx AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS DOUBLE) AS label FROM k)
SELECT o_orderkey, label FROM orders LEFT JOIN idx ON t = CAST(o_custkey AS VARCHAR)""")
def q_many_classes(spark, d):
    """Classes numbered in a table, in text order (10 before 2); classes that were not fitted have no label."""
    orders = table(spark, d, "orders")
    classes = E.target_classes(orders.where("o_custkey % 5 <> 0"), "o_custkey", literal_classes=100)
    return E.encode_target(orders, "o_custkey", classes).select("o_orderkey", "label")


DOCS_LABELED = "(SELECT d.doc_id, d.n_chars, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id))"


def docs_labeled(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@register("M01_dummy_classifier", f"""
WITH s AS ({_rank_split_sql(DOCS_LABELED, "doc_id", "''")}),
t AS (SELECT quality FROM {DOCS_LABELED} x JOIN s USING (doc_id) WHERE split = 'train'),
p AS (SELECT quality AS cls, count(*) / (SELECT count(*) FROM t) AS prior FROM t GROUP BY 1)
SELECT CAST(cls AS INTEGER) AS cls, round(prior, 10) AS prior,
       cls = (SELECT cls FROM p ORDER BY prior DESC, cls LIMIT 1) AS majority FROM p""")
def q_dummy(spark, d):
    df = docs_labeled(spark, d)
    assigned = split_assign(df, SplitConfig("random"), "doc_id")
    train = assigned.where(F.col("split") == "train").withColumn("label", F.col("quality").cast("double"))
    m = M.fit_model(M.ModelConfig("sklearn", "dummy"), train, "classification", n_classes=2)
    rows = [(i, float(p), i == m.extra["majority"]) for i, p in enumerate(m.extra["priors"])]
    out = spark.createDataFrame(rows, "cls int, prior double, majority boolean")
    return rounded(out, {"prior": 10})


def _part_regression(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    enc = E.fit_encoder(p, {"p_size": "numeric"})
    data = enc.transform(p).withColumn("label", F.col("p_retailprice"))
    model = M.fit_model(M.ModelConfig("sklearn", "linear_regression"), data, "regression")
    return model, model.predict(data)


@register("M02_linear_regression", """
SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept
FROM part""")
def q_linreg(spark, d):
    model, _ = _part_regression(spark, d)
    lm = model.model
    return spark.createDataFrame([(float(lm.coefficients[0]), float(lm.intercept))], "slope double, intercept double") \
        .select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@register("M03_penalised_regression", """
WITH m AS (SELECT covar_pop(p_size, p_retailprice) AS c, var_pop(p_size) AS v, count(*) AS n,
                  avg(p_size) AS mx, avg(p_retailprice) AS my FROM part),
w AS (SELECT 'ridge' AS model, c / (v + 10.0 / n) AS slope, mx, my FROM m
      UNION ALL SELECT 'lasso', sign(c) * greatest(abs(c) - 0.05, 0) / v, mx, my FROM m
      UNION ALL SELECT 'elastic_net', sign(c) * greatest(abs(c) - 0.025, 0) / (v + 0.025), mx, my FROM m)
SELECT model, round(slope, 6) AS slope, round(my - slope * mx, 4) AS intercept FROM w""")
def q_penalised(spark, d):
    """Ridge, lasso and elastic-net coefficients on the same encoded part rows."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    data = E.fit_encoder(p, {"p_size": "numeric"}).transform(p).withColumn("label", F.col("p_retailprice"))
    rows = []
    for algo, params in [("ridge", {"alpha": 10.0}), ("lasso", {"alpha": 0.05}),
                         ("elastic_net", {"alpha": 0.05, "l1_ratio": 0.5})]:
        lm = M.fit_model(M.ModelConfig("sklearn", algo, params), data, "regression").model
        rows.append((algo, float(lm.coefficients[0]), float(lm.intercept)))
    out = spark.createDataFrame(rows, "model string, slope double, intercept double")
    return rounded(out, {"slope": 6, "intercept": 4})


@register("V01_regression_metrics", """
WITH f AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part),
p AS (SELECT p_retailprice AS y, a + b * p_size AS yhat FROM part, f)
SELECT count(*) AS rows, round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse,
       round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 8) AS r2 FROM p""")
def q_reg_metrics(spark, d):
    _, pred = _part_regression(spark, d)
    return rounded(V.regression_metrics(pred, "label", "prediction"), {"mae": 6, "rmse": 6, "r2": 8})


def scored_docs(spark, d):
    """A fixed scoring rule on document length (the evaluation operators are the subject)."""
    df = docs_labeled(spark, d)
    s = 1 / (1 + F.exp(-(F.col("n_chars") - 1000) / 500.0))
    return df.select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("prediction"),
                     F.array(1 - s, s).alias("probability"), s.alias("score"))


SCORED_SQL = f"""(SELECT doc_id, quality AS y, (n_chars > 1000)::INT AS p,
  1 / (1 + exp(-(n_chars - 1000) / 500.0)) AS s FROM {DOCS_LABELED} x)"""


@register("V02_classification_metrics", f"""
WITH t AS {SCORED_SQL},
c AS (SELECT cls, count(*) FILTER (WHERE y = cls AND p = cls) AS tp, count(*) FILTER (WHERE y = cls) AS support,
             count(*) FILTER (WHERE p = cls) AS pn FROM t, (VALUES (0), (1)) v(cls) GROUP BY cls),
m AS (SELECT cls, support, CASE WHEN pn > 0 THEN tp / pn ELSE 0.0 END AS pr,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM c),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m),
r AS (SELECT s, (rank() OVER (ORDER BY s) + rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk, y FROM t),
auc AS (SELECT (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
               / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS roc_auc FROM r)
SELECT (SELECT round(avg((y = p)::INT), 10) FROM t) AS accuracy, (SELECT count(*) FROM t) AS rows,
  round(avg(rc) FILTER (WHERE support > 0), 10) AS balanced_accuracy, round(avg(pr), 10) AS precision_macro,
  round(avg(rc), 10) AS recall_macro, round(avg(f1), 10) AS f1_macro,
  round(sum(f1 * support) / sum(support), 10) AS f1_weighted, round(max(f1) FILTER (WHERE cls = 1), 10) AS f1_binary,
  (SELECT round(avg(-ln(least(greatest(CASE WHEN y = 1 THEN s ELSE 1 - s END, 2.220446049250313e-16),
                                1 - 2.220446049250313e-16))), 10) FROM t) AS log_loss,
  (SELECT round(roc_auc, 10) FROM auc) AS roc_auc
FROM f""")
def q_clf_metrics(spark, d):
    out = V.classification_metrics(scored_docs(spark, d), 2, prob="probability")
    digits = {c: 10 for c in ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro",
                              "f1_weighted", "f1_binary", "log_loss", "roc_auc")}
    return rounded(out, digits)


@register("V06_roc_auc", """
WITH t AS (SELECT CAST(d.n_chars AS DOUBLE) AS s, l.toxic AS y FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT y, (rank() OVER (ORDER BY s) + rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM t)
SELECT round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
       / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 10) AS roc_auc FROM r""")
def q_auc(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rounded(V.roc_auc(df, "toxic", "n_chars"), {"roc_auc": 10})


@register("V07_confusion_per_class", f"""
WITH t AS {SCORED_SQL},
c AS (SELECT cls, count(*) FILTER (WHERE y = cls AND p = cls) AS tp, count(*) FILTER (WHERE y = cls) AS support,
             count(*) FILTER (WHERE p = cls) AS pn FROM t, (VALUES (0), (1)) v(cls) GROUP BY cls),
m AS (SELECT cls, support, CASE WHEN pn > 0 THEN tp / pn ELSE 0.0 END AS pr,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM c)
SELECT CAST(cls AS INTEGER) AS cls, round(pr, 10) AS precision, round(rc, 10) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 10) AS f1, support,
       (SELECT count(*) FILTER (WHERE y = cls AND p = 0) FROM t) AS predicted_0,
       (SELECT count(*) FILTER (WHERE y = cls AND p = 1) FROM t) AS predicted_1 FROM m""")
def q_confusion(spark, d):
    sd = scored_docs(spark, d)
    pc = V.per_class(sd, 2)
    cm = V.confusion(sd, 2).groupBy(F.col("actual").alias("cls")).agg(
        F.max(F.when(F.col("predicted") == 0, F.col("count"))).alias("predicted_0"),
        F.max(F.when(F.col("predicted") == 1, F.col("count"))).alias("predicted_1"))
    return rounded(pc.join(cm, "cls"), {"precision": 10, "recall": 10, "f1": 10})


def _doc_features(spark, d):
    df = docs_labeled(spark, d)
    assigned = split_assign(df, SplitConfig("stratified"), "doc_id", target="quality")
    schema = E.infer_feature_schema(assigned, ["n_chars", "lang"])
    enc = E.fit_encoder(assigned.where(F.col("split") == "train"), schema, scale=True)
    data = enc.transform(assigned).withColumn("label", F.col("quality").cast("double"))
    return data


def _model_rows(algorithm: str, task: str = "classification", params: dict | None = None):
    def run(spark, d):
        data = _doc_features(spark, d)
        train = data.where(F.col("split") == "train")
        m = M.fit_model(M.ModelConfig("sklearn" if algorithm != "mlp" else "pytorch", algorithm, params or {}),
                        train, task, n_classes=2)
        pred = m.predict(data)
        p1 = F.element_at("probability", 2) if "probability" in pred.columns else F.lit(None).cast("double")
        return pred.select("doc_id", "split", "prediction", p1.alias("p1"))
    return run


def _model_checks(rows, probabilities: bool):
    """Of the rows a model query returns: rows per split, how many are predicted as a class, and how many
    have a probability in [0, 1] on the side of the prediction."""
    def run(spark, d):
        at = F.col("p1")
        fits = at.isNotNull() & at.between(0, 1) & ((F.col("prediction") == 1) == (at > 0.5)) | (F.abs(at - 0.5) < 1e-9)
        return rows(spark, d).groupBy("split").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prediction").isin(0.0, 1.0)).alias("predicted"),
            (F.count_if(fits) if probabilities else F.count_if(at.isNull())).alias("consistent"))
    return run


MODEL_CHECK_SQL = f"""SELECT split, count(*) AS rows, count(*) AS predicted, count(*) AS consistent
FROM ({_rank_split_sql(DOCS_LABELED, "doc_id", "CAST(quality AS VARCHAR)")}) s GROUP BY split"""


@register("V12_class_view", f"""
WITH t AS (SELECT doc_id, n_chars, lang, quality, (n_chars > 1000)::INT AS p FROM {DOCS_LABELED} x),
s AS (SELECT * FROM t ORDER BY sha256('42' || chr(0) || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR),
                               n_chars, lang, quality, p LIMIT 2000),
c AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY lang IS NULL ORDER BY lang) - 1 AS DOUBLE) AS code FROM s)
SELECT doc_id, CAST(n_chars AS DOUBLE) AS x, code AS y, quality AS true_class, p AS predicted_class,
       coalesce(quality NOT IN (0, 1), true) AS unknown
FROM c WHERE p IS NOT NULL AND n_chars IS NOT NULL AND lang IS NOT NULL""")
def q_class_view(spark, d):
    """True vs predicted classes on (n_chars, lang) for a 2,000-row priority sample."""
    df = docs_labeled(spark, d).withColumn("prediction", (F.col("n_chars") > 1000).cast("int"))
    return V.class_view(df, ["n_chars", "lang"], classes=[0, 1], key=["doc_id"], label="quality")


@register("V11_learning_curve")
def q_learning_curve(spark, d):
    """Per-round log loss of the boosted model (M07) on its training and validation rows."""
    data = _doc_features(spark, d)
    m = M.fit_model(M.ModelConfig("sklearn", "gradient_boosting", {"n_estimators": 10}),
                    data.where(F.col("split") == "train"), "classification", n_classes=2)
    frames = {s: data.where(F.col("split") == s) for s in ("train", "validation")}
    return rounded(V.learning_curve(m.model, frames), {"loss": 8})


@register("K05_validated_boosting_checks", """
SELECT true AS chosen_is_least, true AS trees_kept, true AS predicts_as_prefix, 12 AS rounds, (SELECT count(*) FROM part)::BIGINT AS rows""")
def q_validated(spark, d):
    """Boosting on part keeps the round of least validation loss; its loss is that of the curve at that round."""
    p = table(spark, d, "part")
    data = split_assign(p, SplitConfig("random"), "p_partkey")
    enc = E.fit_encoder(data.where("split = 'train'"), {"p_size": "numeric", "p_partkey": "numeric"})
    data = enc.transform(data).withColumn("label", F.col("p_retailprice") + F.pmod(F.col("p_partkey") * 7919, F.lit(500)))
    train, val = data.where("split = 'train'"), data.where("split = 'validation'")
    config = M.ModelConfig("sklearn", "gradient_boosting", {"n_estimators": 12, "learning_rate": 0.9})
    model, told = fit_validated(config, train, val, "regression")
    err = F.col("prediction") - F.col("label")
    loss = model.predict(val).agg(F.avg(err * err)).first()[0]
    least = min(told["losses"])
    rows = model.predict(data).count()
    return spark.createDataFrame([(told["losses"].index(least) + 1 == told["chosen"], model.model.getNumTrees == told["chosen"],
                                   abs(loss - least) <= 1e-9 * least, told["rounds"], rows)],
                                 "chosen_is_least boolean, trees_kept boolean, predicts_as_prefix boolean, rounds int, rows long")


@register("M16_racing_search", """
WITH n AS (SELECT floor(count(*) * 0.8)::BIGINT AS n FROM part),
r(rung, candidates) AS (VALUES (0, 9), (1, 3), (2, 1))
SELECT rung::INTEGER AS rung, candidates::BIGINT AS candidates, least(n, (6 * n // 3) // candidates)::BIGINT AS rows,
  CASE WHEN rung = 2 THEN 1 ELSE candidates // 3 END::BIGINT AS kept, true AS within_budget FROM r, n""")
def q_race(spark, d):
    """Nine settings of a tree race for the price of part within six times the training rows: rungs, rows and survivors."""
    p = table(spark, d, "part")
    enc = E.fit_encoder(p, {"p_size": "numeric", "p_partkey": "numeric"})
    data = split_assign(enc.transform(p).withColumn("label", F.col("p_retailprice")), SplitConfig("random", 0.8, 0.2, 0.0), "p_partkey")
    train, val = data.where("split = 'train'"), data.where("split = 'validation'")
    space = {"max_depth": [1, 3, 6], "min_samples_leaf": [1, 20, 200]}
    configs = M.search_configs(M.ModelConfig("sklearn", "decision_tree"), space, "grid")
    err = F.col("prediction") - F.col("label")
    budget = 6 * train.count()
    out = race(configs, train, val, "p_partkey", lambda s: s.agg(F.sqrt(F.avg(err * err))).first()[0], "min", budget, "regression")
    return out.table(spark).groupBy("rung").agg(
        F.count(F.lit(1)).alias("candidates"), F.max("rows").alias("rows"), F.count_if("kept").alias("kept"),
        F.lit(out.rows <= budget).alias("within_budget"))


@register("V11_learning_curve_checks", """
SELECT unnest(['train_loss', 'validation_loss']) AS series, 10::BIGINT AS rounds, true AS last_is_the_models_loss""")
def q_learning_curve_checks(spark, d):
    """Ten rounds for each split, and the last loss is that of the model's probabilities (twice their log loss)."""
    data = _doc_features(spark, d)
    train = data.where(F.col("split") == "train")
    m = M.fit_model(M.ModelConfig("sklearn", "gradient_boosting", {"n_estimators": 10}), train, "classification", n_classes=2)
    frames = {s: data.where(F.col("split") == s) for s in ("train", "validation")}
    curve = V.learning_curve(m.model, frames).groupBy("series").agg(F.count(F.lit(1)).alias("rounds"), F.max_by("loss", "round").alias("last")).collect()
    own = F.get("probability", F.col("label").cast("int"))
    loss = {f"{s}_loss": m.predict(df).agg(F.avg(-2 * F.log(own))).first()[0] for s, df in frames.items()}
    return spark.createDataFrame([(r["series"], r["rounds"], abs(r["last"] - loss[r["series"]]) < 1e-6) for r in curve],
                                 "series string, rounds long, last_is_the_models_loss boolean")


for _qid, _algo, _params in [
        ("M04_logistic_regression", "logistic_regression", {"C": 1.0}),
        ("M05_decision_tree", "decision_tree", {"max_depth": 4}),
        ("M06_random_forest", "random_forest", {"n_estimators": 20, "max_depth": 5}),
        ("M07_gradient_boosting", "gradient_boosting", {"n_estimators": 10}),
        ("M08_adaboost", "adaboost", {"n_estimators": 5}),
        ("M09_linear_svm", "svm", {"C": 1.0}),
        ("M11_naive_bayes", "gaussian_nb", {}),
        ("M12_voting", "voting", {"n_estimators": 10}),
        ("M13_stacking", "stacking", {"cv": 3}),
        ("M14_mlp", "mlp", {"hidden_sizes": [8], "epochs": 30})]:
    _rows = _model_rows(_algo, params=_params)
    register(_qid)(_rows)
    register(f"{_qid}_checks", MODEL_CHECK_SQL)(_model_checks(_rows, _algo != "svm"))


@register("M15_candidate_comparison")
def q_compare(spark, d):
    """Fit candidates on train, score on validation, rank by the metric direction."""
    data = _doc_features(spark, d)
    train = data.where(F.col("split") == "train")
    val = data.where(F.col("split") == "validation")
    results = []
    for name, algo, params in [("dummy", "dummy", {}), ("logistic", "logistic_regression", {}),
                               ("tree", "decision_tree", {"max_depth": 3})]:
        m = M.fit_model(M.ModelConfig("sklearn", algo, params), train, "classification", n_classes=2)
        met = V.classification_metrics(m.predict(val), 2, prob="probability").first().asDict()
        results.append({"candidate": name, **{k: met.get(k) for k in ("accuracy", "f1_macro", "log_loss", "roc_auc")}})
    direction = V.validate_metric("f1_macro", "classification")
    winner = M.choose_winner(results, "f1_macro", direction)["candidate"]
    rows = [(r["candidate"], r["accuracy"], r["f1_macro"], r["log_loss"], r["roc_auc"], r["candidate"] == winner)
            for r in results]
    return spark.createDataFrame(rows, "candidate string, accuracy double, f1_macro double, log_loss double, "
                                       "roc_auc double, winner boolean")


@register("M15_candidate_comparison_checks", f"""
WITH s AS (SELECT x.doc_id, x.split, l.quality FROM ({_rank_split_sql(DOCS_LABELED, "doc_id", "CAST(quality AS VARCHAR)")}) x
  JOIN {DOCS_LABELED} l ON x.doc_id = l.doc_id),
m AS (SELECT quality FROM s WHERE split = 'train' GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)
SELECT 3::BIGINT AS candidates, 1::BIGINT AS winners, true AS winner_is_best, round(avg((s.quality = m.quality)::INT), 9) AS baseline_accuracy
FROM s, m WHERE split = 'validation'""")
def q_compare_checks(spark, d):
    """One winner, which none of the candidates beats, and the baseline's accuracy is the share of the commonest class."""
    rows = q_compare(spark, d)
    best = F.max("f1_macro") == F.max(F.when(F.col("winner"), F.col("f1_macro")))
    base = F.max(F.when(F.col("candidate") == "dummy", F.col("accuracy")))
    return rows.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("winner").alias("winners"), best.alias("winner_is_best"),
                    F.round(base, 9).alias("baseline_accuracy"))


@register("V09_test_evaluation")
def q_test_eval(spark, d):
    """The chosen candidate evaluated once on the held-out test split."""
    data = _doc_features(spark, d)
    m = M.fit_model(M.ModelConfig("sklearn", "logistic_regression"), data.where(F.col("split") == "train"),
                    "classification", n_classes=2)
    return V.classification_metrics(m.predict(data.where(F.col("split") == "test")), 2, prob="probability")


EMB_SPLIT_SQL = _rank_split_sql("embeddings", "vec_id", "''")


@register("M10_knn_exact", f"""
WITH s AS ({EMB_SPLIT_SQL}),
tr AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN s USING (vec_id) WHERE split = 'train'),
qu AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN s USING (vec_id) WHERE split <> 'train'),
d AS (SELECT qu.vec_id AS qid, tr.vec_id AS tid, tr.label, list_distance(qu.v, tr.v) AS dist FROM qu, tr),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rk FROM d) WHERE rk <= 5),
votes AS (SELECT qid, label, count(*) AS w FROM nb GROUP BY 1, 2)
SELECT qid AS vec_id, label AS prediction, CAST(w AS DOUBLE) AS votes FROM
  (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, label) AS r FROM votes) WHERE r = 1""")
def q_knn(spark, d):
    from tessera.operators.neighbors import knn_predict
    emb = table(spark, d, "embeddings")
    s = split_assign(emb.select("vec_id"), SplitConfig("random"), "vec_id")
    e2 = emb.join(s, "vec_id")
    train = e2.where(F.col("split") == "train").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    query = e2.where(F.col("split") != "train").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    out = knn_predict(train, query, 5, "label")
    return out.select(F.col("qid").alias("vec_id"), "prediction", "votes")
