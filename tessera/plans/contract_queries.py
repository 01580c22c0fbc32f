"""Registered rows of contracts over the given tables: reading files, recipes, guards, persistence (S*, P*, R*, L07, E01, ...).

Each row shows data that the contract let through, and as booleans the refusals that it must make.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import encoding as E
from tessera.operators import evaluation as V
from tessera.operators import models as M
from tessera.operators import sampling as Q
from tessera.operators import scoring as Y
from tessera.operators.splitting import SplitConfig, check_splits, split_assign
from tessera.plans import recipe as R
from tessera.plans.registry import lineitem_with_nulls, register, rounded, table
from tessera.session import checkpoint_dir
from tessera.sources import readers as S


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/contracts/{name}-{uuid.uuid4().hex}"


def _refuses(fn, *args, **how) -> bool:
    try:
        fn(*args, **how)
    except ValueError:
        return True
    return False


# reading

def _renamed(spark, folder: str, name: str) -> str:
    """The one part file in ``folder`` under another name beside it."""
    part = next(n for n in S.list_names(spark, folder) if n.startswith("part-"))
    fs, old = S._hadoop_path(spark, f"{folder}/{part}")
    _, new = S._hadoop_path(spark, f"{folder}/{name}")
    if not fs.rename(old, new):
        raise OSError(f"{folder}/{part} cannot be renamed")
    return f"{folder}/{name}"


@register("S02_separators", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def q_separators(spark, d):
    """Customers in a comma, a tab and a semicolon file, opened by extension and by the first line."""
    c, path, files = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), _scratch(spark, "separators"), []
    for i, (sep, name) in enumerate(((",", "a.csv"), ("\t", "b.tsv"), (";", "c.txt"))):
        c.where(F.col("c_custkey") % 3 == i).coalesce(1).write.option("header", True).option("sep", sep).csv(f"{path}/{i}")
        files.append(_renamed(spark, f"{path}/{i}", name))
    return S.open_dataset(spark, files, dtype={"c_custkey": "bigint"})


@register("S06_schema_agreement", """
SELECT o_orderkey, o_custkey, o_orderstatus, true AS refuses_other_names FROM orders""")
def q_agreement(spark, d):
    """Files with one set of names in any order are one dataset; another set is refused."""
    o, path = table(spark, d, "orders"), _scratch(spark, "names")
    for i, names in enumerate((["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderstatus", "o_orderkey", "o_custkey"])):
        o.where(F.col("o_orderkey") % 2 == i).select(*names).write.parquet(f"{path}/{i}")
    o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status")).write.parquet(f"{path}/other")
    refused = _refuses(S.open_dataset, spark, f"{path}/*/*.parquet")
    return S.open_dataset(spark, f"{path}/[01]/*.parquet").withColumn("refuses_other_names", F.lit(refused))


@register("S07_types_while_reading", """
SELECT lpad(c_custkey::VARCHAR, 6, '0') AS code, c_acctbal::VARCHAR AS balance, true AS refuses_unknown FROM customer""")
def q_types(spark, d):
    """Codes keep their leading zeros and balances their digits when a CSV file is read as text."""
    path = _scratch(spark, "typed")
    c = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"), F.col("c_acctbal").alias("balance"))
    c.write.option("header", True).csv(path)
    read = S.open_dataset(spark, path, dtype={"code": "string", "balance": "string"})
    return read.withColumn("refuses_unknown", F.lit(_refuses(S.open_dataset, spark, path, dtype={"none": "int"})))


@register("S08_schema_report", """
SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type FROM (DESCRIBE SELECT * FROM lineitem)""")
def q_schema(spark, d):
    return spark.createDataFrame(S.schema_report(table(spark, d, "lineitem")), "column string, type string")


@register("S13_row_limits", """
SELECT count(*) AS rows, true AS accepts_as_many, true AS refuses_more, true AS refuses_none FROM orders""")
def q_limits(spark, d):
    o = table(spark, d, "orders")
    n = o.count()
    return spark.createDataFrame([(n, not _refuses(S.require_rows, o, n), _refuses(S.require_rows, o, n - 1), _refuses(S.require_rows, o.where("false")))],
                                 "rows long, accepts_as_many boolean, refuses_more boolean, refuses_none boolean")


# recipes

def _filled(**how) -> R.Recipe:
    r = R.Recipe()
    r.add("fill_missing", columns=["l_quantity"], **how)
    return r.approve_all()


FILLED_SQL = """
WITH m AS (SELECT avg(l_quantity) AS m FROM lineitem WHERE l_orderkey % 7 <> 0)
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_orderkey % 7 = 0 THEN m ELSE l_quantity END, 6) AS l_quantity{more} FROM lineitem, m"""


@register("S10_versioned_outputs", """
SELECT v AS version, count(*) AS rows, true AS sidecar_agrees FROM orders, (SELECT unnest([1, 2]) AS v) GROUP BY v""")
def q_versions(spark, d):
    """A recipe executed twice on orders lands in v1 and v2, each with a sidecar that says what is there."""
    import json
    o, base, out = table(spark, d, "orders").select("o_orderkey", "o_custkey"), _scratch(spark, "versions"), []
    recipe = R.Recipe()
    recipe.add("rename_columns", columns=["o_custkey"], names=["customer"])
    recipe.approve_all()
    for v in (1, 2):
        R.execute_recipe(recipe, o, base)
        noted = json.loads(spark.read.text(f"{base}/v{v}.json", wholetext=True).first()[0])
        rows = spark.read.parquet(f"{base}/v{v}").count()
        out.append((v, rows, noted["rows"] == rows and noted["recipe_fingerprint"] == recipe.fingerprint()))
    return spark.createDataFrame(out, "version int, rows long, sidecar_agrees boolean")


@register("R08_execute_approved_recipe", FILLED_SQL.format(more=", true AS refuses_without_fit_source"))
def q_execute(spark, d):
    """A learned fill is executed with an explicit fit source, and refused without."""
    li, base, recipe = lineitem_with_nulls(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), _scratch(spark, "executed"), _filled(strategy="mean")
    refused = _refuses(R.execute_recipe, recipe, li, base)
    landed = spark.read.parquet(R.execute_recipe(recipe, li, base, fit_source=li)["path"])
    return rounded(landed.withColumn("refuses_without_fit_source", F.lit(refused)), {"l_quantity": 6})


@register("P08_fallback_fill", """
SELECT o_orderkey, 7.5::DOUBLE AS gone, true AS refuses_without_fallback FROM orders""")
def q_fallback(spark, d):
    """A column without any value is filled with the fallback, and refused where none is given."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") < 0, 1.0).alias("gone"))
    recipe, bare = R.Recipe(), R.Recipe()
    recipe.add("fill_missing", columns=["gone"], strategy="mean", fallback=7.5)
    bare.add("fill_missing", columns=["gone"], strategy="mean")
    refused = _refuses(R.fit_recipe, bare.approve_all(), o)
    return R.fit_recipe(recipe.approve_all(), o).apply(o).withColumn("refuses_without_fallback", F.lit(refused))


@register("P22_input_columns", FILLED_SQL.format(more=", true AS refuses_extra, true AS refuses_missing"))
def q_inputs(spark, d):
    """Columns in another order are put right; extra ones pass only where the caller is not strict, missing ones never."""
    li = lineitem_with_nulls(spark, d).select("l_orderkey", "l_linenumber", "l_quantity")
    fitted = R.fit_recipe(_filled(strategy="mean"), li)
    other = li.select("l_quantity", F.lit(1).alias("extra"), "l_linenumber", "l_orderkey")
    out = fitted.apply(other, strict=False)
    return rounded(out.withColumns({"refuses_extra": F.lit(_refuses(fitted.apply, other)),
                                    "refuses_missing": F.lit(_refuses(fitted.apply, li.drop("l_quantity"), strict=False))}), {"l_quantity": 6})


@register("R03_saved_recipe", FILLED_SQL.format(more=""))
def q_saved(spark, d):
    """A fitted recipe that was saved and loaded does what it did."""
    li, path = lineitem_with_nulls(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), _scratch(spark, "recipe") + ".json"
    R.fit_recipe(_filled(strategy="mean"), li).save(spark, path)
    return rounded(R.FittedRecipe.load(spark, path).apply(li), {"l_quantity": 6})


@register("R04_review_states", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN 1.0 ELSE l_quantity END::DOUBLE AS l_quantity,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus FROM lineitem""")
def q_review(spark, d):
    """Only approved steps take effect: of four, one is approved, one rejected, one proposed and one edited after approval."""
    li = lineitem_with_nulls(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus")
    r = R.Recipe()
    r.add("fill_missing", columns=["l_quantity"], strategy="constant", value=1.0).approve()
    r.add("drop_columns", columns=["l_linenumber"]).reject()
    r.add("fill_missing", columns=["l_linestatus"], strategy="constant", value="none")
    edited = r.add("drop_columns", columns=["l_linestatus"])
    edited.approve()
    edited.edit({"columns": ["l_orderkey"]})
    return R.fit_recipe(r, li).apply(li)


@register("R05_static_validation", """
SELECT column_name AS "column", true AS needs_fit FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_name <> 'l_tax'
UNION ALL SELECT 'levy', true""")
def q_static(spark, d):
    """Output columns of a recipe, and that it needs a fit, without reading rows."""
    r = R.Recipe()
    r.add("rename_columns", columns=["l_tax"], names=["levy"])
    r.add("fill_missing", columns=["levy"], strategy="median")
    told = R.validate_recipe(r.approve_all(), table(spark, d, "lineitem").columns)
    return spark.createDataFrame([(c, told["requires_fit"]) for c in told["output_columns"]], "column string, needs_fit boolean")


@register("F06_recipe_digest", """
SELECT sha256('[{"name":"fill_missing","params":{"columns":["l_quantity"],"strategy":"constant","value":' ||
  max(l_linenumber)::VARCHAR || '}}]') AS digest FROM lineitem""")
def q_digest(spark, d):
    """The digest of a recipe whose value is taken from the table: SHA-256 of its canonical JSON."""
    most = table(spark, d, "lineitem").agg(F.max("l_linenumber")).first()[0]
    r = R.Recipe()
    r.add("fill_missing", value=int(most), strategy="constant", columns=["l_quantity"])
    return spark.createDataFrame([(r.approve_all().fingerprint(),)], "digest string")


# guards, models

@register("L07_split_guards", """
SELECT split, count(*) AS rows, true AS refuses_small_class, true AS refuses_empty_split, true AS refuses_one_class
FROM (SELECT row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM orders) o,
  LATERAL (SELECT CASE WHEN i < round(n * 0.7) THEN 'train' WHEN i < round(n * 0.7) + round(n * 0.15) THEN 'validation' ELSE 'test' END AS split)
GROUP BY split""")
def q_guards(spark, d):
    """Sizes of a split that passes its guards, and the refusals of ones that do not."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    split = split_assign(o, SplitConfig("random", 0.7, 0.15, 0.15), "o_orderkey")
    small = o.withColumn("y", F.when(F.col("o_orderkey") == 1, "rare").otherwise("common"))
    one = split.withColumn("y", F.lit("same"))
    group = o.withColumn("g", F.lit(1))
    told = {"refuses_small_class": _refuses(split_assign, small, SplitConfig("stratified"), "o_orderkey", target="y"),
            "refuses_empty_split": _refuses(split_assign, group, SplitConfig("group", group_column="g"), "o_orderkey"),
            "refuses_one_class": _refuses(check_splits, one, SplitConfig("random", 0.7, 0.15, 0.15), "y")}
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).withColumns({k: F.lit(v) for k, v in told.items()})


@register("E01_feature_schema", """
SELECT column_name AS "column", CASE WHEN column_type = 'VARCHAR' OR column_name = 'l_linenumber' THEN 'categorical' ELSE 'numeric' END AS kind,
  true AS refuses_dates FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_name <> 'l_shipdate'""")
def q_feature_schema(spark, d):
    li = table(spark, d, "lineitem")
    kinds = E.infer_feature_schema(li, [c for c in li.columns if c != "l_shipdate"], ["l_linenumber"])
    refused = _refuses(E.infer_feature_schema, li, li.columns)
    return spark.createDataFrame([(c, k, refused) for c, k in kinds.items()], "column string, kind string, refuses_dates boolean")


@register("M17_saved_models", """
SELECT a AS algorithm, true AS same_predictions, (SELECT count(*) FROM part) AS rows
FROM (SELECT unnest(['decision_tree', 'ridge', 'dummy', 'voting']) AS a)""")
def q_saved_models(spark, d):
    """Models of the price of part, saved and loaded, predict the same for every row."""
    p = table(spark, d, "part")
    data = E.fit_encoder(p, {"p_size": "numeric", "p_partkey": "numeric"}).transform(p).withColumn("label", F.col("p_retailprice"))
    out = []
    for algorithm, params in (("decision_tree", {}), ("ridge", {}), ("dummy", {}), ("voting", {"n_estimators": 3})):
        path = _scratch(spark, algorithm)
        model = M.fit_model(M.ModelConfig("sklearn", algorithm, params), data, "regression")
        model.save(path)
        again = M.TrainedModel.load(path)
        out.append((algorithm, M.same_predictions(model, again, data, "p_partkey"), again.predict(data).count()))
    return spark.createDataFrame(out, "algorithm string, same_predictions boolean, rows long")


@register("V08_metric_directions", """
WITH g AS (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS a, avg(o_totalprice) OVER () AS b FROM orders),
e AS (SELECT avg(abs(o_totalprice - a)) AS ma, avg(abs(o_totalprice - b)) AS mb, sum((o_totalprice - a) ** 2) AS sa, sum((o_totalprice - b) ** 2) AS sb FROM g)
SELECT 'mae' AS metric, 'min' AS direction, CASE WHEN ma <= mb THEN 'by_priority' ELSE 'overall' END AS winner, true AS refused_for_classes FROM e
UNION ALL SELECT 'r2', 'max', CASE WHEN sa <= sb THEN 'by_priority' ELSE 'overall' END, true FROM e""")
def q_directions(spark, d):
    """Two predictions of the price of orders, ranked by each metric in its direction."""
    o = table(spark, d, "orders").withColumn("label", F.col("o_totalprice"))
    by = {"by_priority": F.avg("label").over(Window.partitionBy("o_orderpriority")), "overall": None}
    whole = o.agg(F.avg("label")).first()[0]
    results = []
    for name, prediction in by.items():
        scored = o.withColumn("prediction", F.lit(whole) if prediction is None else prediction)
        results.append({"candidate": name, **V.regression_metrics(scored).first().asDict()})
    out = []
    for metric in ("mae", "r2"):
        direction = V.validate_metric(metric, "regression")
        out.append((metric, direction, M.choose_winner(results, metric, direction)["candidate"], _refuses(V.validate_metric, metric, "classification")))
    return spark.createDataFrame(out, "metric string, direction string, winner string, refused_for_classes boolean")


@register("Q06_leaderboard", """
WITH s AS (SELECT o_orderpriority AS run, o_orderstatus AS candidate,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE count(*) % 50 END::DOUBLE AS score FROM orders GROUP BY o_orderpriority, o_orderstatus)
SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, run, candidate) AS place, run, candidate, score FROM s""")
def q_leaderboard(spark, d):
    """Scores with ties and gaps in the order of a leaderboard: missing ones last, ties by run and candidate."""
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("candidate")).agg(
        F.count(F.lit(1)).alias("n")).select("run", "candidate", F.when(F.col("candidate") != "P", F.col("n") % 50).cast("double").alias("score"))
    rows = Q.leaderboard(s, "score", "max").collect()  # a row per candidate
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "place long, run string, candidate string, score double")


@register("F07_usable_values", """
SELECT count(*) AS rows, count(*) FILTER (length(regexp_replace(coalesce(text, ''), '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')) > 0) AS with_text,
  count(*) FILTER (n_chars > 0) AS positive FROM documents""")
def q_usable(spark, d):
    """Rows with a text that is not blank, and with a positive finite number."""
    from tessera.functions.columns import is_finite, strip_ws
    docs = table(spark, d, "documents")
    return docs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.length(strip_ws(F.coalesce("text", F.lit("")))) > 0).alias("with_text"),
                    F.count_if(is_finite("n_chars") & (F.col("n_chars") > 0)).alias("positive"))


@register("Y04_sorted_probabilities", """
WITH p AS (SELECT p_partkey, p_size / 100.0 AS a, (1 - p_size / 100.0) * 0.5 AS b FROM part),
l AS (SELECT p_partkey, unnest([{'c': 'x', 'p': a}, {'c': 'y', 'p': b}, {'c': 'z', 'p': b}]) AS s FROM p)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY s.p DESC, s.c) AS place, s.c AS class, round(s.p, 9)::DOUBLE AS probability,
  s.c = 'y' AS correct FROM l""")
def q_sorted_probabilities(spark, d):
    """Class probabilities of each part, the likeliest first and equal ones by class, and whether the class is the true one."""
    a = F.col("p_size") / 100.0
    p = table(spark, d, "part").select("p_partkey", a.alias("probability_0"), ((1 - a) * 0.5).alias("probability_1"), ((1 - a) * 0.5).alias("probability_2"))
    ranked = Y.sorted_probabilities(p, ["x", "y", "z"]).select("p_partkey", F.posexplode("ranked").alias("at", "r")).select(
        "p_partkey", (F.col("at") + 1).cast("long").alias("place"), F.col("r.class").alias("class"), F.col("r.probability").alias("probability"),
        F.col("r.class").alias("prediction"), F.lit("y").alias("truth"))
    return rounded(Y.with_residuals(ranked, "truth", "classification").drop("prediction", "truth"), {"probability": 9})
