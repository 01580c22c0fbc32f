"""Registered source/sink, set-operation and streaming queries (S*, U*, T*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.drift import drift, file_profiles
from tessera.operators.splitting import SplitConfig, presplit
from tessera.plans.prep_queries import _alloc_sql
from tessera.plans.recipe import Recipe, fit_recipe
from tessera.plans.registry import LINEITEM_NULLS_SQL, lineitem_with_nulls, register, rounded, table
from tessera.session import checkpoint_dir, cut_lineage
from tessera.sources import readers as S
from tessera.streaming import streams as T


def _scratch(spark, name):
    return checkpoint_dir(spark).rstrip("/") + f"/outputs/{name}-{uuid.uuid4().hex}"


@register("S03_parquet_scan_projection", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def q_scan(spark, d):
    o = S.open_dataset(spark, f"{d}/orders.parquet")
    return S.select_columns(o.where(F.col("o_orderstatus") == "F"), ["o_orderkey", "o_totalprice"])


@register("S05_column_selection", "SELECT l_tax, l_orderkey, l_linenumber FROM lineitem")
def q_select_cols(spark, d):
    return S.select_columns(table(spark, d, "lineitem"), ["l_tax", "l_orderkey", "l_linenumber"])


@register("S09_parquet_sink_roundtrip", f"SELECT * FROM {LINEITEM_NULLS_SQL} t")
def q_parquet_sink(spark, d):
    path = _scratch(spark, "lineitem")
    n = S.write_parquet(lineitem_with_nulls(spark, d), path, partition_by=())
    back = spark.read.parquet(path)
    if n != back.count():
        raise ValueError("Row count changed between write and read back")
    return back


@register("S11_csv_sink_roundtrip", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
FROM orders""")
def q_csv_sink(spark, d):
    path = _scratch(spark, "orders-csv")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    S.write_csv(table(spark, d, "orders").select(*cols), path)
    back = S.open_dataset(spark, [path + "/" + f for f in sorted(S.list_names(spark, path)) if f.endswith(".csv")],
                          fmt="csv", dtype={"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"})
    return back.select(*cols)


@register("S04_json_roundtrip", "SELECT event_id, event_type, value FROM events")
def q_json(spark, d):
    path = _scratch(spark, "events-json")
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(path)
    return S.open_dataset(spark, path, fmt="json", dtype={"event_id": "bigint"}).select("event_id", "event_type", "value")


DOC_TRAIN = "(SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id))"


@register("S12_presplit_carve_validation", f"""
WITH e AS (SELECT doc_id AS k, '' AS cls, sha256('42' || chr(0) || CAST(doc_id AS VARCHAR)) AS pr FROM {DOC_TRAIN} x),
{_alloc_sql("SELECT cls, count(*) AS n FROM e GROUP BY cls", (0.75, 0.25, 0.0))},
r AS (SELECT k, cls, row_number() OVER (ORDER BY pr, CAST(k AS VARCHAR)) - 1 AS rk FROM e)
SELECT k AS doc_id, CASE WHEN rk < c0 THEN 'train' ELSE 'validation' END AS split FROM r JOIN alloc USING (cls)
UNION ALL SELECT doc_id, 'test' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_presplit(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    frames = S.presplit_frames({"train": docs.join(lab, "doc_id"), "test": docs.join(lab, "doc_id", "left_anti")})
    out = presplit(frames, SplitConfig("random"), "doc_id", target="quality", validation_fraction=0.25)
    return out.select("doc_id", "split")


@register("S14_source_fingerprint")
def q_fingerprint(spark, d):
    fp = S.fingerprint(table(spark, d, "lineitem"))
    return spark.createDataFrame([(fp["rows"], fp["hash_sum"], fp["schema"])], "rows long, hash_sum string, schema string")


@register("S09_unified_types", """
SELECT o_orderkey::BIGINT AS o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN trunc(o_totalprice) ELSE o_totalprice END)::DOUBLE AS amount,
  CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderstatus END AS status, true AS one_scan_each FROM orders""")
def q_unified(spark, d):
    """Orders in files of three schemas (whole, fractional and float amounts, one without statuses, columns in other orders),
    landed as one table of joined types; the scans are as many as the schemas, not the files."""
    path, o = _scratch(spark, "orders-kinds"), table(spark, d, "orders").repartition(6)
    part = lambda i, *c: o.where(F.col("o_orderkey") % 3 == i).select(*c).write.parquet(f"{path}/{i}")
    part(0, F.col("o_orderkey").cast("int"), F.floor("o_totalprice").cast("int").alias("amount"), F.col("o_orderstatus").alias("status"))
    part(1, F.col("o_orderstatus").alias("status"), "o_orderkey", F.col("o_totalprice").alias("amount"))
    part(2, F.col("o_totalprice").alias("amount"), F.lit(None).cast("void").cast("string").alias("status"), "o_orderkey")
    S.write_unified(spark, f"{path}/*/*.parquet", f"{path}-landed")
    scans = S.open_dataset(spark, f"{path}/*/*.parquet")._jdf.queryExecution().sparkPlan().toString().count("FileScan")
    landed = spark.read.parquet(f"{path}-landed")
    return landed.select("o_orderkey", "amount", "status").withColumn("one_scan_each", F.lit(scans == 3))


@register("S14_fingerprint_checks", "SELECT count(*) AS rows, true AS same_in_any_order, false AS same_without_a_row, "
          "false AS same_with_another_value, false AS same_with_another_type FROM lineitem")
def q_fingerprint_checks(spark, d):
    """The digest of lineitem ignores order and partitions and changes with any row, value or type."""
    li = table(spark, d, "lineitem")
    own = S.fingerprint(li)
    same = lambda df: S.fingerprint(df)["digest"] == own["digest"]
    last = li.agg(F.max(F.struct("l_orderkey", "l_linenumber"))).first()[0]
    one = (F.col("l_orderkey") == last[0]) & (F.col("l_linenumber") == last[1])
    return spark.createDataFrame([(own["rows"], same(li.repartition(7).orderBy("l_partkey")), same(li.where(~one)),
                                   same(li.withColumn("l_tax", F.when(one, F.col("l_tax") + 1).otherwise(F.col("l_tax")))),
                                   same(li.withColumn("l_linenumber", F.col("l_linenumber").cast("string"))))],
                                 "rows long, same_in_any_order boolean, same_without_a_row boolean, "
                                 "same_with_another_value boolean, same_with_another_type boolean")


@register("U01_union_by_name", """SELECT n_nationkey, n_name, n_regionkey FROM nation
UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier""")
def q_union(spark, d):
    """Two tables with their columns in different orders, opened as one dataset by name."""
    path = _scratch(spark, "union")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.parquet(f"{path}/a")
    table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_regionkey"), F.col("s_name").alias("n_name"),
                                       F.col("s_suppkey").alias("n_nationkey")).write.parquet(f"{path}/b")
    return S.open_dataset(spark, f"{path}/*/*.parquet").select("n_nationkey", "n_name", "n_regionkey")


@register("U02_drop_duplicates", """SELECT count(*) AS rows, count(DISTINCT text) AS distinct_texts,
  count(*) - count(DISTINCT text) AS duplicates_removed FROM documents""")
def q_dedupe(spark, d):
    """One grouped count over digests of the texts: rows, and what is left when each text is kept once."""
    texts = table(spark, d, "documents").groupBy(F.unhex(F.sha2("text", 256)).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_texts"))
    return total.withColumn("duplicates_removed", F.col("rows") - F.col("distinct_texts"))


@register("U04_train_class_coverage", """WITH s AS (SELECT DISTINCT o_orderstatus FROM orders)
SELECT o_orderstatus FROM s WHERE o_orderstatus NOT IN (SELECT o_orderstatus FROM orders)""")
def q_coverage(spark, d):
    """Classes of a stratified split of all orders that its training part does not have."""
    from tessera.operators.encoding import unseen_classes
    from tessera.operators.splitting import split_assign
    # order keys may repeat: a written row number tells equal orders apart
    o = cut_lineage(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.monotonically_increasing_id().alias("row")))
    s = split_assign(o, SplitConfig("stratified"), ["o_orderkey", "row"], target="o_orderstatus")
    return unseen_classes(s.where(F.col("split") != "excluded"), s.where(F.col("split") == "train"), "o_orderstatus")


def _events_stream(spark, d):
    path = f"{d}/events.parquet"
    return T.read_stream(spark, path, spark.read.parquet(path).schema)


@register("T01_recipe_on_stream", """SELECT event_id, upper(event_type) AS event_type,
  coalesce(CASE WHEN value > 40 THEN NULL ELSE value END, (SELECT avg(value) FROM events WHERE value <= 40)) AS value
FROM events""")
def q_stream_recipe(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type",
                                          F.when(F.col("value") <= 40, F.col("value")).alias("value"))
    r = Recipe()
    r.add("normalize_categories", columns=["event_type"], case="upper")
    r.add("fill_missing", columns=["value"], strategy="mean")
    fitted = fit_recipe(r.approve_all(), ev.select("event_type", "value"))
    stream = _events_stream(spark, d).select("event_id", "event_type",
                                             F.when(F.col("value") <= 40, F.col("value")).alias("value"))
    out = T.run_available(T.apply_recipe_stream(stream, fitted, carried=["event_id"]), "append")
    return rounded(out.select("event_id", "event_type", "value"), {})


@register("T03_stream_profile", """SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS value_missing,
  count(value) AS value_n, round(sum(value), 6) AS value_sum, round(avg(value), 8) AS value_mean,
  round(var_samp(value), 6) AS value_variance, min(value) AS value_min, max(value) AS value_max
FROM events GROUP BY 1""")
def q_stream_profile(spark, d):
    out = T.run_available(T.profile_stream(_events_stream(spark, d), ["value"], "event_type"), "complete")
    return rounded(out, {"value_sum": 6, "value_mean": 8, "value_variance": 6})


@register("T04_stream_period_counts", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, count(*) AS count,
  round(avg(value), 8) AS mean FROM events GROUP BY 1""")
def q_stream_periods(spark, d):
    out = T.run_available(T.period_counts_stream(_events_stream(spark, d), "ts", "1 day", "1 hour", "value"), "complete")
    return rounded(out, {"mean": 8}).withColumn("period", F.col("period").cast("timestamp_ntz"))


@register("T02_score_stream", """
WITH m AS (SELECT regr_slope(value, hour(ts)) AS a, regr_intercept(value, hour(ts)) AS b FROM events)
SELECT event_id, value, round(a * hour(ts) + b, 6) AS prediction FROM events, m""")
def q_stream_score(spark, d):
    """A model fitted on batch events scores the event stream (regression of value on the
    hour of day, MLlib linear regression)."""
    from tessera.operators import encoding as E
    from tessera.operators import models as M
    ev = table(spark, d, "events").withColumn("hour", F.hour("ts").cast("double"))
    enc = E.fit_encoder(ev, {"hour": "numeric"})
    model = M.fit_model(M.ModelConfig("sklearn", "linear_regression"), enc.transform(ev).withColumn("label", F.col("value")),
                        "regression")
    stream = _events_stream(spark, d).withColumn("hour", F.hour("ts").cast("double"))
    scored = model.predict(enc.transform(stream)).select("event_id", "value", "prediction")
    return rounded(T.run_available(scored, "append"), {"prediction": 6})


@register("G21_file_drift", """
WITH p AS (SELECT o_orderkey % 4 AS part, o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders),
q AS (SELECT part, o_orderkey, CASE WHEN part = 3 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey,
        CASE WHEN part = 3 AND o_orderkey % 8 = 3 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM p),
s AS (SELECT 100.0 * count(*) FILTER (part = 3 AND o_orderstatus IS NULL) / count(*) FILTER (part = 3) AS own FROM q)
SELECT 3::BIGINT AS part, 'o_totalprice' AS "column", 'dtype_drift' AS code, 'string' AS own, 'double' AS others
UNION ALL SELECT 3, 'o_orderstatus', 'missing_drift', printf('%.2f%%', own), '0.00%' FROM s
UNION ALL SELECT 3, 'o_custkey', 'range_drift', (SELECT min(o_custkey)::DOUBLE || '..' || max(o_custkey)::DOUBLE FROM q WHERE part = 3),
  (SELECT min(o_custkey)::DOUBLE || '..' || max(o_custkey)::DOUBLE FROM q WHERE part < 3)""")
def q_drift(spark, d):
    """Orders in four files, the last with amounts as text, keys in another range and half of its statuses missing."""
    path, o = _scratch(spark, "drift"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    for i in range(4):
        part = o.where(F.col("o_orderkey") % 4 == i).repartition(1)
        if i == 3:
            part = part.withColumns({"o_totalprice": F.col("o_totalprice").cast("string"), "o_custkey": F.col("o_custkey") + 1_000_000,
                                     "o_orderstatus": F.when(F.col("o_orderkey") % 8 != 3, F.col("o_orderstatus"))})
        part.write.parquet(f"{path}/part={i}")
    found = drift(file_profiles(spark, f"{path}/*/*.parquet"))
    return found.select(F.regexp_extract("file", "part=([0-9])", 1).cast("long").alias("part"), "column", "code", "own", "others")


V10_SQL = """
WITH c AS (
  SELECT o_orderpriority AS candidate, o_orderstatus AS run, avg(o_totalprice) AS score FROM orders GROUP BY ALL),
r AS (
  SELECT 'a' AS preparation, CASE run WHEN 'P' THEN 'training' WHEN 'F' THEN 'validation' ELSE 'test' END AS basis, run, candidate, score FROM c
  UNION ALL SELECT 'b', 'test', run, candidate, -score FROM c)
SELECT 'orders' AS dataset, 'price' AS task, preparation, basis, run, candidate, round(score, 4) AS score,
  row_number() OVER (PARTITION BY preparation, basis ORDER BY score DESC, run, candidate) AS rank, basis = 'training' AS fallback FROM r"""


@register("V10_comparison_cohorts", V10_SQL)
def q_cohorts(spark, d):
    """Runs with scores taken from the orders, recorded in a ledger on two preparations, some with training scores alone."""
    from tessera.operators.ledger import Ledger, Run, cohorts
    found = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("score")).collect()
    ledger = Ledger(spark, _scratch(spark, "ledger"))
    basis = {"P": ["training"], "F": ["validation", "training"], "O": ["test", "validation"]}
    for status in sorted({r["o_orderstatus"] for r in found}):
        own = {r["o_orderpriority"]: {"r2": r["score"], "mae": 0.0} for r in found if r["o_orderstatus"] == status}
        ledger.record(Run(status, "orders", "price", "a", {b: own for b in basis[status]}))
        ledger.record(Run(status, "orders", "price", "b", {"test": {c: {"r2": -m["r2"]} for c, m in own.items()}}))
    return rounded(cohorts(ledger.runs(), "r2", "max"), {"score": 4})
