"""Registered recipe-step, split and prepare-task queries (P*, L*, R09, G22, U03) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import transforms as X
from tessera.operators.splitting import SplitConfig, class_counts, overlap, split_assign
from tessera.plans.prepare import TaskConfig, eligible_rows, prepare_task
from tessera.plans.recipe import FittedRecipe, Recipe, fit_recipe, suggest_recipe
from tessera.plans.registry import LINEITEM_NULLS_SQL, lineitem_with_nulls, register, rounded, table

LI = LINEITEM_NULLS_SQL


def _apply(step, df):
    state = step.fit(df) if step.requires_fit else {}
    return step.apply(df, state)


@register("P01_select_columns", "SELECT o_orderpriority, o_orderkey FROM orders")
def q_select(spark, d):
    return _apply(X.SelectColumns(["o_orderpriority", "o_orderkey"]), table(spark, d, "orders"))


@register("P02_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def q_drop(spark, d):
    return _apply(X.DropColumns(["o_totalprice", "o_orderpriority"]), table(spark, d, "orders"))


@register("P03_rename_columns", "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def q_rename(spark, d):
    return _apply(X.RenameColumns(["n_nationkey", "n_name"], ["nation_id", "nation"]), table(spark, d, "nation"))


@register("P04_fill_constant", f"SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0.0) AS l_quantity FROM {LI} t")
def q_fill_const(spark, d):
    df = lineitem_with_nulls(spark, d).select("l_orderkey", "l_linenumber", "l_quantity")
    return _apply(X.FillMissing(["l_quantity"], "constant", 0.0), df)


@register("P05_fill_mean", f"""SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {LI} a)), 6) AS l_quantity FROM {LI} t""")
def q_fill_mean(spark, d):
    df = lineitem_with_nulls(spark, d).select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(_apply(X.FillMissing(["l_quantity"], "mean"), df), {"l_quantity": 6})


@register("P06_fill_median", f"""SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {LI} a)), 6) AS l_quantity,
  round(coalesce(CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END,
        (SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem WHERE l_orderkey % 5 <> 0)), 6) AS l_extendedprice
FROM {LI} t""")
def q_fill_median(spark, d):
    df = lineitem_with_nulls(spark, d).select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")).alias("l_extendedprice"))
    out = _apply(X.FillMissing(["l_quantity", "l_extendedprice"], "median"), df)
    return rounded(out, {"l_quantity": 6, "l_extendedprice": 6})


@register("P07_fill_mode", f"""SELECT l_orderkey, l_linenumber,
  coalesce(l_linestatus, (SELECT l_linestatus FROM {LI} a WHERE l_linestatus IS NOT NULL
                          GROUP BY 1 ORDER BY count(*) DESC, l_linestatus LIMIT 1)) AS l_linestatus,
  coalesce(CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END,
           (SELECT l_tax FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1
            ORDER BY count(*) DESC, CAST(l_tax AS VARCHAR) LIMIT 1)) AS l_tax
FROM {LI} t""")
def q_fill_mode(spark, d):
    df = lineitem_with_nulls(spark, d).select(
        "l_orderkey", "l_linenumber", "l_linestatus",
        F.when(F.col("l_orderkey") % 3 != 0, F.col("l_tax")).alias("l_tax"))
    return _apply(X.FillMissing(["l_linestatus", "l_tax"], "mode"), df)


@register("P09_drop_missing", f"""SELECT l_orderkey, l_linenumber, l_quantity, l_linestatus FROM {LI} t
  WHERE NOT (l_quantity IS NULL AND l_linestatus IS NULL)""")
def q_drop_missing(spark, d):
    df = lineitem_with_nulls(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus")
    return _apply(X.DropMissing(["l_quantity", "l_linestatus"], "all"), df)


@register("P10_convert_int_coerce", """SELECT o_orderkey,
  CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT) END AS o_totalprice,
  CAST(o_custkey AS BIGINT) AS o_custkey FROM orders""")
def q_convert_int(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return _apply(X.ConvertType(["o_totalprice", "o_custkey"], "Int64", errors="coerce"), df)


@register("P11_convert_float", """SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
  TRY_CAST(l_returnflag AS DOUBLE) AS l_returnflag FROM lineitem""")
def q_convert_float(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return _apply(X.ConvertType(["l_linenumber", "l_returnflag"], "Float64", errors="coerce"), df)


@register("P12_convert_boolean", "SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic FROM labels")
def q_convert_bool(spark, d):
    return _apply(X.ConvertType(["quality", "toxic"], "boolean"), table(spark, d, "labels"))


@register("P13_convert_string", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS l_quantity FROM lineitem")
def q_convert_str(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return _apply(X.ConvertType(["l_quantity"], "string"), df)


@register("P14_convert_datetime", """SELECT o_orderkey,
  strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS d FROM orders""")
def q_convert_dt(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    out = _apply(X.ConvertType(["d"], "datetime", format="%d/%m/%Y", errors="raise"), df)
    return out.withColumn("d", F.col("d").cast("timestamp_ntz"))


@register("P15_normalize_categories", """SELECT doc_id,
  nullif(lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')), '') AS text,
  upper(lang) AS lang FROM documents""")
def q_normalize(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text", "lang")
    a = _apply(X.NormalizeCategories(["text"], strip=True, case="lower", collapse_whitespace=True,
                                     empty_to_missing=True), df)
    return _apply(X.NormalizeCategories(["lang"], case="upper"), a)


PRIORITY_MAP = [{"from": "1-URGENT", "to": "high"}, {"from": "2-HIGH", "to": "high"}, {"from": "5-LOW", "to": "low"}]


@register("P16_map_categories", """SELECT o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low'
       ELSE o_orderpriority END AS o_orderpriority,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS o_orderstatus FROM orders""")
def q_map(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    a = _apply(X.MapCategories(["o_orderpriority"], PRIORITY_MAP, "keep"), df)
    return _apply(X.MapCategories(["o_orderstatus"], [{"from": "F", "to": "finished"}, {"from": "O", "to": "open"}],
                                  "missing"), a)


@register("P17_find_replace", """SELECT doc_id, replace(source, 'src', 'source-') AS source,
  CASE WHEN lang = 'en' THEN 'english' ELSE lang END AS lang FROM documents""")
def q_replace(spark, d):
    df = table(spark, d, "documents").select("doc_id", "source", "lang")
    a = _apply(X.FindReplace(["source"], "src", "source-", "substring"), df)
    return _apply(X.FindReplace(["lang"], "en", "english", "exact"), a)


@register("P18_eligible_rows", """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
  WHERE l.quality IS NOT NULL""")
def q_eligible(spark, d):
    df = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"),
                                                          "doc_id", "left")
    return eligible_rows(df, TaskConfig("quality"))


# ------------------------------------------------------------------ splits

def _alloc_sql(counts_sql: str, ratios=(0.7, 0.15, 0.15)) -> str:
    """Largest-remainder allocation per class in SQL (same float arithmetic as the driver)."""
    vals = ", ".join(f"({i}, CAST({r!r} AS DOUBLE))" for i, r in enumerate(ratios))
    return f"""alloc0 AS (SELECT c.cls, c.n, s.idx, c.n * s.ratio AS q, floor(c.n * s.ratio) AS fl
              FROM ({counts_sql}) c CROSS JOIN (VALUES {vals}) s(idx, ratio) WHERE s.ratio > 0),
alloc1 AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY q - fl DESC, idx) AS rr,
                  n - sum(fl) OVER (PARTITION BY cls) AS rem FROM alloc0),
alloc AS (SELECT cls, sum(CASE WHEN idx = 0 THEN fl + (rr <= rem)::INT END) AS c0,
                 sum(CASE WHEN idx = 1 THEN fl + (rr <= rem)::INT END) AS c1 FROM alloc1 GROUP BY cls)"""


def _rank_split_sql(src: str, key: str, cls_expr: str, seed: int = 42) -> str:
    return f"""WITH e AS (SELECT {key} AS k, {cls_expr} AS cls,
                 sha256('{seed}' || chr(0) || CAST({key} AS VARCHAR)) AS pr FROM {src} s),
{_alloc_sql("SELECT cls, count(*) AS n FROM e GROUP BY cls")},
r AS (SELECT k, cls, row_number() OVER (PARTITION BY cls ORDER BY pr, CAST(k AS VARCHAR)) - 1 AS rk FROM e)
SELECT k AS {key}, CASE WHEN rk < c0 THEN 'train' WHEN rk < c0 + c1 THEN 'validation' ELSE 'test' END AS split
FROM r JOIN alloc USING (cls)"""


@register("L02_random_split", _rank_split_sql("orders", "o_orderkey", "''"))
def q_random(spark, d):
    df = table(spark, d, "orders").select("o_orderkey")
    return split_assign(df, SplitConfig("random"), "o_orderkey").select("o_orderkey", "split")


@register("U05_split_partition", f"""
WITH s AS ({_rank_split_sql("orders", "o_orderkey", "o_orderstatus")}),
tr AS (SELECT o_orderkey FROM s WHERE split = 'train'), va AS (SELECT o_orderkey FROM s WHERE split = 'validation'),
te AS (SELECT o_orderkey FROM s WHERE split = 'test'),
u AS (SELECT * FROM tr UNION SELECT * FROM va UNION SELECT * FROM te),
src AS (SELECT DISTINCT o_orderkey FROM orders)
SELECT 'source_ids' AS name, count(*) AS value FROM src
UNION ALL SELECT 'assigned_ids', count(*) FROM u
UNION ALL SELECT 'overlapping_ids', count(*) FROM ((SELECT * FROM tr INTERSECT SELECT * FROM va)
  UNION (SELECT * FROM tr INTERSECT SELECT * FROM te) UNION (SELECT * FROM va INTERSECT SELECT * FROM te))
UNION ALL SELECT 'missing_ids', count(*) FROM (SELECT * FROM src EXCEPT SELECT * FROM u)
UNION ALL SELECT 'extra_ids', count(*) FROM (SELECT * FROM u EXCEPT SELECT * FROM src)""")
def q_split_partition(spark, d):
    """The three splits are disjoint and their union is the source (set operations)."""
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    s = split_assign(df, SplitConfig("stratified"), "o_orderkey", target="o_orderstatus")
    tr, va, te = (s.where(F.col("split") == name).select("o_orderkey") for name in ("train", "validation", "test"))
    src = df.select("o_orderkey").distinct()
    union = tr.union(va).union(te).distinct()
    overlap = tr.intersect(va).union(tr.intersect(te)).union(va.intersect(te)).distinct()

    def n(name, frame):
        return frame.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value")
    return n("source_ids", src).unionByName(n("assigned_ids", union)).unionByName(n("overlapping_ids", overlap)) \
        .unionByName(n("missing_ids", src.subtract(union))).unionByName(n("extra_ids", union.subtract(src)))


@register("L03_stratified_split", _rank_split_sql("orders", "o_orderkey", "o_orderstatus"))
def q_stratified(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return split_assign(df, SplitConfig("stratified"), "o_orderkey", target="o_orderstatus") \
        .select("o_orderkey", "split")


GROUP_FRAC = ("CAST(('0x' || substr(sha256('42' || chr(0) || '[\"number\", \"' || CAST(o_custkey AS VARCHAR) || '\"]'), "
              "1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0")


@register("L04_group_split", f"""SELECT o_orderkey, o_custkey,
  CASE WHEN {GROUP_FRAC} < 0.7 THEN 'train' WHEN {GROUP_FRAC} < 0.7 + 0.15 THEN 'validation' ELSE 'test' END AS split
FROM orders""")
def q_group(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return split_assign(df, SplitConfig("group", group_column="o_custkey"), "o_orderkey")


@register("L05_chronological_split", """WITH c AS (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT o_orderdate, coalesce(sum(n) OVER (ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             / sum(n) OVER () AS f FROM c)
SELECT o_orderkey, CASE WHEN f < 0.7 THEN 'train' WHEN f < 0.7 + 0.15 THEN 'validation' ELSE 'test' END AS split
FROM orders JOIN r USING (o_orderdate)""")
def q_chrono(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return split_assign(df, SplitConfig("chronological", time_column="o_orderdate"), "o_orderkey") \
        .select("o_orderkey", "split")


DOC_LABELS = "(SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"


@register("L06_missing_target_excluded", f"""WITH base AS {DOC_LABELS},
e AS (SELECT doc_id AS k, '' AS cls, sha256('42' || chr(0) || CAST(doc_id AS VARCHAR)) AS pr FROM base
      WHERE quality IS NOT NULL),
{_alloc_sql("SELECT cls, count(*) AS n FROM e GROUP BY cls")},
r AS (SELECT k, cls, row_number() OVER (ORDER BY pr, CAST(k AS VARCHAR)) - 1 AS rk FROM e)
SELECT b.doc_id, CASE WHEN rk IS NULL THEN 'excluded' WHEN rk < c0 THEN 'train'
                      WHEN rk < c0 + c1 THEN 'validation' ELSE 'test' END AS split
FROM base b LEFT JOIN (r JOIN alloc USING (cls)) ON b.doc_id = r.k""")
def q_missing_target(spark, d):
    df = table(spark, d, "documents").select("doc_id").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return split_assign(df, SplitConfig("random"), "doc_id", target="quality").select("doc_id", "split")


@register("G22_class_counts", f"""SELECT split, o_orderstatus, count(*) AS rows FROM
({_rank_split_sql("orders", "o_orderkey", "o_orderstatus")}) s JOIN orders USING (o_orderkey) GROUP BY ALL""")
def q_class_counts(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return class_counts(split_assign(df, SplitConfig("stratified"), "o_orderkey", target="o_orderstatus"),
                        "o_orderstatus")


@register("U03_cross_split_overlap", f"""SELECT o_custkey, count(DISTINCT split) AS splits FROM
({_rank_split_sql("orders", "o_orderkey", "''")}) s JOIN orders USING (o_orderkey)
GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def q_overlap(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return overlap(split_assign(df, SplitConfig("random"), "o_orderkey"), "o_custkey")


# ------------------------------------------------------------------ flagship: prepare a task

ORDERS_NULLS_SQL = ("(SELECT o_orderkey, o_custkey, o_orderstatus, "
                    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, "
                    "o_orderdate, o_orderpriority FROM orders)")


def orders_with_nulls(spark, d):
    return table(spark, d, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")))


def flagship_recipe() -> Recipe:
    r = Recipe()
    r.add("fill_missing", columns=["o_totalprice"], strategy="median")
    r.add("map_categories", columns=["o_orderpriority"], mapping=PRIORITY_MAP, unknown="keep")
    r.add("drop_columns", columns=["o_orderdate"])
    return r.approve_all()


R06_COLS = [("doc_id", "numeric"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "numeric"),
            ("quality", "numeric"), ("toxic", "numeric")]
R06_SRC = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _suggest_sql() -> str:
    per_col = []
    for i, (c, base) in enumerate(R06_COLS):
        edge = (f"count(*) FILTER (WHERE {c} <> regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))" if base == "text"
                else "0")
        per_col.append(f"SELECT {i} AS ci, '{c}' AS c, '{base}' AS base, count(*) AS n, "
                       f"count(*) FILTER (WHERE {c} IS NULL) AS m, count(DISTINCT {c}) AS u, {edge} AS e FROM t")
    js = "'{\"columns\": [\"' || c || '\"]'"
    return f"""WITH t AS {R06_SRC}, pc AS ({" UNION ALL ".join(per_col)}),
f AS (SELECT *, CASE WHEN u BETWEEN 1 AND 10 THEN 'category' ELSE base END AS role, u = 1 AND m = 0 AS cand,
             m = n AND n > 0 AS allm FROM pc),
g AS (SELECT *, coalesce(sum(cand::INT) OVER (ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                < {len(R06_COLS)} - 1 AND cand AS dropped FROM f WHERE NOT allm),
s AS (SELECT ci, 0 AS si, 'drop_columns' AS operator, {js} || '}}' AS params, 'constant' AS reason FROM g WHERE dropped
      UNION ALL SELECT ci, 1, 'normalize_categories', {js} || ', "strip": true}}', 'edge whitespace'
      FROM g WHERE NOT dropped AND base = 'text' AND e > 0
      UNION ALL SELECT ci, 2, 'fill_missing', {js} || ', "strategy": "' || CASE WHEN role = 'numeric' THEN 'mean'
      ELSE 'mode' END || '"}}', CASE WHEN role = 'numeric' THEN 'numeric missing' ELSE 'category missing' END
      FROM g WHERE NOT dropped AND m > 0 AND role IN ('numeric', 'category'))
SELECT CAST(row_number() OVER (ORDER BY ci, si) - 1 AS INTEGER) AS step, operator, params, reason FROM s"""


@register("R06_suggest_recipe", _suggest_sql())
def q_suggest(spark, d):
    """Steps suggested from the full-data profile of labelled documents (labels joined left)."""
    import json
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left") \
        .select(*[c for c, _ in R06_COLS])
    recipe = suggest_recipe(docs)
    rows = [(i, st.name, json.dumps(st.params, sort_keys=True), st.reason) for i, st in enumerate(recipe.steps)]
    return spark.createDataFrame(rows, "step int, operator string, params string, reason string")


def _change_report_sql() -> str:
    # (column, type before, type after, expression in b, expression in a, change)
    cols = [("o_orderkey", "bigint", "bigint", "o_orderkey", "o_orderkey", "kept"),
            ("o_custkey", "bigint", "bigint", "o_custkey", "o_custkey", "kept"),
            ("o_orderstatus", "string", None, "o_orderstatus", None, "removed"),
            ("o_totalprice", "double", "double", "o_totalprice", "o_totalprice", "kept"),
            ("o_orderdate", "timestamp_ntz", "timestamp_ntz", "o_orderdate", "o_orderdate", "kept"),
            ("o_orderpriority", "string", None, "o_orderpriority", None, "removed"),
            ("status", None, "string", None, "status", "added")]
    parts = []
    for c, tb, ta, eb, ea, ch in cols:
        mb = f"(SELECT count(*) FILTER (WHERE {eb} IS NULL) FROM b)" if eb else "CAST(NULL AS BIGINT)"
        ma = f"(SELECT count(*) FILTER (WHERE {ea} IS NULL) FROM a)" if ea else "CAST(NULL AS BIGINT)"
        tbs = f"'{tb}'" if tb else "CAST(NULL AS VARCHAR)"
        tas = f"'{ta}'" if ta else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT '{c}' AS \"column\", {tbs} AS type_before, {tas} AS type_after, {mb} AS missing_before, "
                     f"{ma} AS missing_after, '{ch}' AS change")
    return f"""WITH b AS {ORDERS_NULLS_SQL},
a AS (SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice, o_orderdate FROM b
      WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)),
r AS ({" UNION ALL ".join(parts)})
SELECT r.*, (SELECT count(*) FROM b) AS rows_before, (SELECT count(*) FROM a) AS rows_after,
       (SELECT count(*) FROM b) - (SELECT count(*) FROM a) AS rows_removed FROM r"""


@register("R07_change_report", _change_report_sql())
def q_change_report(spark, d):
    """What a recipe did -- rows removed, columns added / removed, missing cells and types."""
    from tessera.plans.recipe import change_report
    before = orders_with_nulls(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                "o_orderdate", "o_orderpriority")
    r = Recipe()
    r.add("drop_missing", columns=["o_totalprice"])
    r.add("rename_columns", columns=["o_orderstatus"], names=["status"])
    r.add("drop_columns", columns=["o_orderpriority"])
    after = fit_recipe(r.approve_all(), before).apply(before)
    return change_report(before, after)


@register("R09_prepare_task", f"""WITH s AS ({_rank_split_sql(ORDERS_NULLS_SQL, "o_orderkey", "o_orderstatus")}),
j AS (SELECT o.*, s.split FROM {ORDERS_NULLS_SQL} o JOIN s USING (o_orderkey)),
m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM j WHERE split = 'train')
SELECT o_orderkey, split, o_orderstatus, o_custkey, round(coalesce(o_totalprice, med), 6) AS o_totalprice,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low'
       ELSE o_orderpriority END AS o_orderpriority
FROM j, m""")
def q_prepare(spark, d):
    prepared = prepare_task(orders_with_nulls(spark, d), TaskConfig("o_orderstatus"),
                            SplitConfig("stratified"), flagship_recipe(), key="o_orderkey")
    return rounded(prepared.frame, {"o_totalprice": 6})


@register("R01_fit_in_order", f"""WITH t AS (SELECT l_orderkey, l_linenumber, lower(l_linestatus) AS s FROM {LI} x),
m AS (SELECT s FROM t WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
SELECT l_orderkey, l_linenumber, coalesce(t.s, m.s) AS l_linestatus FROM t, m""")
def q_fit_in_order(spark, d):
    """The mode is learned on values already lower-cased by the step before it."""
    df = lineitem_with_nulls(spark, d).select("l_orderkey", "l_linenumber", "l_linestatus")
    r = Recipe()
    r.add("normalize_categories", columns=["l_linestatus"], case="lower")
    r.add("fill_missing", columns=["l_linestatus"], strategy="mode")
    return fit_recipe(r.approve_all(), df).apply(df)


@register("R02_apply_fitted_recipe", f"""WITH m AS (SELECT avg(l_quantity) AS mq FROM {LI} a WHERE l_linenumber <= 3)
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, mq), 6) AS l_quantity, lower(l_returnflag) AS l_returnflag
FROM {LI} t, m""")
def q_apply_fitted(spark, d):
    df = lineitem_with_nulls(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    r = Recipe()
    r.add("fill_missing", columns=["l_quantity"], strategy="mean")
    r.add("normalize_categories", columns=["l_returnflag"], case="lower")
    fitted = fit_recipe(r.approve_all(), df.where(F.col("l_linenumber") <= 3))
    # round trip through the JSON form (R03) before applying to the whole table
    restored = FittedRecipe.from_dict(fitted.to_dict())
    return rounded(restored.apply(df), {"l_quantity": 6})


@register("Q04_changed_rows", f"""SELECT o_orderkey, o_custkey, o_totalprice, false AS removed FROM {ORDERS_NULLS_SQL} o
WHERE o_totalprice IS NULL ORDER BY o_orderkey LIMIT 5""")
def q_changed(spark, d):
    """J05 + Q04: first five rows a fitted recipe changes (null-safe comparison by key)."""
    from tessera.operators.sampling import changed_rows
    before = orders_with_nulls(spark, d).select("o_orderkey", "o_custkey", "o_totalprice")
    r = Recipe()
    r.add("fill_missing", columns=["o_totalprice"], strategy="median")
    fitted = fit_recipe(r.approve_all(), before.select("o_custkey", "o_totalprice"))
    from tessera.plans.prepare import _apply_carrying
    after = _apply_carrying(fitted, before, ["o_orderkey"])
    return changed_rows(before, after, "o_orderkey", 5)


@register("Q03_preview", f"""SELECT o_orderkey, o_orderstatus, lower(o_orderpriority) AS o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 200""")
def q_preview(spark, d):
    from tessera.operators.sampling import preview
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    step = X.NormalizeCategories(["o_orderpriority"], case="lower")
    head, truncated = preview(step.apply(df), ["o_orderkey"], 200)
    assert truncated
    return head


def _seed_trial_sql(seed):
    split = _rank_split_sql("orders", "o_orderkey", "o_orderstatus", seed)
    return f"""SELECT {seed} AS seed, (SELECT avg((o_orderstatus = m.major)::INT) FROM s{seed}
  WHERE split = 'validation') AS validation_accuracy FROM (SELECT o_orderstatus AS major FROM s{seed} WHERE split = 'train'
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) m""", f"s{seed} AS (SELECT o.o_orderkey, o.o_orderstatus, x.split FROM orders o JOIN ({split}) x USING (o_orderkey))"


@register("L10_seed_trials", "WITH " + ", ".join(_seed_trial_sql(i)[1] for i in range(3)) + " SELECT seed, round(validation_accuracy, 10) AS "
          "validation_accuracy FROM (" + " UNION ALL ".join(_seed_trial_sql(i)[0] for i in range(3)) + ")")
def q_seed_trials(spark, d):
    """Repeat split + dummy baseline over seeds; one row per trial with validation
    accuracy (the class prior of each split differs by seed)."""
    from tessera.operators import models as M
    from tessera.operators import evaluation as V
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    rows = []
    for seed in range(3):
        s = split_assign(o, SplitConfig("stratified", seed=seed), "o_orderkey", target="o_orderstatus")
        from tessera.operators.encoding import encode_target, target_classes
        classes = target_classes(s, "o_orderstatus")
        enc = encode_target(s, "o_orderstatus", classes)
        m = M.fit_model(M.ModelConfig("sklearn", "dummy"), enc.where("split = 'train'"), "classification",
                        n_classes=len(classes))
        acc = V.classification_metrics(m.predict(enc.where("split = 'validation'")), len(classes)).first()["accuracy"]
        rows.append((seed, round(float(acc), 10)))
    return spark.createDataFrame(rows, "seed int, validation_accuracy double")
