"""Registered distribution, sampling and window queries (D*, G23-G32, Q*, W*, P20, P21)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import distributions as D
from tessera.operators import sampling as S
from tessera.plans.profile_queries import _hist_sql
from tessera.plans.registry import LINEITEM_NULLS_SQL, lineitem_with_nulls, register, rounded, table

LI = LINEITEM_NULLS_SQL


@register("D01_histogram_by_group", """
WITH b AS (SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM b),
c AS (SELECT g, CAST(least(floor((x - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM b, r GROUP BY ALL),
spine AS (SELECT DISTINCT g, CAST(i AS INTEGER) AS bin, lo, hi FROM b, r, range(0, 20) t(i)),
h AS (SELECT s.g, s.bin, lo + s.bin * (hi - lo) / 20 AS lower,
             CASE WHEN s.bin = 19 THEN hi ELSE lo + (s.bin + 1) * (hi - lo) / 20 END AS upper, coalesce(n, 0) AS n
      FROM spine s LEFT JOIN c ON s.g = c.g AND s.bin = c.bin)
SELECT g AS l_returnflag, 'l_extendedprice' AS "column", bin, round(lower, 6) AS lower, round(upper, 6) AS upper,
       CAST(n AS BIGINT) AS count, round(n / (sum(n) OVER (PARTITION BY g) * (upper - lower)), 12) AS density FROM h""")
def q_hist_group(spark, d):
    out = D.grouped_histogram(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", bins=20, density=True)
    return rounded(out, {"lower": 6, "upper": 6, "density": 12})


@register("D02_density", f"""
WITH b AS (SELECT event_type AS g, value AS x FROM events WHERE isfinite(value)),
s AS (SELECT g, count(*) AS n, 1.06 * stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi
      FROM b GROUP BY g HAVING count(*) >= 2 AND max(x) > min(x)),
grid AS (SELECT g, n, h, i, (lo - 3 * h) + i * ((hi + 3 * h) - (lo - 3 * h)) / 255 AS gx FROM s, range(0, 256) t(i)),
v AS (SELECT g, x, count(*) AS cnt FROM b GROUP BY ALL)
SELECT grid.g AS event_type, CAST(i AS INTEGER) AS point, round(gx, 6) AS x,
       round(sum(cnt * exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (n * h * {math.sqrt(2 * math.pi)!r}), 10) AS density
FROM grid JOIN v USING (g) GROUP BY grid.g, i, gx, n, h""")
def q_kde(spark, d):
    out = D.kde(table(spark, d, "events"), "value", "event_type")
    return rounded(out.withColumn("point", F.col("point").cast("int")), {"x": 6, "density": 10})


@register("D05_violin_scaled_density", f"""
WITH b AS (SELECT l_linestatus AS g, l_discount AS x FROM lineitem),
s AS (SELECT g, count(*) AS n, 1.06 * stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi
      FROM b GROUP BY g HAVING count(*) >= 2 AND max(x) > min(x)),
grid AS (SELECT g, n, h, i, (lo - 3 * h) + i * ((hi + 3 * h) - (lo - 3 * h)) / 255 AS gx FROM s, range(0, 256) t(i)),
v AS (SELECT g, x, count(*) AS cnt FROM b GROUP BY ALL),
k AS (SELECT grid.g, i, gx, sum(cnt * exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (n * h * {math.sqrt(2 * math.pi)!r}) AS dens
      FROM grid JOIN v USING (g) GROUP BY grid.g, i, gx, n, h)
SELECT g AS l_linestatus, CAST(i AS INTEGER) AS point, round(gx, 8) AS x, round(dens, 8) AS density,
       round(dens / max(dens) OVER (PARTITION BY g), 8) AS scaled FROM k""")
def q_violin(spark, d):
    out = D.kde(table(spark, d, "lineitem"), "l_discount", "l_linestatus", scale_to_max=True)
    return rounded(out.withColumn("point", F.col("point").cast("int")), {"x": 8, "density": 8, "scaled": 8})


@register("D03_ecdf", """
WITH v AS (SELECT l_linestatus, l_quantity, count(*) AS count FROM lineitem GROUP BY ALL)
SELECT l_linestatus, l_quantity, count,
  round(sum(count) OVER (PARTITION BY l_linestatus ORDER BY l_quantity) / sum(count) OVER (PARTITION BY l_linestatus), 10)
  AS fraction FROM v""")
def q_ecdf(spark, d):
    return rounded(D.ecdf(table(spark, d, "lineitem"), "l_quantity", "l_linestatus"), {"fraction": 10})


@register("D04_box", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE NOT l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers,
  count(*) AS n
FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag, q1, median, q3""")
def q_box(spark, d):
    return rounded(D.box_stats(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"),
                   {"q1": 6, "median": 6, "q3": 6})


@register("D07_normal_qq", f"""
WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events
           WHERE isfinite(value))
SELECT i, value, round({D.inv_norm_sql('(i + 0.5) / n')}, 8) AS theoretical FROM r""")
def q_qq(spark, d):
    return rounded(D.qq_points(table(spark, d, "events"), "value"), {"theoretical": 8})


@register("D07_normal_qq_line", f"""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events WHERE isfinite(value))
SELECT round((q3 - q1) / (2 * {D.inv_norm_sql('0.75::DOUBLE')}), 8) AS slope, round((q1 + q3) / 2, 8) AS intercept FROM q""")
def q_qq_line(spark, d):
    return rounded(D.qq_line(table(spark, d, "events"), "value"), {"slope": 8, "intercept": 8})


@register("D08_outlier_rows", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT o_orderkey, o_totalprice, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper,
       o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1) AS is_outlier FROM orders, q""")
def q_outliers(spark, d):
    out = D.outlier_rows(table(spark, d, "orders"), "o_totalprice", keep=["o_orderkey"])
    return rounded(out, {"lower": 6, "upper": 6})


LI_KEY_SQL = "sha256('42' || chr(0) || CAST(l_orderkey AS VARCHAR) || chr(1) || CAST(l_linenumber AS VARCHAR))"


@register("D09_bubble_sample", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem
           ORDER BY {LI_KEY_SQL}, CAST(l_orderkey AS VARCHAR) || chr(1) || CAST(l_linenumber AS VARCHAR),
                    l_quantity, l_extendedprice, l_discount LIMIT 2000),
m AS (SELECT max(l_discount) AS mx FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       round(CASE WHEN mx > 0 THEN l_discount / mx * 250 ELSE 0.0 END, 8) AS area FROM s, m""")
def q_bubble(spark, d):
    out = D.scatter_points(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", 42, 2000,
                           ["l_orderkey", "l_linenumber"])
    return rounded(out, {"area": 8})


@register("D10_grid_counts", """
WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1
           FROM lineitem),
c AS (SELECT CAST(least(floor((l_quantity - x0) / (x1 - x0) * 10), 9) AS INTEGER) AS bx,
             CAST(least(floor((l_extendedprice - y0) / (y1 - y0) * 10), 9) AS INTEGER) AS by, count(*) AS n
      FROM lineitem, r GROUP BY ALL)
SELECT CAST(a.i AS INTEGER) AS bx, CAST(b.i AS INTEGER) AS by, coalesce(n, 0) AS count
FROM range(0, 10) a(i) CROSS JOIN range(0, 10) b(i) LEFT JOIN c ON c.bx = a.i AND c.by = b.i""")
def q_grid(spark, d):
    return D.grid_counts(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", bins=10)


@register("D11_hexbin", f"""
WITH r AS (SELECT min(l_extendedprice) AS xa, max(l_extendedprice) AS xb, min(l_discount) AS ya, max(l_discount) AS yb FROM lineitem),
w AS (SELECT xa - (xb - xa) * 1e-9 AS x0, (xb - xa) * (1 + 2e-9) / 20 AS sx,
             ya - (yb - ya) * 1e-9 AS y0, (yb - ya) * (1 + 2e-9) / {int(20 / math.sqrt(3))} AS sy FROM r),
p AS (SELECT x0, sx, y0, sy, (l_extendedprice - x0) / sx AS u, (l_discount - y0) / sy AS v FROM lineitem, w),
e AS (SELECT *, round_even(u, 0) AS ue, round_even(v, 0) AS ve, floor(u) + 0.5 AS uo, floor(v) + 0.5 AS vo FROM p),
c AS (SELECT *, pow(u - ue, 2) + 3 * pow(v - ve, 2) < pow(u - uo, 2) + 3 * pow(v - vo, 2) AS near FROM e)
SELECT round(if(near, ue, uo) * sx + x0, 4) AS center_x,
       CASE WHEN abs(if(near, ve, vo) * sy + y0) < 5e-7 THEN 0 ELSE round(if(near, ve, vo) * sy + y0, 6) END AS center_y,
       count(*) AS count FROM c GROUP BY ALL""")
def q_hexbin(spark, d):
    out = D.hexbin(table(spark, d, "lineitem"), "l_extendedprice", "l_discount", gridsize=20)
    out = rounded(out, {"center_x": 4, "center_y": 6})
    return out.withColumn("center_y", F.when(F.col("center_y") == 0, 0.0).otherwise(F.col("center_y")))  # no -0.0


@register("D12_text_length", """
WITH b AS (SELECT CAST(length(text) AS DOUBLE) AS x FROM documents WHERE text IS NOT NULL),
r AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM b),
c AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM b, r GROUP BY 1)
SELECT 'length' AS "column", CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 30, 6) AS lower,
       round(CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * (hi - lo) / 30 END, 6) AS upper, coalesce(n, 0) AS count
FROM r, range(0, 30) t(i) LEFT JOIN c ON c.bin = t.i""")
def q_text_len(spark, d):
    return rounded(D.text_length_histogram(table(spark, d, "documents"), "text"), {"lower": 6, "upper": 6})


@register("D13_word_frequency", """
WITH w AS (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM conversations),
c AS (SELECT word, count(*) AS count FROM w WHERE word <> '' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, word) AS rank FROM c)
SELECT rank, word, count, round(count / (SELECT sum(count) FROM c), 8) AS share FROM r WHERE rank <= 100""")
def q_words(spark, d):
    from tessera.operators.profile import top_words
    return rounded(top_words(table(spark, d, "conversations"), "text", k=100), {"share": 8})


@register("D14_parallel_coordinates", """
WITH s AS (SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders
           ORDER BY sha256('42' || chr(0) || CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR) LIMIT 500),
m AS (SELECT min(o_totalprice) AS a0, max(o_totalprice) AS b0, min(o_custkey) AS a1, max(o_custkey) AS b1 FROM orders)
SELECT o_orderkey, round(coalesce((o_totalprice - a0) / nullif(b0 - a0, 0), 0.0), 10) AS o_totalprice,
       round(coalesce((o_custkey - a1) / nullif(b1 - a1, 0), 0.0), 10) AS o_custkey FROM s, m""")
def q_parallel(spark, d):
    out = D.parallel_coordinates(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], n=500, key=["o_orderkey"])
    return rounded(out, {"o_totalprice": 10, "o_custkey": 10})


@register("G23_missing_ranking", f"""
WITH m AS (SELECT 'l_quantity' AS "column", count(*) FILTER (WHERE l_quantity IS NULL) AS missing, count(*) AS n FROM {LI} a
  UNION ALL SELECT 'l_linestatus', count(*) FILTER (WHERE l_linestatus IS NULL), count(*) FROM {LI} b
  UNION ALL SELECT 'l_orderkey', 0, count(*) FROM lineitem UNION ALL SELECT 'l_partkey', 0, count(*) FROM lineitem
  UNION ALL SELECT 'l_suppkey', 0, count(*) FROM lineitem UNION ALL SELECT 'l_linenumber', 0, count(*) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 0, count(*) FROM lineitem UNION ALL SELECT 'l_discount', 0, count(*) FROM lineitem
  UNION ALL SELECT 'l_tax', 0, count(*) FROM lineitem UNION ALL SELECT 'l_returnflag', 0, count(*) FROM lineitem
  UNION ALL SELECT 'l_shipdate', 0, count(*) FROM lineitem)
SELECT "column", missing, round(missing / n, 10) AS share FROM m""")
def q_missing_rank(spark, d):
    return rounded(D.missing_ranking(lineitem_with_nulls(spark, d)), {"share": 10})


@register("G24_missing_patterns", f"""
SELECT (l_quantity IS NULL)::INT::VARCHAR || (l_linestatus IS NULL)::INT::VARCHAR || (l_tax IS NULL)::INT::VARCHAR AS pattern,
       count(*) AS count FROM {LI} t GROUP BY 1""")
def q_patterns(spark, d):
    return D.missing_patterns(lineitem_with_nulls(spark, d), ["l_quantity", "l_linestatus", "l_tax"])


def _contingency_sql(normalize: str | None) -> str:
    share = ""
    if normalize == "row":
        share = ", round(count / sum(count) OVER (PARTITION BY p_type), 10) AS share"
    elif normalize == "group":
        share = ", round(count / sum(count) OVER (PARTITION BY p_brand), 10) AS share"
    return f"""
WITH c AS (SELECT p_type, p_brand, count(*) AS count FROM part GROUP BY ALL)
SELECT *{share} FROM c"""


@register("G26_contingency", _contingency_sql(None))
def q_cont(spark, d):
    return D.contingency(table(spark, d, "part"), "p_type", "p_brand")


@register("G27_grouped_bar_share", _contingency_sql("group"))
def q_grouped(spark, d):
    return rounded(D.contingency(table(spark, d, "part"), "p_type", "p_brand", normalize="group"), {"share": 10})


@register("G28_stacked_bar_share", _contingency_sql("row"))
def q_stacked(spark, d):
    return rounded(D.contingency(table(spark, d, "part"), "p_type", "p_brand", normalize="row"), {"share": 10})


@register("G26_contingency_rest", """
WITH tx AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 8),
l AS (SELECT CASE WHEN p_type IN (SELECT * FROM tx) THEN p_type ELSE '[remaining categories]' END AS p_type, p_brand FROM part),
ty AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 8)
SELECT p_type, CASE WHEN p_brand IN (SELECT * FROM ty) THEN p_brand ELSE '[remaining categories]' END AS p_brand,
       count(*) AS count FROM l GROUP BY ALL""")
def q_cont_rest(spark, d):
    return D.contingency(table(spark, d, "part"), "p_type", "p_brand", k=8)


@register("G29_category_counts", """
SELECT row_number() OVER (ORDER BY count(*) DESC, p_name) AS rank, p_name, count(*) AS count FROM part GROUP BY p_name""")
def q_cat_all(spark, d):
    return D.category_counts(table(spark, d, "part"), "p_name")


@register("G29_category_counts_remaining", """
WITH c AS (SELECT p_brand, count(*) AS count FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, p_brand) AS rank FROM c)
SELECT min(rank) AS rank, CASE WHEN rank <= 5 THEN p_brand ELSE '[remaining categories]' END AS p_brand,
       CAST(sum(count) AS BIGINT) AS count FROM r GROUP BY 2""")
def q_cat_counts(spark, d):
    out = D.category_counts(table(spark, d, "part"), "p_brand", top=5, remaining=True)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@register("G30_line_median", """
SELECT l_linenumber, round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice FROM lineitem GROUP BY 1""")
def q_line(spark, d):
    return rounded(D.line_values(table(spark, d, "lineitem"), "l_linenumber", "l_extendedprice", "median"),
                   {"l_extendedprice": 6})


PERIOD_SQL = """
WITH b AS (SELECT date_trunc('hour', ts) AS period, value FROM events),
spine AS (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 HOUR)) AS period FROM b),
v AS (SELECT period, {agg} AS value FROM b GROUP BY 1)
SELECT CAST(spine.period AS TIMESTAMP) AS period, {out} AS value FROM spine LEFT JOIN v USING (period)"""


@register("G31_period_mean", PERIOD_SQL.format(agg="avg(value)", out="round(value, 8)"))
def q_period_mean(spark, d):
    ev = table(spark, d, "events")
    return rounded(D.period_aggregate(ev, "ts", "value", "H", "mean"), {"value": 8})


@register("G32_period_counts", PERIOD_SQL.format(agg="count(*)", out="coalesce(value, 0)"))
def q_period_counts(spark, d):
    ev = table(spark, d, "events")
    return D.period_aggregate(ev, "ts", None, "H", "count")


@register("Q01_priority_sample", """
SELECT * FROM customer ORDER BY sha256('42' || chr(0) || CAST(c_custkey AS VARCHAR)), CAST(c_custkey AS VARCHAR)
LIMIT 100""")
def q_sample(spark, d):
    return S.priority_sample(table(spark, d, "customer"), 100, 42, ["c_custkey"])


@register("Q02_per_group_sample", """
SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment
  ORDER BY sha256('7' || chr(0) || CAST(c_custkey AS VARCHAR)), CAST(c_custkey AS VARCHAR)) AS rn FROM customer)
WHERE rn <= 5""")
def q_group_sample(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return S.per_group_sample(c, "c_mktsegment", 5, seed=7, key=["c_custkey"])


@register("W01_row_id", """
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER () - 1 AS row_id FROM lineitem""")
def q_row_id(spark, d):
    """Zero-based ordinal in file order, from Parquet ``_metadata`` (no sort of the rows)."""
    li = table(spark, d, "lineitem")
    return S.with_row_id(li).select("l_orderkey", "l_linenumber", "l_partkey", "row_id")


@register("W03_row_views", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_number, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, row_number, CASE WHEN row_number <= 10 THEN 'first' WHEN row_number > n - 10 THEN 'last'
       ELSE 'middle' END AS view FROM r
WHERE row_number <= 10 OR row_number > n - 10 OR (row_number > (n - 10) // 2 AND row_number <= (n - 10) // 2 + 10)""")
def q_row_views(spark, d):
    o = S.row_number_by(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    n = o.count()
    v = S.row_views(o.withColumn("_rid", F.col("row_number") - 1), "_rid", n, 10)
    return v.select("o_orderkey", F.col("row_number").cast("bigint").alias("row_number"), "view")


@register("P20_row_range_filter", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders)
SELECT o_orderkey, row_number FROM r WHERE (row_number BETWEEN 2 AND 5 OR row_number BETWEEN 100 AND 200)
  AND NOT (row_number = 3 OR row_number BETWEEN 150 AND 160)""")
def q_ranges(spark, d):
    o = S.row_number_by(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return S.filter_ranges(o, F.col("row_number"), "2-5, 100-200", "3, 150-160") \
        .withColumn("row_number", F.col("row_number").cast("bigint"))


@register("P21_row_lookup", """
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders) WHERE row_number = 777""")
def q_row_at(spark, d):
    o = S.row_number_by(table(spark, d, "orders"), ["o_orderkey"])
    return o.where(F.col("row_number") == 777).withColumn("row_number", F.col("row_number").cast("bigint"))


DAILY_SQL = "(SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1)"


@register("W06_regular_steps", f"""
WITH d AS (SELECT day, day - lag(day) OVER (ORDER BY day) AS step FROM {DAILY_SQL} t)
SELECT count(step) AS steps, count(DISTINCT step) AS distinct_steps,
       CAST(epoch(min(step)) AS BIGINT) AS min_step_seconds FROM d""")
def q_regular(spark, d):
    from tessera.operators.series import regularity
    ev = table(spark, d, "events")
    daily = ev.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).count()
    return regularity(daily, "day")


@register("W07_lag_features", f"""
SELECT day, n, lag(n, 1) OVER (ORDER BY day) AS n_lag_1, lag(n, 2) OVER (ORDER BY day) AS n_lag_2,
       lag(n, 3) OVER (ORDER BY day) AS n_lag_3 FROM {DAILY_SQL} t""")
def q_lags(spark, d):
    ev = table(spark, d, "events")
    daily = ev.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    from tessera.operators.series import lag_features
    return lag_features(daily, "day", "n", 3).drop("pos")


LI_PRIORITY = ("sha256('42' || chr(0) || CAST(l_orderkey AS VARCHAR) || chr(1) || CAST(l_linenumber AS VARCHAR)), "
               "CAST(l_orderkey AS VARCHAR) || chr(1) || CAST(l_linenumber AS VARCHAR)")


@register("G25_missing_matrix", f"""SELECT l_orderkey, l_linenumber, (l_quantity IS NULL)::INT AS l_quantity,
  (l_linestatus IS NULL)::INT AS l_linestatus FROM {LI} t ORDER BY {LI_PRIORITY} LIMIT 1000""")
def q_missing_matrix(spark, d):
    return D.missing_matrix(lineitem_with_nulls(spark, d), ["l_quantity", "l_linestatus"], 1000, 42,
                            ["l_orderkey", "l_linenumber"])


@register("D06_strip_points", f"""SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {LI_PRIORITY}, l_extendedprice) AS rn
  FROM lineitem) WHERE rn <= 400""")
def q_strip(spark, d):
    return D.strip_points(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", 400, 42,
                          ["l_orderkey", "l_linenumber"])


@register("D15_pair_matrix_diagonal", _hist_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], bins=20))
def q_pair_matrix(spark, d):
    diagonal, _ = D.pair_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"],
                                key=["l_orderkey", "l_linenumber"])
    return rounded(diagonal, {"lower": 6, "upper": 6})


@register("D15_pair_matrix_points", f"""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem
  ORDER BY {LI_PRIORITY}, l_quantity, l_extendedprice, l_discount LIMIT 2000""")
def q_pair_points(spark, d):
    """The sample that all panels off the diagonal share: 2,000 rows, the operator's own size."""
    _, shared = D.pair_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"],
                              key=["l_orderkey", "l_linenumber"])
    return shared


@register("D01_histogram_all_groups", """
WITH b AS (SELECT p_brand AS g, p_retailprice AS x FROM part),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM b),
c AS (SELECT g, CAST(least(floor((x - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM b, r GROUP BY ALL)
SELECT s.g AS p_brand, 'p_retailprice' AS "column", CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 20, 6) AS lower,
       round(CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * (hi - lo) / 20 END, 6) AS upper, coalesce(n, 0) AS count
FROM (SELECT DISTINCT g FROM b) s CROSS JOIN r CROSS JOIN range(0, 20) t(i) LEFT JOIN c ON c.g = s.g AND c.bin = i""")
def q_hist_all(spark, d):
    """Every one of the 25 brands."""
    out = D.grouped_histogram(table(spark, d, "part"), "p_retailprice", "p_brand", bins=20)
    return rounded(out, {"lower": 6, "upper": 6})


@register("D04_box_groups_rest", """
WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 8),
b AS (SELECT CASE WHEN p_brand IN (SELECT * FROM t) THEN p_brand ELSE '[remaining categories]' END AS p_brand, p_retailprice AS x FROM part),
q AS (SELECT p_brand, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM b GROUP BY 1)
SELECT p_brand, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n
FROM b JOIN q USING (p_brand) GROUP BY p_brand, q1, median, q3""")
def q_box_rest(spark, d):
    """Eight brands by name, the other seventeen as one labelled group."""
    return rounded(D.box_stats(table(spark, d, "part"), "p_retailprice", "p_brand", max_groups=8),
                   {"q1": 6, "median": 6, "q3": 6})


@register("D16_summary_plan")
def q_summary_plan(spark, d):
    from tessera.operators.associations import association_table, strongest
    from tessera.operators.profile import column_overview
    df = lineitem_with_nulls(spark, d)
    ov = [r.asDict() for r in column_overview(df).collect()]  # one row per column
    roles = {r["column"]: r["role"] for r in ov}
    top = [(r["x"], r["y"]) for r in strongest(association_table(df, roles), 3).collect()]
    plan = D.summary_plan(ov, top)
    import json
    return spark.createDataFrame([(i, p["operator"], json.dumps(p["args"], sort_keys=True)) for i, p in enumerate(plan)],
                                 "step int, operator string, args string")
