"""Registered profile / association queries (G*, A*) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.plans.registry import LINEITEM_NULLS_SQL, lineitem_with_nulls, register, rounded, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _moments_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"(CASE WHEN isfinite({c}) THEN {c} END)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS n, round(avg({x}), 6) AS mean, "
            f"round(var_samp({x}), 2) AS variance, round(stddev_samp({x}), 6) AS std, "
            f"min({x}) AS min, max({x}) AS max, round(sum({x}), 2) AS sum, "
            f"round(skewness({x}), 6) AS skew, round(kurtosis({x}), 6) AS kurtosis, "
            f"max({x}) - min({x}) AS range, round(stddev_samp({x}) / nullif(avg({x}), 0), 8) AS cv, "
            f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS num_missing, "
            f"round(count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) / count(*), 8) AS pct_missing, "
            f"count(*) FILTER (WHERE isinf({c})) AS num_infinity, "
            f"round(count(*) FILTER (WHERE isinf({c})) / count(*), 8) AS pct_infinity, "
            f"count(*) FILTER (WHERE {x} = 0) AS num_zeros, "
            f"round(count(*) FILTER (WHERE {x} = 0) / count(*), 8) AS pct_zeros, "
            f"count(*) FILTER (WHERE {x} < 0) AS num_neg, "
            f"round(count(*) FILTER (WHERE {x} < 0) / count(*), 8) AS pct_neg FROM {src} t")
    return " UNION ALL ".join(parts)


MOMENT_DIGITS = {"mean": 6, "variance": 2, "std": 6, "sum": 2, "skew": 6, "kurtosis": 6, "cv": 8,
                 "pct_missing": 8, "pct_infinity": 8, "pct_zeros": 8, "pct_neg": 8}


@register("G04_numeric_moments", _moments_sql(LINEITEM_NULLS_SQL, NUM))
def q_moments(spark, d):
    return rounded(P.numeric_moments(lineitem_with_nulls(spark, d), NUM), MOMENT_DIGITS)


@register("G01_table_summary", f"""
SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns,
  CAST(sum((l_quantity IS NULL)::INT + (l_linestatus IS NULL)::INT) AS BIGINT) AS missing_cells,
  round(sum((l_quantity IS NULL)::INT + (l_linestatus IS NULL)::INT) / (count(*) * 11.0), 10) AS missing_share,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {LINEITEM_NULLS_SQL} u)) AS BIGINT) AS duplicate_rows
FROM {LINEITEM_NULLS_SQL} t""")
def q_summary(spark, d):
    return rounded(P.table_summary(lineitem_with_nulls(spark, d)), {"missing_share": 10})


@register("G18_duplicate_rows", """
SELECT CAST(count(*) - count(DISTINCT (l_returnflag, l_linestatus, l_quantity)) AS BIGINT) AS duplicate_rows
FROM lineitem""")
def q_duplicates(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return P.table_summary(li).select("duplicate_rows")


def _quantile_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS x FROM {src} s0 WHERE isfinite({c})""")
    long = " UNION ALL ".join(parts)
    return f"""
WITH long AS ({long}),
q AS (SELECT "column", quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.95) AS p95 FROM long GROUP BY 1),
m AS (SELECT l."column", quantile_cont(abs(x - median), 0.5) AS mad,
             count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS outliers,
             count(*) AS n
      FROM long l JOIN q USING ("column") GROUP BY 1)
SELECT "column", round(p5, 6) AS p5, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(p95, 6) AS p95, round(q3 - q1, 6) AS iqr, round(mad, 6) AS mad, outliers,
       round(outliers / n, 8) AS outlier_share
FROM q JOIN m USING ("column")"""


Q_DIGITS = {c: 6 for c in ["p5", "q1", "median", "q3", "p95", "iqr", "mad"]} | {"outlier_share": 8}


@register("G08_quantiles_mad_outliers", _quantile_sql(LINEITEM_NULLS_SQL, NUM))
def q_quantiles(spark, d):
    return rounded(P.numeric_quantiles(lineitem_with_nulls(spark, d), NUM), Q_DIGITS)


def _hist_sql(src: str, cols: list[str], bins: int = 30) -> str:
    long = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS x FROM {src} s WHERE isfinite({c})""" for c in cols)
    return f"""
WITH long AS ({long}),
r0 AS (SELECT "column", min(x) AS lo0, max(x) AS hi0 FROM long GROUP BY 1),
r AS (SELECT "column", CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0),
c AS (SELECT "column", CAST(least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
      FROM long JOIN r USING ("column") GROUP BY ALL),
spine AS (SELECT "column", lo, hi, CAST(b AS INTEGER) AS bin FROM r, range(0, {bins}) t(b))
SELECT s."column", s.bin, round(lo + s.bin * (hi - lo) / {bins}, 6) AS lower,
       round(CASE WHEN s.bin = {bins - 1} THEN hi ELSE lo + (s.bin + 1) * (hi - lo) / {bins} END, 6) AS upper,
       CAST(coalesce(n, 0) AS BIGINT) AS count
FROM spine s LEFT JOIN c ON s."column" = c."column" AND s.bin = c.bin"""


@register("G11_histogram", _hist_sql(LINEITEM_NULLS_SQL, NUM))
def q_hist(spark, d):
    return rounded(P.histogram(lineitem_with_nulls(spark, d), NUM), {"lower": 6, "upper": 6})


ALL_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ROLE_SQL = {"l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
            "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
            "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "datetime"}


def _overview_sql() -> str:
    parts = []
    for c in ALL_LI:
        base = ROLE_SQL[c]
        role = (f"CASE WHEN count(DISTINCT {c}) BETWEEN 1 AND 10 THEN 'category' ELSE '{base}' END"
                if base in ("numeric", "text") else f"'{base}'")
        parts.append(
            f"SELECT '{c}' AS \"column\", {role} AS role, count(*) FILTER (WHERE {c} IS NULL) AS num_missing, "
            f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 8) AS pct_missing, "
            f"count(DISTINCT {c}) AS num_unique, round(count(DISTINCT {c}) / count(*), 8) AS pct_unique, "
            f"count(DISTINCT {c}) = 1 AS is_constant, count(*) FILTER (WHERE {c} IS NULL) = count(*) AS all_missing, "
            f"count(DISTINCT {c}) = count(*) AS possible_id, "
            f"CASE WHEN count(DISTINCT {c}) < 20 THEN 'low' WHEN count(DISTINCT {c}) < 1000 THEN 'medium' "
            f"ELSE 'high' END AS cardinality FROM {LINEITEM_NULLS_SQL} t")
    return " UNION ALL ".join(parts)


@register("G12_column_overview_roles", _overview_sql())
def q_overview(spark, d):
    ov = P.column_overview(lineitem_with_nulls(spark, d))
    return rounded(ov.drop("dtype", "memory_bytes"), {"pct_missing": 8, "pct_unique": 8})


@register("G15_top_values", f"""
WITH f AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS count FROM {LINEITEM_NULLS_SQL} a
           WHERE l_returnflag IS NOT NULL GROUP BY 2
           UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM {LINEITEM_NULLS_SQL} b
           WHERE l_linestatus IS NOT NULL GROUP BY 2
           UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), count(*) FROM {LINEITEM_NULLS_SQL} c GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM f)
SELECT "column", rank, value, count, round(count / (SELECT count(*) FROM lineitem), 8) AS share
FROM r WHERE rank <= 5""")
def q_top_values(spark, d):
    df = lineitem_with_nulls(spark, d)
    out = P.top_values(df, ["l_returnflag", "l_linestatus", "l_suppkey"], k=5)
    return rounded(out, {"share": 8})


@register("G14_length_moments", """
SELECT "column", count(*) AS n, round(avg(len), 6) AS mean, round(var_samp(len), 6) AS variance,
       round(stddev_samp(len), 6) AS std, min(len) AS min, max(len) AS max, round(sum(len), 2) AS sum
FROM (SELECT 'text' AS "column", CAST(length(text) AS DOUBLE) AS len FROM documents
      UNION ALL SELECT 'lang', CAST(length(lang) AS DOUBLE) FROM documents
      UNION ALL SELECT 'source', CAST(length(source) AS DOUBLE) FROM documents) t GROUP BY 1""")
def q_lengths(spark, d):
    out = P.length_moments(table(spark, d, "documents"), ["text", "lang", "source"])
    return rounded(out, {"mean": 6, "variance": 6, "std": 6, "sum": 2})


@register("G16_top_words", """
WITH w AS (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents),
c AS (SELECT word, count(*) AS count FROM w WHERE word <> '' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, word) AS rank FROM c)
SELECT rank, word, count, round(count / (SELECT sum(count) FROM c), 8) AS share FROM r WHERE rank <= 20""")
def q_top_words(spark, d):
    return rounded(P.top_words(table(spark, d, "documents"), "text", k=20), {"share": 8})


@register("G17_time_range", """
SELECT 'l_shipdate' AS "column", CAST(min(l_shipdate) AS VARCHAR) AS min, CAST(max(l_shipdate) AS VARCHAR) AS max FROM lineitem
UNION ALL SELECT 'ts', CAST(min(ts) AS VARCHAR), CAST(max(ts) AS VARCHAR) FROM events""")
def q_time_range(spark, d):
    a = P.time_range(table(spark, d, "lineitem"), ["l_shipdate"])
    b = P.time_range(table(spark, d, "events"), ["ts"])
    return a.unionByName(b)


@register("G21_quality_warnings", f"""
WITH o AS (SELECT 'l_quantity' AS "column", count(*) FILTER (WHERE l_quantity IS NULL) AS m, count(*) AS n,
                  count(DISTINCT l_quantity) AS u FROM {LINEITEM_NULLS_SQL} a
           UNION ALL SELECT 'l_linestatus', count(*) FILTER (WHERE l_linestatus IS NULL), count(*),
                  count(DISTINCT l_linestatus) FROM {LINEITEM_NULLS_SQL} b
           UNION ALL SELECT 'l_orderkey', 0, count(*), count(DISTINCT l_orderkey) FROM lineitem
           UNION ALL SELECT 'l_returnflag', 0, count(*), count(DISTINCT l_returnflag) FROM lineitem)
SELECT "column", 'missing' AS code, printf('%d values missing, %.2f%% of rows', m, m * 100.0 / n) AS message FROM o WHERE m > 0
UNION ALL SELECT "column", 'all_missing', 'no value present' FROM o WHERE m = n AND n > 0
UNION ALL SELECT "column", 'constant', 'the same value wherever one is present' FROM o WHERE u = 1
UNION ALL SELECT "column", 'unique', 'no value occurs twice: possibly an identifier'
          FROM o WHERE u = n AND n > 0""")
def q_warnings(spark, d):
    df = lineitem_with_nulls(spark, d).select("l_quantity", "l_linestatus", "l_orderkey", "l_returnflag")
    return P.quality_warnings(df)


@register("G35_column_statistics_export", """
SELECT 'o_totalprice' AS "column", 'numeric' AS role, CAST(0 AS BIGINT) AS num_missing,
       count(DISTINCT o_totalprice) AS num_unique, round(avg(o_totalprice), 6) AS mean,
       round(stddev_samp(o_totalprice), 6) AS std FROM orders
UNION ALL SELECT 'o_custkey', 'numeric', 0, count(DISTINCT o_custkey), round(avg(o_custkey), 6),
       round(stddev_samp(o_custkey), 6) FROM orders""")
def q_stats_export(spark, d):
    df = table(spark, d, "orders").select("o_totalprice", "o_custkey")
    ov = P.column_overview(df).select("column", "role", "num_missing", "num_unique")
    mo = P.numeric_moments(df).select("column", "mean", "std")
    return rounded(ov.join(mo, "column"), {"mean": 6, "std": 6})


@register("W02_monotonicity", """
WITH s AS (SELECT event_id, value, lead(value) OVER (ORDER BY event_id) AS nxt FROM events),
t AS (SELECT event_id, ts, lead(ts) OVER (ORDER BY event_id) AS nts FROM events)
SELECT 'value' AS "column", CASE WHEN count(*) = 0 THEN 'undefined'
  WHEN count(*) FILTER (WHERE nxt < value) = 0 AND count(*) FILTER (WHERE nxt > value) = 0 THEN 'constant'
  WHEN count(*) FILTER (WHERE nxt < value) = 0 THEN 'increasing'
  WHEN count(*) FILTER (WHERE nxt > value) = 0 THEN 'decreasing' ELSE 'none' END AS monotonicity FROM s
UNION ALL
SELECT 'ts', CASE WHEN count(*) = 0 THEN 'undefined'
  WHEN count(*) FILTER (WHERE nts < ts) = 0 AND count(*) FILTER (WHERE nts > ts) = 0 THEN 'constant'
  WHEN count(*) FILTER (WHERE nts < ts) = 0 THEN 'increasing'
  WHEN count(*) FILTER (WHERE nts > ts) = 0 THEN 'decreasing' ELSE 'none' END FROM t""")
def q_monotonic(spark, d):
    ev = table(spark, d, "events")
    a = P.monotonicity(ev, "value", "event_id")
    ts_num = ev.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts_us"))
    b = P.monotonicity(ts_num, "ts_us", "event_id").select(F.lit("ts").alias("column"), "monotonicity")
    return a.unionByName(b)
