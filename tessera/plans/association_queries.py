"""Registered association queries (A01-A07) with DuckDB oracles generated per pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import associations as A
from tessera.plans.registry import LINEITEM_NULLS_SQL, lineitem_with_nulls, register, rounded

SRC = LINEITEM_NULLS_SQL


def pearson_sql(src: str, a: str, b: str) -> str:
    ok = f"isfinite({a}) AND isfinite({b})"
    xa, xb = f"CASE WHEN {ok} THEN {a} END", f"CASE WHEN {ok} THEN {b} END"
    valid = f"count({xa}) >= 2 AND var_pop({xa}) > 0 AND var_pop({xb}) > 0"
    return (f"SELECT '{a}' AS x, '{b}' AS y, 'pearson' AS method, "
            f"round(CASE WHEN {valid} THEN greatest(-1.0, least(1.0, corr({xa}, {xb}))) END, 8) AS value, "
            f"count({xa}) AS rows, CASE WHEN {valid} THEN 'ok' ELSE 'undefined' END AS status FROM {src} t")


def cramers_sql(src: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS x, '{b}' AS y, 'cramers_v' AS method,
  round(CASE WHEN least(ka, kb) >= 2
        THEN least(1.0, sqrt(greatest(0.0, n * (s - 1)) / (n * (least(ka, kb) - 1)))) END, 8) AS value,
  CAST(n AS BIGINT) AS rows,
  CASE WHEN least(ka, kb) < 2 THEN 'undefined' ELSE 'ok' END AS status
FROM (SELECT sum((nij / ri) * (nij / cj)) AS s, sum(nij) AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb
      FROM (SELECT a, b, nij, sum(nij) OVER (PARTITION BY a) AS ri, sum(nij) OVER (PARTITION BY b) AS cj
            FROM (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS nij FROM {src} t
                  WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) c) j) z"""


def eta_sql(src: str, cat: str, num: str) -> str:
    return f"""SELECT '{cat}' AS x, '{num}' AS y, 'correlation_ratio' AS method,
  round(CASE WHEN sst > 0 AND k >= 2 THEN sqrt(least(1.0, ssb / sst)) END, 8) AS value, CAST(n AS BIGINT) AS rows,
  CASE WHEN sst > 0 AND k >= 2 THEN 'ok' ELSE 'undefined' END AS status
FROM (SELECT sum(ng * (mg - m) * (mg - m)) AS ssb, count(*) AS k, max(n) AS n, max(sst) AS sst
      FROM (SELECT g, count(*) AS ng, avg(v) AS mg FROM
              (SELECT CAST({cat} AS VARCHAR) AS g, CAST({num} AS DOUBLE) AS v FROM {src} t
               WHERE {cat} IS NOT NULL AND isfinite({num})) GROUP BY g) gg,
           (SELECT count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS sst FROM
              (SELECT CAST({num} AS DOUBLE) AS v FROM {src} t WHERE {cat} IS NOT NULL AND isfinite({num}))) tt) z"""


PEARSON_PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_extendedprice", "l_discount")]
CRAMER_PAIRS = [("l_returnflag", "l_linestatus"), ("l_linestatus", "l_tax")]
ETA_PAIRS = [("l_returnflag", "l_extendedprice"), ("l_linestatus", "l_quantity")]


@register("A01_pearson", " UNION ALL ".join(pearson_sql(SRC, a, b) for a, b in PEARSON_PAIRS))
def q_pearson(spark, d):
    return rounded(A.pearson(lineitem_with_nulls(spark, d), PEARSON_PAIRS), {"value": 8})


@register("A02_cramers_v", " UNION ALL ".join(cramers_sql(SRC, a, b) for a, b in CRAMER_PAIRS))
def q_cramers(spark, d):
    return rounded(A.cramers_v(lineitem_with_nulls(spark, d), CRAMER_PAIRS), {"value": 8})


@register("A03_correlation_ratio", " UNION ALL ".join(eta_sql(SRC, a, b) for a, b in ETA_PAIRS))
def q_eta(spark, d):
    return rounded(A.correlation_ratio(lineitem_with_nulls(spark, d), ETA_PAIRS), {"value": 8})


# Every column of lineitem and four derived ones: 105 pairs; the roles follow the full-data rule (a number with
# more than 10 distinct values is numeric), ``l_shipmonth`` has more than 50 levels.
AT_ROLES = {"l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "category",
            "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "category",
            "l_returnflag": "category", "l_linestatus": "category", "l_net": "numeric", "l_charge": "numeric",
            "l_unit": "numeric", "l_shipmonth": "category", "l_shipyear": "category"}
AT_SQL = f"""(SELECT * EXCLUDE (l_shipdate), l_extendedprice * (1 - l_discount) AS l_net, l_extendedprice * (1 + l_tax) AS l_charge,
  l_extendedprice / l_quantity AS l_unit, strftime(l_shipdate, '%Y-%m') AS l_shipmonth, year(l_shipdate) AS l_shipyear FROM {SRC} s)"""


def _assoc_sql() -> str:
    text = {("numeric", "numeric"): pearson_sql, ("category", "category"): cramers_sql, ("category", "numeric"): eta_sql}
    parts = [text[kinds](AT_SQL, a, b) for kinds, pairs in A.role_pairs(AT_ROLES, list(AT_ROLES)).items() for a, b in pairs]
    return " UNION ALL ".join(f"({p})" for p in parts)


def _assoc_spark(spark, d):
    price = F.col("l_extendedprice")
    df = lineitem_with_nulls(spark, d).withColumns({
        "l_net": price * (1 - F.col("l_discount")), "l_charge": price * (1 + F.col("l_tax")),
        "l_unit": price / F.col("l_quantity"), "l_shipmonth": F.date_format("l_shipdate", "yyyy-MM"),
        "l_shipyear": F.year("l_shipdate")})
    return A.association_table(df, AT_ROLES, list(AT_ROLES))


@register("A04_association_table", _assoc_sql())
def q_assoc(spark, d):
    return rounded(_assoc_spark(spark, d), {"value": 8})


@register("A07_strongest_pairs", f"SELECT * FROM ({_assoc_sql()}) a WHERE value IS NOT NULL "
                                 "ORDER BY abs(value) DESC, x, y LIMIT 3")
def q_strongest(spark, d):
    return A.strongest(rounded(_assoc_spark(spark, d), {"value": 8}), 3)


@register("A05_spearman", f"""
WITH c AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y FROM {SRC} t
           WHERE isfinite(l_quantity) AND isfinite(l_discount)),
r AS (SELECT (rank() OVER (ORDER BY x) + rank() OVER (ORDER BY x) + count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
             (rank() OVER (ORDER BY y) + rank() OVER (ORDER BY y) + count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
      FROM c)
SELECT 'l_quantity' AS x, 'l_discount' AS y, 'spearman' AS method, round(corr(rx, ry), 8) AS value,
       count(*) AS rows, 'ok' AS status FROM r""")
def q_spearman(spark, d):
    return rounded(A.spearman(lineitem_with_nulls(spark, d), "l_quantity", "l_discount"), {"value": 8})


@register("A06_least_squares", """
SELECT round(regr_slope(o_totalprice, CAST(o_custkey AS DOUBLE)), 8) AS slope,
       round(regr_intercept(o_totalprice, CAST(o_custkey AS DOUBLE)), 4) AS intercept,
       CAST(regr_count(o_totalprice, o_custkey) AS BIGINT) AS rows FROM orders""")
def q_lsq(spark, d):
    from tessera.plans.registry import table
    out = A.least_squares(table(spark, d, "orders"), "o_custkey", "o_totalprice")
    return rounded(out.withColumn("rows", F.col("rows").cast("bigint")), {"slope": 8, "intercept": 4})
