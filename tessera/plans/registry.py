"""Registry of checkable queries: id -> (Spark builder, DuckDB oracle SQL or None).

Every query reads the given Parquet tables (or frames Spark derives from them) in full; ids are
the operator ids of the blueprint.  Floating results are rounded identically on both sides
(well above partition-order noise), counts are bigint on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(qid: str, sql: str | None = None):
    def deco(fn):
        if qid in REGISTRY:
            raise ValueError(f"duplicate query id {qid}")
        REGISTRY[qid] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c)
                       for c in df.columns])


# Missing values are derived identically in both engines (the tables hold no NULLs).
LINEITEM_NULLS_SQL = (
    "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, "
    "l_extendedprice, l_discount, l_tax, l_returnflag, "
    "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus, "
    "l_shipdate FROM lineitem)")


def lineitem_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity"))) \
        .withColumn("l_linestatus", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_linestatus")))
