"""Drift between the files of a dataset (G21): types, ranges and shares of missing values, file against the others.

Each distinct schema is scanned once; rows are profiled by ``_metadata.file_path`` with partial aggregates, so what is
shuffled is a row per file and column.  A file is compared with all other files together: their counts are the pooled ones
less its own, and their range comes from the two outermost files of each side.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import finite_or_null, is_missing, is_numeric
from tessera.session import cut_lineage
from tessera.sources.census import Group, groups_of
from tessera.sources.readers import SUPPORTED, _read_group, resolve_paths

#: a file's share of missing values may differ from the others' by so much
SHARE = 0.1
PROFILE = "file string, column string, type string, n long, missing long, lo double, hi double"


def file_profiles(spark: SparkSession, source: str | Sequence[str], fmt: str | None = None, csv_options: dict | None = None) -> DataFrame:
    """file, column, type, n, missing, lo and hi (of finite numbers) of every file and column of ``source``; a written table."""
    files = [(p, fmt or SUPPORTED.get(os.path.splitext(p)[1].lower())) for p in resolve_paths(spark, source)]
    if any(kind is None for _, kind in files):
        raise ValueError(f"Unsupported file types: {sorted(p for p, kind in files if kind is None)}")
    out = None
    for group in groups_of(spark, files, csv_options or {}, False):
        for scan in ([Group("json", None, (), [p]) for p in group.paths] if group.kind == "json" else [group]):
            part = _profiles(_read_group(spark, scan, None, csv_options or {}, False))
            out = part if out is None else out.unionByName(part)
    return cut_lineage(out)


def _profiles(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema:
        value = finite_or_null(f.name) if is_numeric(f.dataType) else F.lit(None).cast("double")
        columns.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                                is_missing(f.name, f.dataType).alias("gone"), value.alias("v")))
    long = df.select(F.col("_metadata.file_path").alias("file"), F.inline(F.array(*columns)))
    return long.groupBy("file", "column", "type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("missing"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def drift(profiles: DataFrame, share: float = SHARE) -> DataFrame:
    """file, column, code, own, others of the files that differ (profiles: see ``file_profiles``).

    ``dtype_drift``: a type other than that of most rows (of equal ones, the first by name); own and others are type names.
    ``missing_drift``: a share of missing values farther than ``share`` from that of the other files together, and from the
    median file's (else one odd file would make all others look odd).
    ``range_drift``: numbers that all lie outside the range of the other files' numbers; own and others are lo..hi."""
    types = profiles.groupBy("column", "type").agg(F.sum("n").alias("rows"))
    common = types.groupBy("column").agg(F.min_by("type", F.struct(-F.col("rows"), "type")).alias("common"))
    pooled = profiles.groupBy("column").agg(F.sum("n").alias("all_n"), F.sum("missing").alias("all_missing"),
                                            F.median(F.col("missing") / F.col("n")).alias("middle"))  # a number per file

    def outermost(value, order):
        ranked = profiles.where(F.col(value).isNotNull()).withColumn("at", F.row_number().over(
            Window.partitionBy("column").orderBy(order, "file"))).where("at <= 2")
        return ranked.groupBy("column").agg(
            F.max(F.when(F.col("at") == 1, F.struct("file", F.col(value).alias("v")))).alias(f"first_{value}"),
            F.max(F.when(F.col("at") == 2, F.col(value))).alias(f"second_{value}"))

    rows = profiles.join(common, "column").join(pooled, "column").join(outermost("lo", F.asc("lo")), "column", "left").join(
        outermost("hi", F.desc("hi")), "column", "left")

    def of_others(value):
        first = F.col(f"first_{value}")
        return F.when(first["file"] == F.col("file"), F.col(f"second_{value}")).otherwise(first["v"])

    rows = rows.withColumns({"o_lo": of_others("lo"), "o_hi": of_others("hi"), "o_n": F.col("all_n") - F.col("n"),
                             "own_share": F.col("missing") / F.col("n"),
                             "o_share": (F.col("all_missing") - F.col("missing")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))})
    text = lambda a, b: F.concat_ws("..", F.col(a).cast("string"), F.col(b).cast("string"))
    per_cent = lambda c: F.format_string("%.2f%%", 100 * F.col(c))
    rules = [("dtype_drift", F.col("type") != F.col("common"), F.col("type"), F.col("common")),
             ("missing_drift", (F.abs(F.col("own_share") - F.col("o_share")) > share) & (
                 F.abs(F.col("own_share") - F.col("middle")) > share), per_cent("own_share"), per_cent("o_share")),
             ("range_drift", (F.col("lo") > F.col("o_hi")) | (F.col("hi") < F.col("o_lo")), text("lo", "hi"), text("o_lo", "o_hi"))]
    found = F.array(*[F.when(rule, F.struct(F.lit(code).alias("code"), own.alias("own"), others.alias("others")))
                      for code, rule, own, others in rules])
    return rows.select("file", "column", F.inline(F.filter(found, lambda s: s.isNotNull())))
