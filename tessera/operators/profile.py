"""Table and column profile.

Plan shapes:

* every per-column moment, count and flag of every column comes from **one** wide ``agg``
  (one scan, partial/final aggregation), unpivoted afterwards on its single result row;
* quantiles, MAD, IQR outliers and histograms of all numeric columns run on one unpivoted
  ``(column, x)`` table keyed by column, through the range-partitioned rank core
  (``functions.ranking``) -- no single-task ``percentile`` merge;
* frequencies and distinct counts of all columns come from one ``groupBy(column, value)``;
  top-k per column is a salted two-stage window, so a column with billions of distinct
  values never sorts in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import (finite_or_null, is_finite, is_float, is_missing, is_numeric,
                                       text_length)
from tessera.functions.ranking import cumulative, exact_quantiles, ranked_quantiles

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
QUANTILE_NAMES = ("p5", "q1", "median", "q3", "p95")
ROLES = ("numeric", "category", "text", "datetime", "timedelta")


def dtype_role(dt: T.DataType) -> str:
    """Role from the storage type alone (before the full-data cardinality rule)."""
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "timedelta"
    if isinstance(dt, T.BooleanType):
        return "category"
    if is_numeric(dt):
        return "numeric"
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return "nested"
    return "text"


_WIDTHS = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
           T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
           T.DecimalType: 16, T.DayTimeIntervalType: 8, T.YearMonthIntervalType: 4}


def _width(dt: T.DataType) -> int:
    """Fixed storage width in bytes of a non-string value (G20 re-aimed as bytes per column)."""
    return _WIDTHS.get(type(dt), 8)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if dtype_role(f.dataType) == "numeric"]


def long_values(df: DataFrame, columns: Sequence[str], finite_only: bool = True) -> DataFrame:
    """(column, x double) for the given numeric columns; finite values only by default."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]
    out = df.select(F.inline(F.array(*entries)))
    return out.where(is_finite("x")) if finite_only else out


# ---------------------------------------------------------------- G01, G18: table summary

DIGESTED = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def table_summary(df: DataFrame) -> DataFrame:
    """G01 + G18: rows, columns, missing cells, missing share, duplicate rows (NULL = NULL,
    NaN treated as missing)."""
    fields = df.schema.fields
    miss = [F.when(is_missing(f.name, f.dataType), 1).otherwise(0) for f in fields]
    total_missing = miss[0] if len(miss) == 1 else sum(miss[1:], miss[0])
    summary = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(total_missing).cast("bigint").alias("missing_cells"))
    # duplicates: rows - distinct rows; NaN -> NULL first so NaN rows compare equal like pandas, -0.0 -> 0.0
    normalised = df.select(*[(F.when(~F.isnan(f.name), F.col(f.name) + F.lit(0.0)) if is_float(f.dataType) else F.col(f.name))
                             .alias(f.name) for f in fields])
    names = [f.name for f in fields]
    if all(isinstance(f.dataType, DIGESTED) for f in fields):  # a digest travels in place of the row, long texts included
        normalised = normalised.select(F.unhex(F.sha2(F.to_json(F.struct(*names)), 256)).alias("row"))
        names = ["row"]
    dup = normalised.groupBy(*names).count() \
        .agg(F.sum(F.col("count") - 1).cast("bigint").alias("duplicate_rows"))
    ncols = len(fields)
    return summary.crossJoin(dup).select(
        F.col("rows").cast("bigint").alias("rows"),
        F.lit(ncols).cast("bigint").alias("columns"),
        F.coalesce(F.col("missing_cells"), F.lit(0)).cast("bigint").alias("missing_cells"),
        F.when(F.col("rows") > 0, F.col("missing_cells") / (F.col("rows") * ncols)).otherwise(0.0)
        .alias("missing_share"),
        F.coalesce(F.col("duplicate_rows"), F.lit(0)).cast("bigint").alias("duplicate_rows"))


# ---------------------------------------------------------------- G02-G07: one wide agg

def moment_shifts(df: DataFrame, columns: Sequence[str]) -> dict:
    """Per-column shift for stable moments: the mean of all finite values (one column-pruned aggregate),
    0 when there are none."""
    if not columns:
        return {}
    got = df.agg(*[F.avg(finite_or_null(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: float(got[f"s{i}"] or 0.0) for i, c in enumerate(columns)}


def numeric_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """G02-G07 for numeric columns, one row per column, from a single scan.

    The columns are unpivoted to (column, value) rows and aggregated grouped by column: the
    aggregation buffer stays a dozen fields wide however many columns the table has, so the
    stage keeps whole-stage codegen (one wide ``agg`` over many columns exceeds
    ``spark.sql.codegen.maxFields`` and runs interpreted).  Moments use finite values only,
    centred on a per-column shift; skew and kurtosis are the bias-adjusted estimators (NULL when
    n <= 2 / n <= 3 or zero variance)."""
    cols = list(columns or numeric_columns(df))
    shifts = moment_shifts(df, cols)
    entries = []
    for c in cols:
        dt = df.schema[c].dataType
        raw = F.col(c).cast("double")
        x = finite_or_null(c)
        entries.append(F.struct(F.lit(c).alias("column"), x.alias("x"), (x - F.lit(shifts[c])).alias("s"),
                                is_missing(c, dt).alias("m"),
                                (raw.isNotNull() & (F.abs(raw) == F.lit(float("inf")))).alias("i")))
    long = df.select(F.inline(F.array(*entries)))
    x, xs = F.col("x"), F.col("s")
    agg = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(x).alias("n"), F.avg(x).alias("mean"),
        F.var_samp(xs).alias("variance"), F.stddev_samp(xs).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"), F.sum(x).alias("sum"), F.skewness(xs).alias("_sk"), F.kurtosis(xs).alias("_ku"),
        F.count_if(F.col("m")).alias("num_missing"), F.count_if(F.col("i")).alias("num_infinity"),
        F.count_if(x == 0).alias("num_zeros"), F.count_if(x < 0).alias("num_neg"))
    n = F.col("n").cast("double")
    rows = F.col("_rows")
    sk = F.when((F.col("n") > 2) & (F.col("variance") > 0), F.col("_sk") * F.sqrt(n * (n - 1)) / (n - 2))
    ku = F.when((F.col("n") > 3) & (F.col("variance") > 0),
                (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_ku") + 6))
    share = lambda k: F.when(rows > 0, F.col(k) / rows).otherwise(0.0)
    return agg.select(
        "column", "n", "mean", "variance", "std", "min", "max", "sum", sk.alias("skew"), ku.alias("kurtosis"),
        (F.col("max") - F.col("min")).alias("range"),
        F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).alias("cv"),
        "num_missing", share("num_missing").alias("pct_missing"),
        "num_infinity", share("num_infinity").alias("pct_infinity"),
        "num_zeros", share("num_zeros").alias("pct_zeros"), "num_neg", share("num_neg").alias("pct_neg"))


# ---------------------------------------------------------------- G08-G10: quantiles

def numeric_quantiles(df: DataFrame, columns: Sequence[str] | None = None,
                      partitions: int | None = None) -> DataFrame:
    """Exact p5/Q1/median/Q3/p95, IQR, MAD and 1.5-IQR outlier count per column.

    All columns share one unpivoted table; quantiles come from the distributed rank core.
    MAD is a second exact median over |x - median| (medians join back as a #columns-row table).
    """
    cols = list(columns or numeric_columns(df))
    long = long_values(df, cols)
    q = exact_quantiles(long, "x", QUANTILES, keys=["column"], partitions=partitions)
    wide = q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                     for p, n in zip(QUANTILES, QUANTILE_NAMES)])
    # small per-column table (one row per profiled column): a bounded broadcast
    bounds = F.broadcast(wide)
    dev = long.join(bounds.select("column", "median", "q1", "q3"), "column") \
        .select("column", F.abs(F.col("x") - F.col("median")).alias("d"),
                ((F.col("x") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) |
                 (F.col("x") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))).alias("out"))
    # one pass over the deviations: (column, d) counts carry their outlier counts, so MAD's rank
    # table (materialised once by the rank core) also yields the outlier totals
    dev_counts = dev.groupBy("column", "d").agg(F.count(F.lit(1)).alias("cnt"), F.count_if("out").alias("_out"))
    ranked = cumulative(dev_counts, ["column"], ["d"], partitions=partitions)
    mad = ranked_quantiles(ranked, "d", [0.5], keys=["column"]).select("column", F.col("q").alias("mad"))
    outl = ranked.groupBy("column").agg(F.sum("_out").alias("outliers"), F.max("total").alias("n"))
    return wide.join(mad, "column").join(outl, "column").select(
        "column", *QUANTILE_NAMES, (F.col("q3") - F.col("q1")).alias("iqr"), "mad",
        F.col("outliers").cast("bigint").alias("outliers"),
        (F.col("outliers") / F.col("n")).alias("outlier_share"))


# ---------------------------------------------------------------- G11: histogram

def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30,
              group: str | None = None) -> DataFrame:
    """Equal-width histogram on finite values; last bin closed; a constant column uses
    edges min-0.5 .. max+0.5.  With ``group``, all groups share the column's edges.  Dense: every
    bin is present (count 0 when empty).  Output: [group,] column, bin, lower, upper, count."""
    cols = list(columns or numeric_columns(df))
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]
    keep = [group] if group else []
    long = df.select(*keep, F.inline(F.array(*entries))).where(is_finite("x"))
    if group:
        long = long.where(F.col(group).isNotNull())
    rng = long.groupBy("column").agg(F.min("x").alias("lo0"), F.max("x").alias("hi0")).select(
        "column",
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                F.lit(bins - 1)).cast("int")
    counted = long.join(F.broadcast(rng), "column").groupBy(*keep, "column", b.alias("bin")) \
        .agg(F.count(F.lit(1)).alias("count"))
    spine = rng.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    if group:
        groups = long.select(group, "column").distinct()
        spine = spine.join(groups, "column")
    out = spine.join(counted, [*keep, "column", "bin"], "left").select(
        *keep, "column", "bin",
        (F.col("lo") + F.col("bin") * width).alias("lower"),
        F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width)
        .alias("upper"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))
    return out


# ---------------------------------------------------------------- G12-G15, G19: frequencies

def value_text(c: str, dt: T.DataType):
    """Canonical text of a value for frequency tables (integral doubles keep Spark's '1.0')."""
    x = F.col(c)
    if is_float(dt):
        x = F.when(F.isnan(x), None).when(x == 0, F.lit(0.0).cast(dt)).otherwise(x)
    return x.cast("string")


def frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, count) over non-missing values of every column; one unpivoted groupBy
    with map-side partial counts, so a hot value collapses before the shuffle."""
    fields = [df.schema[c] for c in (columns or df.columns)]
    fields = [f for f in fields if dtype_role(f.dataType) != "nested"]
    entries = [F.struct(F.lit(f.name).alias("column"), value_text(f.name, f.dataType).alias("value"))
               for f in fields]
    long = df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, salt_of: str | None = None,
          salts: int = 64, rank_name: str = "rank") -> DataFrame:
    """Exact top-k per key in two window stages: first per (key, salt) then per key over at most
    ``salts * k`` survivors.  ``order`` must be a total order (include a tie-break)."""
    keys = list(keys)
    if salt_of is not None:
        salt = F.pmod(F.xxhash64(F.col(salt_of)), F.lit(salts))
        df = df.withColumn("_s", salt).withColumn("_r1", F.row_number().over(
            Window.partitionBy(*keys, "_s").orderBy(*order))).where(F.col("_r1") <= k).drop("_s", "_r1")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w).cast("bigint")).where(F.col(rank_name) <= k)


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Top-k values per column by count desc, value asc; share over all rows (incl. missing)."""
    freq = frequencies(df, columns)
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    top = top_k(freq, ["column"], [F.col("count").desc(), F.col("value").asc()], k, salt_of="value")
    return top.crossJoin(F.broadcast(rows)).select(
        "column", "rank", "value", F.col("count").cast("bigint").alias("count"),
        (F.col("count") / F.col("_rows")).alias("share"))


def column_overview(df: DataFrame, categorical_threshold: int = 10,
                    roles: dict[str, str] | None = None) -> DataFrame:
    """Per column role, missing, distinct count and share, flags,
    cardinality and byte size.  Distinct counts are exact (no cap), from the frequency table."""
    roles = dict(roles or {})
    fields = [f for f in df.schema.fields if dtype_role(f.dataType) != "nested"]
    freq = frequencies(df, [f.name for f in fields])
    distinct = freq.groupBy("column").agg(F.count(F.lit(1)).alias("num_unique"))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}"))
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.sum(F.octet_length(F.col(f.name)))
        else:
            size = F.count(F.col(f.name)) * F.lit(_width(f.dataType))
        aggs.append(size.cast("bigint").alias(f"b{i}"))
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                        F.lit(dtype_role(f.dataType)).alias("base_role"),
                        F.lit(roles.get(f.name)).cast("string").alias("override"),
                        F.col(f"m{i}").alias("num_missing"), F.col(f"b{i}").alias("memory_bytes"))
               for i, f in enumerate(fields)]
    per = wide.select("_rows", F.inline(F.array(*entries)))
    out = per.join(distinct, "column", "left").withColumn("num_unique", F.coalesce("num_unique", F.lit(0)))
    rows = F.col("_rows")
    promote = (F.col("base_role").isin("numeric", "text") & (F.lit(categorical_threshold) > 0)
               & (F.col("num_unique") >= 1) & (F.col("num_unique") <= categorical_threshold))
    role = F.coalesce(F.col("override"), F.when(promote, F.lit("category")).otherwise(F.col("base_role")))
    return out.select(
        "column", "dtype", role.alias("role"),
        F.col("num_missing").cast("bigint").alias("num_missing"),
        F.when(rows > 0, F.col("num_missing") / rows).otherwise(0.0).alias("pct_missing"),
        F.col("num_unique").cast("bigint").alias("num_unique"),
        F.when(rows > 0, F.col("num_unique") / rows).alias("pct_unique"),
        (F.col("num_unique") == 1).alias("is_constant"),
        ((rows > 0) & (F.col("num_missing") == rows)).alias("all_missing"),
        ((rows > 0) & (F.col("num_unique") == rows)).alias("possible_id"),
        F.when(F.col("num_unique") < 20, "low").when(F.col("num_unique") < 1000, "medium")
        .otherwise("high").alias("cardinality"),
        "memory_bytes")


# ---------------------------------------------------------------- G14, G16, G17

def length_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Characters of the text form of each non-missing value, as moments."""
    entries = [F.struct(F.lit(c).alias("column"),
                        F.when(~is_missing(c, df.schema[c].dataType), text_length(c)).alias("len"))
               for c in columns]
    long = df.select(F.inline(F.array(*entries))).where(F.col("len").isNotNull())
    x = F.col("len").cast("double")
    n = F.count(x)
    return long.groupBy("column").agg(
        n.alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"))


def words(df: DataFrame, column: str) -> DataFrame:
    """Lower-cased whitespace-split words of a text column (Python ``str.lower().split()``)."""
    text = F.lower(F.col(column).cast("string"))
    return df.where(F.col(column).isNotNull()).select(
        F.explode(F.split(text, r"\s+")).alias("word")).where(F.col("word") != "")


def top_words(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Word counts, top-k by count desc then word asc, share of all words."""
    counts = words(df, column).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    top = top_k(counts.withColumn("_k", F.lit(0)), ["_k"], [F.col("count").desc(), F.col("word").asc()], k,
                salt_of="word")
    return top.crossJoin(F.broadcast(total)).select(
        "rank", "word", F.col("count").cast("bigint").alias("count"),
        (F.col("count") / F.col("_total")).alias("share"))


def time_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min and max of datetime/timedelta columns (as text, one row per column)."""
    entries = [F.struct(F.lit(c).alias("column"), F.min(c).cast("string").alias("min"),
                        F.max(c).cast("string").alias("max")) for c in columns]
    return df.agg(F.array(*entries).alias("a")).select(F.inline("a"))


# ---------------------------------------------------------------- G21: warnings

def quality_warnings(df: DataFrame, categorical_threshold: int = 10) -> DataFrame:
    """(column, code, message) from the column overview and infinity counts."""
    ov = column_overview(df, categorical_threshold)
    num = numeric_columns(df)
    if num:
        inf = numeric_moments(df, num).select("column", "num_infinity")
        ov = ov.join(inf, "column", "left")
    else:
        ov = ov.withColumn("num_infinity", F.lit(None).cast("bigint"))
    rules = [
        ("missing", F.col("num_missing") > 0,
         F.format_string("%d values missing, %.2f%% of rows", F.col("num_missing"), F.col("pct_missing") * 100)),
        ("all_missing", F.col("all_missing"), F.lit("no value present")),
        ("constant", F.col("is_constant"), F.lit("the same value wherever one is present")),
        ("unique", F.col("possible_id"),
         F.lit("no value occurs twice: possibly an identifier")),
        ("infinity", F.coalesce(F.col("num_infinity"), F.lit(0)) > 0,
         F.lit("infinite values, left out of the statistics")),
    ]
    found = F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), msg.alias("message")))
                      for code, cond, msg in rules])
    return ov.select("column", F.explode(F.filter(found, lambda s: s.isNotNull())).alias("w")) \
        .select("column", "w.code", "w.message")


# ---------------------------------------------------------------- W02: monotonicity

def monotonicity(df: DataFrame, column: str, order: str) -> DataFrame:
    """Constant / increasing / decreasing / none / undefined over finite values in ``order``.

    Each row is compared with its predecessor among finite rows, found inside range slices with a halo (see ranking), and the
    verdict is one agg."""
    base = df.where(is_finite(column)).select(F.col(order).alias("_o"), F.col(column).cast("double").alias("_v"))
    from tessera.functions.ranking import lagged
    pairs = lagged(base, [], ["_o"], {"_last": ("_v", 1)})
    agg = pairs.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col("_v") < F.col("_last")).alias("dec"),
                    F.count_if(F.col("_v") > F.col("_last")).alias("inc"))
    verdict = (F.when(F.col("n") == 0, "undefined")
               .when((F.col("dec") == 0) & (F.col("inc") == 0), "constant")
               .when(F.col("dec") == 0, "increasing").when(F.col("inc") == 0, "decreasing")
               .otherwise("none"))
    return agg.select(F.lit(column).alias("column"), verdict.alias("monotonicity"))
