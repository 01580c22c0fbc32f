"""Distribution operators: the data behind the charts (D01-D15, G23-G32).  Drawing is not built.

Every operator takes finite, complete rows of the named columns and covers every group, category,
column and pattern.  A caller may ask for the n most frequent (ties by text); the rest is then one
row or group labelled ``REST``, never dropped.  Large work is expressed as aggregates over distinct values:
KDE and ECDF first collapse to ``(value, count)``, so repeated values cost nothing extra.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import is_finite, is_missing
from tessera.functions.ranking import cumulative, exact_quantiles, value_counts
from tessera.operators.profile import histogram

GRID = 256
REST = "[remaining categories]"
SQRT_2PI = math.sqrt(2 * math.pi)


def _label_rest(base: DataFrame, column: str, n: int | None) -> DataFrame:
    """``base`` with all but the ``n`` most frequent values of ``column`` (ties by text) labelled
    ``REST``; unchanged without ``n``.  The list that is broadcast has ``n`` rows."""
    if n is None:
        return base
    top = base.groupBy(column).count().orderBy(F.col("count").desc(), F.col(column)).limit(n)
    kept = F.broadcast(top.select(column, F.lit(True).alias("_kept")))
    return base.join(kept, column, "left").withColumn(
        column, F.when(F.col("_kept"), F.col(column)).otherwise(F.lit(REST))).drop("_kept")


def finite_rows(df: DataFrame, x: str, group: str | None = None, max_groups: int | None = None) -> DataFrame:
    """(group?, x double) over finite x (and non-missing group, as text), for all groups; with
    ``max_groups`` the smaller groups together form the group ``REST``."""
    cond = is_finite(x)
    cols = [F.col(x).cast("double").alias(x)]
    if group:
        cond = cond & ~is_missing(group, df.schema[group].dataType)
        cols = [F.col(group).cast("string").alias(group)] + cols
    base = df.where(cond).select(*cols)
    return _label_rest(base, group, max_groups) if group else base


# ---------------------------------------------------------------- D01 histogram by group

def grouped_histogram(df: DataFrame, x: str, group: str | None = None, bins: int = 30,
                      density: bool = False, max_groups: int | None = None) -> DataFrame:
    """Histogram on edges common to all groups; ``density`` = n / (N_group * width)."""
    base = finite_rows(df, x, group, max_groups)
    h = histogram(base, [x], bins=bins, group=group)
    if not density:
        return h
    keys = [group] if group else []
    w = Window.partitionBy(*keys, "column") if keys else Window.partitionBy("column")
    return h.withColumn("density", F.col("count") / (F.sum("count").over(w) * (F.col("upper") - F.col("lower"))))


# ---------------------------------------------------------------- D02 / D05 kernel density

def kde(df: DataFrame, x: str, group: str | None = None, bandwidth: float | None = None,
        max_groups: int | None = None, scale_to_max: bool = False) -> DataFrame:
    """Gaussian KDE on 256 points over [min - 3h, max + 3h], h = 1.06 s n^-0.2 (Silverman,
    sample std) unless given; none for fewer than 2 rows or a constant group.

    Distinct values with counts are crossed with the 256-point grid of their group (the grid is
    256 rows per group: a bounded broadcast), so work is 256 x distinct values.  D05
    (``scale_to_max``) rescales each group's curve to its own maximum."""
    keys = [group] if group else []
    base = finite_rows(df, x, group, max_groups)
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("s"),
                                    F.min(x).alias("lo"), F.max(x).alias("hi"))
    hcol = F.lit(float(bandwidth)) if bandwidth is not None else 1.06 * F.col("s") * F.pow(F.col("n"), -0.2)
    stats = stats.where((F.col("n") >= 2) & (F.col("hi") > F.col("lo"))).withColumn("h", hcol)
    grid = stats.select(*keys, "n", "h", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("i"),
                        "lo", "hi")
    grid = grid.withColumn("g", (F.col("lo") - 3 * F.col("h")) + F.col("i") *
                           ((F.col("hi") + 3 * F.col("h")) - (F.col("lo") - 3 * F.col("h"))) / (GRID - 1))
    vals = value_counts(base, keys, [x])
    crossed = (vals.join(F.broadcast(grid), keys) if keys else vals.crossJoin(F.broadcast(grid)))
    u = (F.col("g") - F.col(x)) / F.col("h")
    dens = crossed.groupBy(*keys, "i", "g", "n", "h").agg(F.sum(F.col("cnt") * F.exp(-0.5 * u * u)).alias("k"))
    out = dens.select(*keys, F.col("i").alias("point"), F.col("g").alias("x"),
                      (F.col("k") / (F.col("n") * F.col("h") * SQRT_2PI)).alias("density"))
    if scale_to_max:
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        out = out.withColumn("scaled", F.col("density") / F.max("density").over(w))
    return out


# ---------------------------------------------------------------- D03 ECDF

def ecdf(df: DataFrame, x: str, group: str | None = None, max_groups: int | None = None) -> DataFrame:
    """Fraction of rows at or below each distinct value, per group."""
    keys = [group] if group else []
    base = finite_rows(df, x, group, max_groups)
    ranked = cumulative(value_counts(base, keys, [x]), keys, [x])
    return ranked.select(*keys, x, F.col("cnt").alias("count"),
                         ((F.col("before") + F.col("cnt")) / F.col("total")).alias("fraction"))


# ---------------------------------------------------------------- D04 box / D08 outliers

def box_stats(df: DataFrame, x: str, group: str | None = None, max_groups: int | None = None) -> DataFrame:
    """Median, Q1, Q3, whiskers at the extreme values within 1.5 IQR, outlier count."""
    keys = [group] if group else []
    base = finite_rows(df, x, group, max_groups)
    q = exact_quantiles(base, x, [0.25, 0.5, 0.75], keys)
    qw = q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    joined = base.join(F.broadcast(qw), keys) if keys else base.crossJoin(F.broadcast(qw))
    inside = (F.col(x) >= lo) & (F.col(x) <= hi)
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(x))).alias("whisker_low"), F.max(F.when(inside, F.col(x))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"))


def outlier_rows(df: DataFrame, x: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every finite row flagged by the 1.5-IQR rule, with the bounds."""
    base = df.where(is_finite(x)).select(*keep, F.col(x).cast("double").alias(x))
    q = exact_quantiles(base.select(x), x, [0.25, 0.75])
    b = q.agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
              F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3")) \
        .select((F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower"),
                (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper"))
    return base.crossJoin(F.broadcast(b)).withColumn(
        "is_outlier", (F.col(x) < F.col("lower")) | (F.col(x) > F.col("upper")))


# ---------------------------------------------------------------- D07 normal Q-Q

# Coefficients of Wichura's algorithm AS 241 (PPND16), Applied Statistics 37 (1988).
AS241_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
           1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
           3.3430575583588128105e4, 2.5090809287301226727e3]
AS241_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
           2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
           5.2264952788528545610e3]
AS241_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
           3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
           2.27238449892691845833e-2, 7.74545014278341407640e-4]
AS241_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
           1.05075007164441684324e-9]
AS241_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
           2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
           2.71155556874348757815e-5, 2.01033439929228813265e-7]
AS241_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
           2.04426310338993978564e-15]


def _poly(coeffs, r):
    """Horner evaluation, highest power innermost; works on Columns and on SQL text alike."""
    acc = None
    for c in reversed(coeffs):
        acc = c if acc is None else (acc * r + c if not isinstance(r, str) else f"({acc}) * {r} + {c!r}")
    return acc


def inv_norm(p: Column) -> Column:
    """Standard normal quantile for p in (0, 1) as a JVM column expression (AS 241)."""
    q = p - 0.5
    r1 = 0.180625 - q * q
    central = q * _poly(AS241_A, r1) / _poly(AS241_B, r1)
    tail_p = F.least(p, 1 - p)
    r = F.sqrt(-F.log(tail_p))
    near = _poly(AS241_C, r - 1.6) / _poly(AS241_D, r - 1.6)
    far = _poly(AS241_E, r - 5.0) / _poly(AS241_F, r - 5.0)
    tail = F.when(r <= 5.0, near).otherwise(far)
    tail = F.when(q < 0, -tail).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, central).otherwise(tail)


def inv_norm_sql(p: str) -> str:
    """The same AS 241 formula as SQL text (for the DuckDB oracle)."""
    q = f"(({p}) - 0.5)"
    r1 = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    num = lambda cs, v: _poly(cs, v)
    central = f"({q} * ({num(AS241_A, r1)}) / ({num(AS241_B, r1)}))"
    near = f"(({num(AS241_C, f'({r} - 1.6)')}) / ({num(AS241_D, f'({r} - 1.6)')}))"
    far = f"(({num(AS241_E, f'({r} - 5.0)')}) / ({num(AS241_F, f'({r} - 5.0)')}))"
    tail = f"(CASE WHEN {r} <= 5.0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {central} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


#: ranks that one row of tied values expands to at most
TIED_PIECE = 10_000


def qq_points(df: DataFrame, x: str) -> DataFrame:
    """I-th sorted value against Phi^-1((i + 1/2) / n).  Ranks come from the distributed rank
    core over distinct values; tied values expand to their consecutive ranks, in pieces dealt to all tasks, so a
    value that a third of the rows have is no row of that length and no task of its own."""
    base = df.where(is_finite(x)).select(F.col(x).cast("double").alias(x))
    ranked = cumulative(value_counts(base, [], [x]), [], [x])
    piece = F.call_function("div", F.col("cnt") - 1, F.lit(TIED_PIECE))
    pieces = ranked.select(x, "total", "before", "cnt", F.explode(F.sequence(F.lit(0).cast("long"), piece)).alias("piece"))
    first = F.col("before") + F.col("piece") * TIED_PIECE
    last = F.least(first + TIED_PIECE, F.col("before") + F.col("cnt")) - 1
    rows = pieces.repartition(x, "piece").select(x, "total", F.explode(F.sequence(first, last)).alias("i"))
    p = (F.col("i") + 0.5) / F.col("total")
    return rows.select(F.col("i").cast("bigint").alias("i"), F.col(x).alias("value"), inv_norm(p).alias("theoretical"))


def qq_line(df: DataFrame, x: str) -> DataFrame:
    """The reference line through the quartiles: slope and intercept of sample quartile against
    normal quartile."""
    base = df.where(is_finite(x)).select(F.col(x).cast("double").alias(x))
    q = exact_quantiles(base, x, [0.25, 0.75])
    slope = (F.max("q") - F.min("q")) / (inv_norm(F.lit(0.75)) - inv_norm(F.lit(0.25)))
    return q.agg(slope.alias("slope"), ((F.max("q") + F.min("q")) / 2).alias("intercept"))  # the normal is symmetric


# ---------------------------------------------------------------- D09-D12

def scatter_points(df: DataFrame, x: str, y: str, size: str | None = None, seed: int = 42,
                   n: int = 5000, key: Sequence[str] | None = None) -> DataFrame:
    """A uniform priority sample of complete finite rows; bubble area = size / max * 250
    (sizes must be >= 0; the maximum is over all complete rows, not just the sample).  Key columns
    come first."""
    cond = is_finite(x) & is_finite(y)
    if size:
        cond = cond & is_finite(size)
    keys = list(key or [])
    base = df.where(cond).select(*dict.fromkeys([*keys, x, y, *([size] if size else [])]))
    from tessera.operators.sampling import priority_sample
    pts = priority_sample(base, n, seed, keys or base.columns)
    if not size:
        return pts
    mx = base.agg(F.max(size).alias("_m"))
    return pts.crossJoin(mx).select(*base.columns, F.when(F.col("_m") > 0, F.col(size) / F.col("_m") * 250)
                                    .otherwise(0.0).alias("area"))


def grid_counts(df: DataFrame, x: str, y: str, bins: int = 30, dense: bool = True) -> DataFrame:
    """Rectangular 2-D counts on equal-width bins (last bin closed); dense grid with zero
    cells (contour) or occupied cells only (density2d)."""
    base = df.where(is_finite(x) & is_finite(y)).select(F.col(x).cast("double").alias("_x"),
                                                         F.col(y).cast("double").alias("_y"))
    r = base.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"))

    def b(v, lo, hi):
        span = F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)).otherwise(F.lit(1.0))
        start = F.when(F.col(hi) > F.col(lo), F.col(lo)).otherwise(F.col(lo) - 0.5)
        return F.least(F.floor((F.col(v) - start) / span * bins), F.lit(bins - 1)).cast("int")
    counted = base.crossJoin(F.broadcast(r)).groupBy(b("_x", "x0", "x1").alias("bx"), b("_y", "y0", "y1").alias("by")) \
        .agg(F.count(F.lit(1)).alias("count"))
    if not dense:
        return counted
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bx")) \
        .crossJoin(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("by")))
    return spine.join(counted, ["bx", "by"], "left").select("bx", "by", F.coalesce("count", F.lit(0)).alias("count"))


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 30) -> DataFrame:
    """Hexagonal bins on two rectangular lattices of ``gridsize`` x ``int(gridsize / sqrt 3)``
    cells, the second shifted by half a cell both ways.  The range is widened by 1e-9 of itself (a
    constant axis by a tenth of its value); a point goes to the first lattice only where its centre is
    strictly nearer (height counts three times), and halves round to even -- pure column math and one
    ``groupBy``.  Only occupied bins are returned."""
    base = df.where(is_finite(x) & is_finite(y)).select(F.col(x).cast("double").alias("_x"),
                                                         F.col(y).cast("double").alias("_y"))
    r = base.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"))

    def axis(value, low, high, cells):
        lo, hi = F.col(low), F.col(high)
        spread = F.when(lo == 0, F.lit(0.1)).otherwise(F.abs(lo) * 0.1)
        lo, hi = F.when(hi > lo, lo).otherwise(lo - spread), F.when(hi > lo, hi).otherwise(hi + spread)
        pad = (hi - lo) * 1e-9
        start, step = lo - pad, ((hi + pad) - (lo - pad)) / cells
        return (F.col(value) - start) / step, start, step

    u, u0, du = axis("_x", "x0", "x1", gridsize)
    v, v0, dv = axis("_y", "y0", "y1", int(gridsize / math.sqrt(3)))
    at = base.crossJoin(F.broadcast(r)).select(u.alias("u"), v.alias("v"), u0.alias("u0"), du.alias("du"),
                                               v0.alias("v0"), dv.alias("dv"))  # r: one row

    def off(lu, lv):
        return (F.col("u") - lu) * (F.col("u") - lu) + 3 * (F.col("v") - lv) * (F.col("v") - lv)

    even = (F.rint("u"), F.rint("v"))
    odd = (F.floor("u") + 0.5, F.floor("v") + 0.5)
    first = off(*even) < off(*odd)
    cells = at.select(F.when(first, even[0]).otherwise(odd[0]).alias("cu"),
                      F.when(first, even[1]).otherwise(odd[1]).alias("cv"), "u0", "du", "v0", "dv")
    return cells.groupBy("cu", "cv", "u0", "du", "v0", "dv").agg(F.count(F.lit(1)).alias("count")).select(
        (F.col("cu") * F.col("du") + F.col("u0")).alias("center_x"),
        (F.col("cv") * F.col("dv") + F.col("v0")).alias("center_y"), "count")


def text_length_histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Character-length distribution of a text column."""
    lengths = df.where(F.col(column).isNotNull()).select(F.length(column).cast("double").alias("length"))
    return histogram(lengths, ["length"], bins=bins)


def parallel_coordinates(df: DataFrame, columns: Sequence[str], n: int = 500, seed: int = 42,
                         key: Sequence[str] | None = None) -> DataFrame:
    """Up to ``n`` sampled complete rows, each column min-max scaled (constant -> 0), with
    min/max taken over all complete rows."""
    from tessera.operators.sampling import priority_sample
    cond = None
    for c in columns:
        cond = is_finite(c) if cond is None else cond & is_finite(c)
    base = df.where(cond)
    mm = base.agg(*[F.min(c).alias(f"_lo{i}") for i, c in enumerate(columns)],
                  *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(columns)])
    pts = priority_sample(base, n, seed, key or base.columns).crossJoin(mm)
    return pts.select(*(key or []), *[F.coalesce((F.col(c) - F.col(f"_lo{i}")) / F.nullif(F.col(f"_hi{i}") - F.col(f"_lo{i}"),
                                                                         F.lit(0)), F.lit(0.0)).alias(c)
                        for i, c in enumerate(columns)])


# ---------------------------------------------------------------- G23-G32: category and time views

def missing_ranking(df: DataFrame, top: int | None = None) -> DataFrame:
    """Per-column missing count and share, highest first (ties by column), for every column;
    ``top`` keeps the first ones."""
    fields = df.schema.fields
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)])
    long = wide.select("_n", F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"m{i}").alias("missing"))
                                                for i, f in enumerate(fields)])))
    out = long.select("column", F.col("missing").cast("bigint").alias("missing"),
                      (F.col("missing") / F.col("_n")).alias("share")).orderBy(F.col("missing").desc(), "column")
    return out if top is None else out.limit(top)


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """Combinations of missing flags (one character per column) with their row counts, all of
    them; with ``top`` the rarer ones are one ``REST`` row."""
    flags = F.concat_ws("", *[F.when(is_missing(c, df.schema[c].dataType), "1").otherwise("0")
                              for c in (columns or df.columns)])
    counts = df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("count"))
    if top is None:
        return counts
    head = counts.orderBy(F.col("count").desc(), "pattern").limit(top)
    return head.unionByName(_rest_of(counts, head, "pattern"))


def _rest_of(counts: DataFrame, head: DataFrame, column: str) -> DataFrame:
    """The rows of ``counts`` outside ``head`` (a top-n list, broadcast) added up as one ``REST`` row."""
    return counts.join(F.broadcast(head.select(column)), column, "left_anti").agg(
        F.sum("count").cast("bigint").alias("count")).where("count is not null").select(F.lit(REST).alias(column), "count")


def contingency(df: DataFrame, x: str, y: str, k: int | None = None, normalize: str | None = None) -> DataFrame:
    """Row counts of all category pairs that occur; with ``k`` the categories past the
    k most frequent of each side are counted under ``REST``.  ``normalize``: 'row' = share within x
    (stacked bar), 'group' = share within y (grouped bar), from grouped sums."""
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()) \
        .select(F.col(x).cast("string").alias(x), F.col(y).cast("string").alias(y))
    cells = _label_rest(_label_rest(base, x, k), y, k).groupBy(x, y).agg(F.count(F.lit(1)).alias("count"))
    if normalize is None:
        return cells
    side = {"row": x, "group": y}[normalize]
    total = cells.groupBy(side).agg(F.sum("count").alias("_t"))
    return cells.join(total, side).select(x, y, "count", (F.col("count") / F.col("_t")).alias("share"))


def category_counts(df: DataFrame, x: str, top: int | None = None, remaining: bool = False) -> DataFrame:
    """Categories ranked by count (ties by text).  Without ``top`` every category, ranked by the
    distributed rank core; with it the first ``top`` (kept per task, then merged), and with
    ``remaining`` (pie/donut) one ``REST`` row with the others."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("string").alias(x)) \
        .agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col(x)]
    if top is None:
        ranked = cumulative(counts.withColumn("_one", F.lit(1)), [], order, weight="_one")
        return ranked.select((F.col("before") + 1).alias("rank"), x, "count")
    head = counts.orderBy(*order).limit(top)
    ranked = head.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), x, "count")  # top rows
    if not remaining:
        return ranked
    rest = _rest_of(counts, head, x).select(F.lit(top + 1).cast("bigint").alias("rank"), x, "count")
    return ranked.unionByName(rest)


def line_values(df: DataFrame, x: str, y: str, agg: str = "mean") -> DataFrame:
    """Y aggregated at each distinct x (mean, median, sum, min, max)."""
    base = df.where(F.col(x).isNotNull() & is_finite(y)).select(x, F.col(y).cast("double").alias(y))
    if agg == "median":
        return exact_quantiles(base, y, [0.5], [x]).select(x, F.col("q").alias(y))
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg]
    return base.groupBy(x).agg(fn(y).alias(y))


UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year", "H": "hour"}
STEPS = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTHS",
         "Y": "INTERVAL 1 YEAR", "H": "INTERVAL 1 HOUR"}


def _period(c: Column, frequency: str) -> Column:
    return F.date_trunc(UNITS[frequency], c).cast("timestamp_ntz")


def period_aggregate(df: DataFrame, ts: str, y: str | None = None, frequency: str = "D",
                     agg: str = "count") -> DataFrame:
    """One row per period from the first to the last observed period, labelled by the
    period **start** (weeks start Monday).  Counts are 0 and other aggregates NULL in periods
    without observations.  The spine is ``sequence(min, max, step)``: its length is the number
    of periods (time span / period), not the row count."""
    base = df.where(F.col(ts).isNotNull())
    p = _period(F.col(ts), frequency).alias("period")
    if agg == "count":
        vals = base.groupBy(p).agg(F.count(F.lit(1)).alias("value"))
    elif agg == "median":
        b = base.where(is_finite(y)).select(p, F.col(y).cast("double").alias("v"))
        vals = exact_quantiles(b, "v", [0.5], ["period"]).select("period", F.col("q").alias("value"))
    else:
        fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg]
        vals = base.where(is_finite(y)).groupBy(p).agg(fn(F.col(y).cast("double")).alias("value"))
    bounds = base.agg(F.min(p).alias("a"), F.max(p).alias("b"))
    spine = bounds.select(F.explode(F.expr(f"sequence(a, b, {STEPS[frequency]})")).alias("period"))
    out = spine.join(vals, "period", "left")
    if agg == "count":
        out = out.withColumn("value", F.coalesce("value", F.lit(0)).cast("bigint"))
    return out.select(F.col("period").cast("timestamp_ntz").alias("period"), "value")


# ---------------------------------------------------------------- G25, D06, D16

def missing_matrix(df: DataFrame, columns: Sequence[str], n: int = 1000, seed: int = 42,
                   key: Sequence[str] | None = None) -> DataFrame:
    """Null-mask of up to ``n`` priority-sampled rows (1 = missing)."""
    from tessera.operators.sampling import priority_sample
    s = priority_sample(df, n, seed, key)
    return s.select(*(key or []), *[is_missing(c, df.schema[c].dataType).cast("int").alias(c) for c in columns])


def strip_points(df: DataFrame, x: str, group: str, n: int = 400, seed: int = 42,
                 key: Sequence[str] | None = None, max_groups: int | None = None) -> DataFrame:
    """Up to ``n`` sampled finite points per group (raincloud / strip); pair with
    ``box_stats`` for the summary glyph."""
    from tessera.operators.sampling import per_group_sample
    cond = is_finite(x) & ~is_missing(group, df.schema[group].dataType)
    base = _label_rest(df.where(cond).select(*(key or []), group, x), group, max_groups)
    return per_group_sample(base, group, n, seed, key)


def summary_plan(overview: list[dict], strongest_pairs: list[tuple[str, str]]) -> list[dict]:
    """Which distribution operators to compute for a profile: a missing-value view when
    anything is missing, the strongest pairs by role, then one view per column by role."""
    plan = []
    if any(r["num_missing"] for r in overview):
        plan.append({"operator": "G23", "args": {}})
        plan.append({"operator": "G25", "args": {"columns": [r["column"] for r in overview if r["num_missing"]]}})
    roles = {r["column"]: r["role"] for r in overview}
    for a, b in strongest_pairs:
        kind = "D09" if roles[a] == roles[b] == "numeric" else "G26" if roles[a] == roles[b] == "category" else "D04"
        if kind == "D04":  # values of the numeric side by the categories of the other
            x, group = (a, b) if roles[a] == "numeric" else (b, a)
            plan.append({"operator": kind, "args": {"x": x, "group": group}})
        else:
            plan.append({"operator": kind, "args": {"x": a, "y": b}})
    for r in overview:
        op = {"numeric": "D01", "category": "G29", "text": "D12", "datetime": "G32"}.get(r["role"])
        if op and not r["all_missing"]:
            plan.append({"operator": op, "args": {"x": r["column"]}})
    return plan


def pair_matrix(df: DataFrame, columns: Sequence[str], bins: int = 20, n: int = 2000, seed: int = 42,
                key: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A pair matrix (and, for two columns, joint + marginals): equal-width histograms of
    every column for the diagonal, all from one scan, and one shared priority sample of the
    columns for every off-diagonal panel."""
    from tessera.operators.profile import histogram
    from tessera.operators.sampling import priority_sample
    cols = list(columns)
    diagonal = histogram(df, cols, bins=bins)
    shared = priority_sample(df.select(*(key or []), *cols), n, seed, key)
    return diagonal, shared
