"""Associations between columns.

All pairs of all kinds come from one scan.  Tasks work on blocks of rows as matrices: number pairs are masked cross
products (counts, sums and squares of all pairs at once), category pairs are counted cells and mixed pairs sums by category, so
what leaves a task is a few sums for each pair, and a row is never sent once per pair.  Spark adds the
partial sums by pair (and category, and cell).  Only the contingency cells that occur are formed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import is_finite, is_missing
from tessera.functions.ranking import average_rank
from tessera.session import cut_lineage, ship_package

BLOCK_ROWS = 65_536
#: share of a sum of squares that rounding may leave
TINY = 1e-14


def _pairs_frame(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, x, y): one row per requested pair, so a pair without complete rows is reported too."""
    return df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                                           "pair int, x string, y string")


PARTIAL = "kind string, pair int, a string, b string, n long, x double, y double, xx double, yy double, xy double"


def _sums(batch: pa.RecordBatch, numbers: list[str], texts: list[str], kinds: dict[str, list[tuple[str, str]]],
          shift: dict[str, float]) -> pa.RecordBatch:
    """Partial sums of a block of rows: of number pairs, cells of category pairs, groups of mixed pairs."""
    out = {name: [] for name in ("kind", "pair", "a", "b", "n", "x", "y", "xx", "yy", "xy")}

    def add(kind, pair, a, b, n, *sums):
        size = len(n)
        for name, values in zip(out, (np.full(size, kind, object), pair, a, b, n, *sums), strict=True):
            out[name].append(np.full(size, 0.0) if values is None else np.asarray(values))

    column = lambda c: batch.column(batch.schema.get_field_index(c))
    values = {c: np.asarray(column(f"n_{c}").fill_null(np.nan)) - shift[c] for c in numbers}
    codes = {c: column(f"t_{c}").dictionary_encode(null_encoding="mask") for c in texts}
    names = {c: np.asarray(d.dictionary, object) for c, d in codes.items()}
    codes = {c: np.asarray(d.indices.fill_null(-1)) for c, d in codes.items()}
    if kinds["pearson"]:
        used = sorted({c for pair in kinds["pearson"] for c in pair})
        place = {c: i for i, c in enumerate(used)}
        x = np.stack([values[c] for c in used], axis=1)
        there = np.isfinite(x)
        x = np.where(there, x, 0.0)
        mask, at = there.astype(float), np.array([(place[a], place[b]) for a, b in kinds["pearson"]])
        n, sx, sxx, sxy = mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x
        i, j = at.T
        none = np.full(len(at), None)
        add("pearson", np.arange(len(at)), none, none, n[i, j].astype(np.int64), sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j])
    for p, (a, b) in enumerate(kinds["cramers_v"]):
        ok = (codes[a] >= 0) & (codes[b] >= 0)
        cell, n = np.unique(codes[a][ok].astype(np.int64) * len(names[b]) + codes[b][ok], return_counts=True)
        add("cramers_v", np.full(len(cell), p), names[a][cell // max(len(names[b]), 1)], names[b][cell % max(len(names[b]), 1)], n, *[None] * 5)
    for p, (a, b) in enumerate(kinds["correlation_ratio"]):
        ok = (codes[a] >= 0) & np.isfinite(values[b])
        group, v, size = codes[a][ok], values[b][ok], len(names[a])
        n = np.bincount(group, minlength=size)
        own = np.flatnonzero(n)
        add("correlation_ratio", np.full(len(own), p), names[a][own], np.full(len(own), None), n[own], np.bincount(group, v, size)[own],
            None, np.bincount(group, v * v, size)[own], None, None)
    kinds_of = pa.schema([("kind", pa.string()), ("pair", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64()),
                          *((c, pa.float64()) for c in ("x", "y", "xx", "yy", "xy"))])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], kinds_of.field(c).type) for c, v in out.items()], schema=kinds_of)


def _partials(df: DataFrame, kinds: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Partial sums of all pairs (``PARTIAL``), a written table.  Numbers are taken less the mean of their column: sums of
    squares keep their digits whatever the offset."""
    numbers = sorted({c for pair in kinds["pearson"] for c in pair} | {b for _, b in kinds["correlation_ratio"]})
    texts = sorted({c for pair in kinds["cramers_v"] for c in pair} | {a for a, _ in kinds["correlation_ratio"]})
    if not numbers and not texts:
        return df.sparkSession.createDataFrame([], PARTIAL)
    cells = [F.when(is_finite(c), F.col(c).cast("double")).alias(f"n_{c}") for c in numbers]
    cells += [F.when(~is_missing(c, df.schema[c].dataType), F.col(c).cast("string")).alias(f"t_{c}") for c in texts]
    rows = df.select(*cells)
    shift = {}
    if numbers:
        long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"n_{c}").alias("v")) for c in numbers])))
        shift = {r["c"]: r["m"] or 0.0 for r in long.groupBy("c").agg(F.avg("v").alias("m")).collect()}
        shift = {c: shift.get(c, 0.0) for c in numbers}
    sums = _sums

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield sums(pa.Table.from_batches(held).combine_chunks().to_batches()[0], numbers, texts, kinds, shift)
                held, size = [], 0
        if size:
            yield sums(pa.Table.from_batches(held).combine_chunks().to_batches()[0], numbers, texts, kinds, shift)

    ship_package(df.sparkSession)
    return cut_lineage(rows.mapInArrow(run, PARTIAL))


def _kinds(**given) -> dict[str, list[tuple[str, str]]]:
    return {kind: list(given.get(kind, ())) for kind in ("pearson", "cramers_v", "correlation_ratio")}


def _report(df: DataFrame, pairs: Sequence[tuple[str, str]], method: str, stats: DataFrame) -> DataFrame:
    """One row per pair from ``stats`` (pair, value, rows); a NULL value is 'undefined'."""
    return _pairs_frame(df, pairs).join(F.broadcast(stats), "pair", "left").select(  # one row per pair
        "x", "y", F.lit(method).alias("method"), "value",
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        F.when(F.col("value").isNull(), "undefined").otherwise("ok").alias("status"))


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r over pairwise-complete finite rows; NULL when n < 2 or a side is constant;
    clipped to [-1, 1].  One scan, with partial sums of all pairs in each task."""
    return _pearson(df, pairs, _partials(df, _kinds(pearson=pairs)))


def _pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], partials: DataFrame) -> DataFrame:
    total = partials.where("kind = 'pearson'").groupBy("pair").agg(F.sum("n").alias("rows"), *[
        F.sum(c).alias(c) for c in ("x", "y", "xx", "yy", "xy")])
    n = F.col("rows")
    va, vb, cov = (F.col(f"{a}{b}") - F.col(a) * F.col(b) / n for a, b in (("x", "x"), ("y", "y"), ("x", "y")))
    # what is left of a constant's squares after the subtraction is rounding
    valid = (n >= 2) & (va > TINY * F.col("xx")) & (vb > TINY * F.col("yy"))
    r = F.when(valid, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(va * vb))))
    return _report(df, pairs, "pearson", total.select("pair", r.alias("value"), "rows"))


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Uncorrected Cramér's V on pairwise-complete rows, chi2 = n (sum n_ij^2/(r_i c_j) - 1), for any
    number of levels; NULL when a side has fewer than 2.  Only cells that occur are formed.  The shares
    n_ij/r_i of a level add up to 1, so their sum counts the levels without a distinct aggregate."""
    return _cramers_v(df, pairs, _partials(df, _kinds(cramers_v=pairs)))


def _cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]], partials: DataFrame) -> DataFrame:
    cells = partials.where("kind = 'cramers_v'").groupBy("pair", "a", "b").agg(F.sum("n").alias("nij"))
    by_a = cells.groupBy("pair", "a").agg(F.sum("nij").alias("ri"))
    by_b = cells.groupBy("pair", "b").agg(F.sum("nij").alias("cj"))
    n, nij = F.col("rows"), F.col("nij")
    sums = cells.join(by_a, ["pair", "a"]).join(by_b, ["pair", "b"]).groupBy("pair").agg(
        F.sum((nij / F.col("ri")) * (nij / F.col("cj"))).alias("s"), F.sum("nij").alias("rows"),
        F.round(F.sum(nij / F.col("ri"))).alias("ka"), F.round(F.sum(nij / F.col("cj"))).alias("kb"))
    k = F.least("ka", "kb")
    v = F.when(k >= 2, F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), n * (F.col("s") - 1)) / (n * (k - 1)))))
    return _report(df, pairs, "cramers_v", sums.select("pair", v.alias("value"), "rows"))


def correlation_ratio(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """eta = sqrt(between-group SS / total SS) for (category, numeric) pairs over
    pairwise-complete finite rows; NULL when total SS is 0 or fewer than 2 groups.  Totals come from
    the group sums: the rows are read once."""
    return _correlation_ratio(df, pairs, _partials(df, _kinds(correlation_ratio=pairs)))


def _correlation_ratio(df: DataFrame, pairs: Sequence[tuple[str, str]], partials: DataFrame) -> DataFrame:
    groups = partials.where("kind = 'correlation_ratio'").groupBy("pair", "a").agg(
        F.sum("n").alias("ng"), F.sum("x").alias("sg"), F.sum("xx").alias("qg"))
    within = F.greatest(F.col("qg") - F.col("sg") * F.col("sg") / F.col("ng"), F.lit(0.0))
    sums = groups.groupBy("pair").agg(
        F.sum("ng").alias("rows"), F.count(F.lit(1)).alias("k"), F.sum("sg").alias("s"), F.sum("qg").alias("q"),
        F.sum(F.col("sg") * F.col("sg") / F.col("ng")).alias("b"), F.sum(within).alias("ssw"))
    ssb = F.greatest(F.col("b") - F.col("s") * F.col("s") / F.col("rows"), F.lit(0.0))
    sst = ssb + F.col("ssw")
    eta = F.when((sst > TINY * F.col("q")) & (F.col("k") >= 2), F.sqrt(F.least(F.lit(1.0), ssb / sst)))
    return _report(df, pairs, "correlation_ratio", sums.select("pair", eta.alias("value"), "rows"))


def spearman(df: DataFrame, x: str, y: str, partitions: int | None = None) -> DataFrame:
    """Average ranks (ties averaged) computed **after** pairwise deletion, then Pearson.

    Ranks come from the distributed rank core over distinct values and join back by value."""
    both = df.where(is_finite(x) & is_finite(y)).select(F.col(x).cast("double").alias("_x"),
                                                         F.col(y).cast("double").alias("_y"))
    rx = average_rank(both, "_x", partitions=partitions).select("_x", F.col("rank").alias("_rx"))
    ry = average_rank(both, "_y", partitions=partitions).select("_y", F.col("rank").alias("_ry"))
    ranked = both.join(rx, "_x").join(ry, "_y")
    return pearson(ranked, [("_rx", "_ry")]).select(
        F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit("spearman").alias("method"), "value", "rows", "status")


def least_squares(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of the least-squares line over finite complete rows."""
    ok = is_finite(x) & is_finite(y)
    xs, ys = F.when(ok, F.col(x).cast("double")), F.when(ok, F.col(y).cast("double"))
    return df.agg(F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"),
                  F.regr_count(ys, xs).alias("rows"))


METHODS = {("numeric", "numeric"): pearson, ("category", "category"): cramers_v,
           ("category", "numeric"): correlation_ratio}


def role_pairs(roles: dict[str, str], columns: Sequence[str]) -> dict[tuple[str, str], list[tuple[str, str]]]:
    """Every pair of numeric and category columns, by the roles of its sides (category first)."""
    found: dict = {kinds: [] for kinds in METHODS}
    for x, y in combinations(columns, 2):
        kinds = (roles.get(x), roles.get(y))
        if kinds in found:
            found[kinds].append((x, y))
        elif kinds[::-1] in found:
            found[kinds[::-1]].append((y, x))
    return found


def association_table(df: DataFrame, roles: dict[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per pair of ``columns`` (default: all): Pearson (numeric x numeric), Cramér's V
    (category x category), correlation ratio (category x numeric).  No pair is left out."""
    found = role_pairs(roles, columns or df.columns)
    named = {METHODS[kinds].__name__: pairs for kinds, pairs in found.items()}
    partials = _partials(df, _kinds(**named))  # one scan for pairs of all kinds
    finish = {"pearson": _pearson, "cramers_v": _cramers_v, "correlation_ratio": _correlation_ratio}
    return reduce(DataFrame.unionByName, [finish[kind](df, pairs, partials) for kind, pairs in named.items()])


def strongest(assoc: DataFrame, k: int = 3) -> DataFrame:
    """Strongest ``k`` pairs by |value| (ties by x, y)."""
    return assoc.where(F.col("value").isNotNull()) \
        .orderBy(F.abs("value").desc(), F.col("x"), F.col("y")).limit(k)
