"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions only.

Leaves are runs of up to four words of one paragraph (a line) with the white space before them, so they cover the text
exactly; a paragraph's node hashes its leaves, a section's the nodes of eight paragraphs, the root all sections.
Equal roots mean equal texts; where roots differ, the sections and then the paragraphs that differ locate the edit,
and the share of common leaves tells how alike two texts are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

LEAF = r"\s*+\S++(?:\s++\S++){0,3}+|\s++"
SECTION = 8
SLICE_ROWS = 5_000
MOST_SLICES = 10_000
#: bytes of the texts after the slices that are broadcast; beyond, they are joined by shuffle
BROADCAST_BYTES = 8 << 20


def leaves(text: Column) -> Column:
    """Hashes of the leaves, an array for each paragraph."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda leaf: F.xxhash64(leaf)))


def paragraphs(tree: Column) -> Column:
    return F.transform(tree, lambda p: F.xxhash64(p))


def sections(nodes: Column, size: int = SECTION) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / size).cast("int")),
                       lambda i: F.xxhash64(F.slice(nodes, i * size + 1, F.lit(size))))


def root(section_nodes: Column) -> Column:
    return F.sha2(F.array_join(F.transform(section_nodes, lambda x: F.hex(x)), "."), 256)


def first_difference(a: Column, b: Column) -> Column:
    """Index of the first node in which two lists differ; null if they are equal."""
    at = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    return F.array_min(F.transform(at, lambda i: F.when(~F.get(a, i).eqNullSafe(F.get(b, i)), i)))


def likeness(a: Column, b: Column) -> Column:
    """Share of common leaves (distinct ones); 1 for equal texts."""
    x, y = F.array_distinct(F.flatten(a)), F.array_distinct(F.flatten(b))
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(a == b, F.lit(1.0)).when(union == 0, F.lit(0.0)).otherwise(both / union)


def slice_of(c: Column, starts: list[int]) -> Column:
    """Number of the last of the ascending ``starts`` that is not above ``c`` (compared as integers: a double
    would round ids beyond 2^53); the starts are looked up in groups, so a row takes twice the root of their number."""
    step = max(1, math.isqrt(len(starts)))
    groups = [np.array(starts[i:i + step], np.int64) for i in range(0, len(starts), step)]
    heads = F.lit(np.array([g[0] for g in groups], np.int64))
    at = F.greatest(F.size(F.filter(heads, lambda s: s <= c)), F.lit(1)) - 1
    group = F.get(F.array(*(F.lit(g) for g in groups)), at)
    return at * step + F.greatest(F.size(F.filter(group, lambda s: s <= c)), F.lit(1)) - 1


def with_next(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, text (null: empty), next_text: that of the next row by doc_id; after the last, the first.

    Rows are dealt to slices between quantiles of doc_id that are ids themselves, hence the row after a slice is
    known and only its text is joined: one shuffle of the texts and no global sort.  Rows with one
    id follow each other by text; a null id has no next (empty)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stats = docs.agg(F.min("doc_id").alias("low"), F.count("doc_id").alias("n")).first()
    slices = max(1, min(MOST_SLICES, stats["n"] // slice_rows))
    if stats["n"] == 0:
        return docs.withColumn("next_text", F.lit(""))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / slices for i in range(1, slices)] or [0.5], 20_000).alias("q")).first()["q"]
    rough = sorted({stats["low"], *cuts})  # approximate, rounded to doubles: the ids that open their slices are exact
    opened = docs.where("doc_id is not null").groupBy(slice_of(F.col("doc_id"), rough).alias("s")).agg(F.min("doc_id").alias("first"))
    starts = sorted(r["first"] for r in opened.collect())  # at most MOST_SLICES
    firsts = docs.sparkSession.createDataFrame([(i, s) for i, s in enumerate(starts)], "after int, doc_id long")
    after = cut_lineage(docs.join(F.broadcast(firsts), "doc_id").groupBy("after").agg(F.min("text").alias("after_text"))
                        .withColumn("slice", F.pmod(F.col("after") - 1, F.lit(len(starts)))).drop("after"))
    if (after.agg(F.sum(F.octet_length("after_text"))).first()[0] or 0) <= BROADCAST_BYTES:
        after = F.broadcast(after)
    dealt = docs.withColumn("slice", F.when(F.col("doc_id").isNotNull(), slice_of(F.col("doc_id"), starts)).otherwise(-1))
    own = Window.partitionBy("slice").orderBy("doc_id", "text")
    nulls = dealt.where("slice = -1").select("doc_id", "text", F.lit("").alias("next_text"))
    rows = dealt.where("slice >= 0").repartitionByRange(len(starts), "slice").withColumn("inner", F.lead("text").over(own))
    last = rows.join(after, "slice", "left")
    return last.select("doc_id", "text", F.coalesce("inner", "after_text").alias("next_text")).unionByName(nulls)


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edit_section and edit_paragraph (first node that the edit changes; null if none does).

    The edited text has the last quarter of the code points (rounded down) replaced by the first as many (or all) of the
    next document.  Null texts read as empty; empty texts have equal fingerprints; other columns are ignored."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    # string functions count bytes of UTF-8 only where they must: both cuts are by code points
    edited = F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
                                  leaves(F.col("text")).alias("t"), leaves(edited).alias("e"),
                                  leaves(F.col("next_text")).alias("x"))
    rows = rows.withColumns({"tp": paragraphs(F.col("t")), "ep": paragraphs(F.col("e")),
                             "near_edited": likeness(F.col("t"), F.col("e")), "near_next": likeness(F.col("t"), F.col("x"))}
                            ).drop("t", "e", "x")
    rows = rows.withColumns({"ts": sections(F.col("tp")), "es": sections(F.col("ep"))})
    return rows.select("doc_id", "n_chars", "edited_sha256", root(F.col("ts")).alias("fingerprint"),
                       root(F.col("es")).alias("edited_fingerprint"), "near_edited", "near_next",
                       first_difference(F.col("ts"), F.col("es")).alias("edit_section"),
                       first_difference(F.col("tp"), F.col("ep")).alias("edit_paragraph"))
