"""Distributed dictionaries: categories (E04) and target classes (E07) of any number, numbered and met by joins.

Tokens are numbered in sorted order by the rank core, so the numbers are those a sorted list would give; the dictionary is
a written table and nothing of it reaches the driver.  A frame meets it by token: its (row, column, token) triples join the
dictionary, the slots of a row come together by row, and sparse vectors are assembled from them.  A token that a third of all
rows have is one dictionary row against many, which AQE splits.  Columns of few tokens stay out of it: their dictionaries go to
the rows, which are not sorted for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.ranking import cumulative
from tessera.session import cut_lineage


#: tokens of a column whose dictionary goes to the rows, and how many such columns do
FEW = 1_000
NARROW = 16


def numbered(tokens: DataFrame, keys: Sequence[str], token: str, name: str) -> DataFrame:
    """Distinct (keys, token) with ``name``, the token's place from 0 in sorted order within its keys; a written table."""
    one = tokens.select(*keys, token).where(F.col(token).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    return cut_lineage(cumulative(one, keys, [token], weight="_one", before=name).select(*keys, token, name))


class TokenSlots:
    """One-hot slots of categorical columns: ``table`` (column, token, slot), ``sizes`` (tokens by column) and the first slot."""

    def __init__(self, tokens: DataFrame, columns: Sequence[str], first: int):
        self.columns, self.first = list(columns), first
        found = numbered(tokens, ["column"], "token", "place")
        self.sizes = dict.fromkeys(self.columns, 0) | {r["column"]: r["n"] for r in found.groupBy("column").agg(
            F.count(F.lit(1)).alias("n")).collect()}  # a row per column
        start, offset = first, F.lit(None)
        for c in self.columns:
            offset = F.when(F.col("column") == c, F.lit(start)).otherwise(offset)
            start += self.sizes[c]
        self.width = start
        if self.width >= 2**31:
            raise ValueError(f"{self.width} slots: a vector has fewer than 2^31")
        self.table = cut_lineage(found.select("column", "token", (offset + F.col("place")).cast("int").alias("slot")))

    def of(self, rows: DataFrame, row: str, token_of: dict[str, str]) -> DataFrame:
        """row and slots (sorted array) of the rows that have any known token; ``token_of``: the token column of each column."""
        triples = rows.select(row, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(t).alias("token"))
                                                      for c, t in token_of.items()])))
        met = triples.join(self.table, ["column", "token"])
        return met.groupBy(row).agg(F.sort_array(F.collect_list("slot")).alias("slots"))  # one for each column at most


def with_slots(df: DataFrame, slots: TokenSlots, token_of: dict[str, str]) -> DataFrame:
    """``df`` with ``slots`` (array of int), an empty array for rows without a known token.  Rows are numbered in a written
    copy, as they need no key of their own."""
    name = "_row"
    while name in df.columns:
        name += "_"
    rows = cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))
    none = F.array().cast("array<int>")
    few = [c for c in token_of if slots.sizes.get(c, 0) <= FEW][:NARROW]
    many = {c: t for c, t in token_of.items() if c not in few}
    out, own = rows, []
    if many:
        out = rows.join(slots.of(rows, name, many), name, "left").withColumn("slots", F.coalesce("slots", none))
    else:
        out = rows.withColumn("slots", none)
    for i, c in enumerate(few):
        own.append(f"{name}{i}")
        tokens = slots.table.where(F.col("column") == c).select(F.col("token").alias(f"{name}t"), F.col("slot").alias(own[-1]))
        out = out.join(F.broadcast(tokens), F.col(token_of[c]) == F.col(f"{name}t"), "left").drop(f"{name}t")
    if own:
        met = F.filter(F.array(*[F.col(c) for c in own]), lambda s: s.isNotNull())
        out = out.withColumn("slots", F.sort_array(F.concat("slots", met)))
    return out.drop(name, *own)


def sparse_vectors(df: DataFrame, numbers: Sequence[str], width: int, output: str) -> DataFrame:
    """``df`` (with ``slots``) with the vector column ``output``: ``numbers`` first, then ones in the slots.

    A vector column is a struct with a type of its own: the struct is written and read again as vectors."""
    first = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(numbers)]) if numbers else \
        F.array().cast("array<struct<i:int,v:double>>")
    ones = F.transform("slots", lambda s: F.struct(s.alias("i"), F.lit(1.0).alias("v")))
    entries = F.concat(F.filter(first, lambda e: e["v"] != 0), ones)
    made = df.withColumn(output, F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(width).alias("size"), F.transform(entries, lambda e: e["i"]).alias("indices"),
        F.transform(entries, lambda e: e["v"]).alias("values"))).drop("slots")
    written = cut_lineage(made)
    schema = T.StructType([T.StructField(f.name, VectorUDT()) if f.name == output else f for f in written.schema])
    vectors = df.sparkSession.read.schema(schema).parquet(written._written_path)
    vectors._written_path = written._written_path
    return vectors


def class_table(df: DataFrame, key, name: str = "label") -> DataFrame:
    """class_key and ``name``: every class (``key``: a text column expression) with its place in sorted order, as a double."""
    found = numbered(df.select(key.alias("class_key")), [], "class_key", "place")
    return found.select("class_key", F.col("place").cast("double").alias(name))
