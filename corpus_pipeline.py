"""Corpus pipeline: quality classifier, MinHash near-dedup, substring dedup, personal data, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame that is
written as Parquet and reread as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import neardup, packing, pii, quality, substring
from tessera.llm.queries import quality_model
from tessera.llm.text import checked_broadcast, row_key, ship, unused
from tessera.operators.sampling import row_number_by
from tessera.session import checkpoint_dir, cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts (score of 0.7 or more)."""
    ship(spark)
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    key = unused(docs, "key")
    keyed = docs.withColumn(key, row_key())
    scored = quality.score(keyed.select(F.col(key).alias("doc_id"), "text"), model, 0.7)
    bad = cut_lineage(scored.where("predicted = 0").select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(checked_broadcast(bad), key, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id (one of rows equal in id and text).
    Rows that share a doc_id, but not a text, are different documents; rows without doc_id stay."""
    ship(spark)
    key, number = unused(docs, "key"), unused(docs, "number")
    keyed = docs.withColumn(key, row_key())
    named = keyed.where("doc_id is not null")
    texts = cut_lineage(named.groupBy("doc_id").agg(
        F.min(key).alias("least"), F.max(key).alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    if texts.where("least <> most").isEmpty():
        keyed = keyed.withColumn(number, F.col("doc_id"))
    else:  # ids of their own for different rows, in the order of doc_id
        ranked = cut_lineage(row_number_by(named.select("doc_id", F.col(key).alias("row")).distinct(), ["doc_id", "row"], "number"))
        keyed = keyed.join(ranked.select(F.col("row").alias(key), F.col("number").alias(number)), key, "left")
    groups = neardup.near_duplicates(keyed.select(F.col(number).alias("doc_id"), "text"))
    gone = cut_lineage(groups.where("not kept").select(F.col("doc_id").alias(number)).distinct())
    kept = keyed.join(checked_broadcast(gone), number, "left_anti")
    if texts.isEmpty():
        return kept.select(*docs.columns)
    twice = checked_broadcast(texts.select("doc_id"))
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(
        kept.join(twice, "doc_id", "left_semi").dropDuplicates([key]).select(*docs.columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that lie in repeated windows of 35 words."""
    ship(spark)
    key, kept = unused(docs, "key"), unused(docs, "kept")
    keyed = docs.withColumn(key, row_key())
    cut = substring.deduplicate(keyed.select(F.col(key).alias("doc_id"), "text"))
    cut = cut_lineage(cut.where("n_removed > 0").select(F.col("doc_id").alias(key), F.col("kept_text").alias(kept)).dropDuplicates([key]))
    return _with_text(keyed.join(cut, key, "left").withColumn("text", F.coalesce(kept, "text")), docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    ship(spark)
    return _with_text(pii.mask(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        docs = docs.withColumn("n_chars", F.char_length("text").cast(kind))
    return docs.select(*columns)


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: models and token ids are not SQL; tests/llm/ holds each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and reread in the shared checkpoint folder."""
    top = checkpoint_dir(spark).rstrip("/") + "/pipeline/" + uuid.uuid4().hex
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
    return docs
