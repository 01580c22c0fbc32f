"""Stored assignments (Y05): what a transductive model said about the rows it was fitted on.

A method without a rule for new rows (DBSCAN, agglomerative clustering, t-SNE) can still be asked about its own rows.  Its
assignments are stored as a table bucketed and sorted by row key, with the content digest of the source they were made
from.  A lookup sorts and shuffles the asked rows alone: the stored side is read bucket by bucket as it lies.  When the
source has changed since, opening is refused, as the answers would be about other rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import fingerprint, write_text_file

BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 16_384
SIDECAR = "assignments.json"
ASSIGNED, UNKNOWN = "assigned", "unknown_row"


class SourceChanged(ValueError):
    """The source of stored assignments is not the one they were made from."""


@dataclass(frozen=True)
class Assignments:
    """Stored assignments: ``table`` is bucketed by ``key`` into ``buckets``; ``about`` is what the caller noted."""

    table: str
    key: str
    buckets: int
    digest: str
    about: dict

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the stored columns and ``status`` (assigned, or unknown_row for keys that were not fitted).

        The rows may repeat keys; a null key is unknown.  Columns of ``rows`` that the stored table has too (but for
        the key) are an error."""
        stored = self.rows(rows.sparkSession)
        clash = sorted(set(rows.columns) & ({*stored.columns, "status"} - {self.key}))
        if clash:
            raise ValueError(f"{clash} would be there twice")
        found = stored.withColumn("status", F.lit(ASSIGNED))
        return rows.join(found.hint("merge"), self.key, "left").withColumn("status", F.coalesce("status", F.lit(UNKNOWN)))

    def row(self, spark: SparkSession, value) -> dict | None:
        """The stored columns of one row, or None; reads the one bucket that can hold it."""
        found = self.rows(spark).where(F.col(self.key) == F.lit(value)).limit(1).collect()
        return found[0].asDict() if found else None


def _buckets(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def store_assignments(assigned: DataFrame, key: str, source: DataFrame, path: str, about: dict | None = None,
                      buckets: int | None = None) -> Assignments:
    """Store ``assigned`` (a row per row of ``source``, named by ``key``) in the new folder ``path``.

    ``source`` is what the model was fitted on; its content digest is kept beside the rows.  Null and repeated keys are an
    error, and so is a number of rows other than the source's."""
    spark = assigned.sparkSession
    counted = assigned.groupBy(F.col(key).alias("k")).count().agg(
        F.sum("count").alias("rows"), F.count_if(F.col("count") > 1).alias("repeated"), F.count_if(F.col("k").isNull()).alias("null")).first()
    print_of = fingerprint(source)
    rows = int(counted["rows"] or 0)
    if counted["repeated"] or counted["null"]:
        raise ValueError(f"{counted['repeated']} keys repeat and {counted['null']} are null: rows cannot be told apart")
    if rows != print_of["rows"]:
        raise ValueError(f"{rows} assignments for {print_of['rows']} rows")
    n = buckets or _buckets(rows)
    made = Assignments(f"assignments_{uuid.uuid4().hex}", key, n, print_of["digest"], about or {})
    assigned.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option(
        "path", path.rstrip("/") + "/rows").saveAsTable(made.table)
    noted = {"key": key, "buckets": n, "digest": made.digest, "about": made.about, "schema": _ddl(assigned)}
    write_text_file(spark, path.rstrip("/") + "/" + SIDECAR, json.dumps(noted))
    return made


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def open_assignments(spark: SparkSession, path: str, source: DataFrame | None = None) -> Assignments:
    """The assignments stored in ``path``, known to this session; with ``source``, only if its content is that they were made from."""
    path = path.rstrip("/")
    noted = json.loads(spark.read.text(f"{path}/{SIDECAR}", wholetext=True).first()[0])
    if source is not None:
        own = fingerprint(source)["digest"]
        if own != noted["digest"]:
            raise SourceChanged(f"the source is {own}, the assignments in {path} were made from {noted['digest']}")
    name = f"assignments_{uuid.uuid4().hex}"
    key = noted["key"]
    spark.sql(f"CREATE TABLE {name} ({noted['schema']}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {noted['buckets']} BUCKETS LOCATION '{path}/rows'")
    return Assignments(name, key, noted["buckets"], noted["digest"], noted["about"])


def forget(spark: SparkSession, stored: Sequence[Assignments]) -> None:
    """Drop the session's names of stored assignments; the files stay."""
    for one in stored:
        spark.sql(f"DROP TABLE IF EXISTS {one.table}")
