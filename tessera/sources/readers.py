"""Sources and sinks.

Opening a dataset reads nothing but metadata; every reader returns a lazy ``DataFrame``.
Multiple files must share the same *set* of column names (order free) and are combined with
``unionByName``; ``dtype`` overrides become casts in the plan.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.census import Group, groups_of, json_names, separator_of, united

SUPPORTED = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".json": "json",
             ".jsonl": "json", ".ndjson": "json", ".orc": "orc"}


def _hadoop_path(spark, path: str):
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jp.getFileSystem(spark._jsc.hadoopConfiguration()), jp


def list_names(spark, base: str) -> list[str]:
    """Entry names directly under ``base`` on any Hadoop-supported storage ([] when absent)."""
    fs, p = _hadoop_path(spark, base)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p)]


def write_text_file(spark, path: str, text: str) -> None:
    """Create one small text file (a sidecar) on any Hadoop-supported storage; never overwrites."""
    fs, p = _hadoop_path(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def resolve_paths(spark: SparkSession, source: str | Sequence[str]) -> list[str]:
    """A file, a folder (its top-level supported files, sorted), a glob, or a list -- listed
    through the session's Hadoop FileSystem, so shared cluster storage works like a local disk."""
    if isinstance(source, (list, tuple)):
        out = []
        for s in source:
            out.extend(resolve_paths(spark, s))
        return out
    fs, p = _hadoop_path(spark, source)
    if any(ch in source for ch in "*?["):
        found = fs.globStatus(p) or []
        files = sorted(st.getPath().toString() for st in found)
        if not files:
            raise ValueError(f"No files match {source}")
        return files
    if not fs.exists(p):
        raise FileNotFoundError(source)
    if fs.getFileStatus(p).isDirectory():
        files = [source.rstrip("/") + "/" + f for f in sorted(list_names(spark, source))
                 if os.path.splitext(f)[1].lower() in SUPPORTED and not f.startswith((".", "_"))]
        if not files:
            raise ValueError(f"No supported files in {source}")
        return files
    return [source]


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator of one file (``census.separator_of`` its first line; ``limit(1)`` touches one split)."""
    first = spark.read.text(path).limit(1).collect()
    return separator_of(path, first[0][0] if first else "")


def _type(name) -> T.DataType:
    return name if isinstance(name, T.DataType) else T.DataType.fromDDL(name)


def _read_group(spark: SparkSession, group: Group, schema: T.StructType | None, csv_options: dict,
                multiline_json: bool, dtype: dict | None = None) -> DataFrame:
    """One scan of all files of a group."""
    reader = spark.read
    if group.kind == "json":
        reader = reader if schema is None else reader.schema(schema)
        return reader.option("multiLine", multiline_json).json(group.paths)
    if group.kind != "csv":
        return (reader if schema is None else reader.schema(schema)).format(group.kind).load(group.paths)
    opts = {"header": True, "sep": group.sep or sniff_separator(spark, group.paths[0]), **(csv_options or {})}
    if schema is not None:
        return reader.options(**opts).schema(schema).csv(group.paths)
    if group.names and dtype and set(group.names) <= set(dtype):
        inferred = T.StructType([T.StructField(n, _type(dtype[n])) for n in group.names])
    else:
        inferred = reader.options(**{"inferSchema": True, **opts}).csv(group.paths).schema
    # declared types go into the read: text as written ('001'), not what inference made of it
    declared = T.StructType([T.StructField(f.name, _type(dtype[f.name])) if f.name in (dtype or {}) else f for f in inferred])
    return spark.read.options(**{**opts, "inferSchema": False}).schema(declared).csv(group.paths)


def open_dataset(spark: SparkSession, source, fmt: str | None = None, dtype: dict | None = None,
                 csv_options: dict | None = None, schema: T.StructType | None = None,
                 multiline_json: bool = False) -> DataFrame:
    """Lazy frame over one or more files with a checked common column set.

    A census reads the schemas of all files in one job; files of one schema are one scan, and types that differ are
    joined (``census.joined_schema``).  Columns stand in the first file's order."""
    paths = resolve_paths(spark, source)
    kinds = []
    for p in paths:
        kind = fmt or SUPPORTED.get(os.path.splitext(p)[1].lower())
        if kind is None:
            raise ValueError(f"Unsupported file type: {p}")
        kinds.append((p, kind))
    if len(paths) == 1:
        groups = [Group(kinds[0][1], None, (), paths)]
    else:
        groups = groups_of(spark, kinds, csv_options or {}, multiline_json)
    for g in groups:
        if g.kind == "json" and len(g.paths) > 1 and schema is None:
            by_file = json_names(spark, g.paths, multiline_json)
            for p, names in by_file.items():
                if names != (first := next(iter(by_file.values()))):
                    raise ValueError(f"{p}: column names differ, {sorted(set(names) ^ set(first))}")
    frames = [(_read_group(spark, g, schema, csv_options or {}, multiline_json, dtype), g.paths[0]) for g in groups]
    return apply_dtypes(united(frames, list(dtype or {})), dtype or {})  # U01: union by name


def check_columns(df: DataFrame) -> None:
    """Column names: unique, nonempty strings; also unique ignoring case (Spark resolves
    names case-insensitively)."""
    cols = df.columns
    if any(not c for c in cols) or len(set(cols)) != len(cols) or len({c.lower() for c in cols}) != len(cols):
        raise ValueError("Column names must be unique nonempty strings (ignoring case)")


def apply_dtypes(df: DataFrame, dtype: dict) -> DataFrame:
    """Per-column type overrides as casts; CSV files were already read with them, so texts keep
    their leading zeros."""
    unknown = set(dtype) - set(df.columns)
    if unknown:
        raise ValueError(f"Unknown dtype columns: {sorted(unknown)}")
    return df.withColumns({c: F.col(c).cast(t) for c, t in dtype.items()}) if dtype else df


def select_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Column pruning with checks (unknown, duplicate, empty selection rejected)."""
    if columns is None:
        return df
    columns = list(columns)
    if not columns or len(set(columns)) != len(columns):
        raise ValueError("Column selection must be nonempty and unique")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Unknown columns {missing}")
    return df.select(*columns)


def schema_report(df: DataFrame) -> list[tuple[str, str]]:
    """(column, type) without scanning data."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def require_rows(df: DataFrame, max_rows: int | None = None) -> None:
    """Reject an empty input, or one over ``max_rows`` (counts at most max_rows + 1)."""
    if df.limit(1).count() == 0:
        raise ValueError("Dataset is empty")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"Dataset exceeds {max_rows} rows")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """One write in ``errorifexists`` mode, then the row count of what landed, answered from
    the Parquet footers (row-group metadata; no data pages are read).

    ``DataFrame.observe`` is not used: once an ``Observation`` is registered, Spark 4.1 keeps a
    non-serializable ObservationManager on the session and later jobs that capture it fail."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return int(df.sparkSession.read.parquet(path).count())


def write_unified(spark: SparkSession, source, path: str, **how) -> dict:
    """S09 over many inputs: their types are joined first (footers and headers only), then one scan and one write land them.
    Returns the rows written and the joined schema; ``how`` goes to ``open_dataset``."""
    df = open_dataset(spark, source, **how)
    return {"rows": write_parquet(df, path), "schema": dict(schema_report(df))}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header into a new folder of part files."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def fingerprint(df: DataFrame) -> dict:
    """Order-free content digest: row count, sum of 64-bit row hashes (exact decimal) and
    the schema -- changes when any value, row or type changes, whatever the partitioning."""
    h = F.xxhash64(F.struct(*[F.col(c) for c in df.columns])).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s")).first()
    return {"rows": int(row["n"]), "hash_sum": str(row["s"]), "schema": df.schema.simpleString(),
            "digest": json.dumps([int(row["n"]), str(row["s"]), df.schema.simpleString()])}


def presplit_frames(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Validate a {train, validation?, test?} mapping (same column set, target may be
    absent from test)."""
    if "train" not in frames:
        raise ValueError("A pre-split source needs train")
    unknown = set(frames) - {"train", "validation", "test"}
    if unknown:
        raise ValueError(f"Unknown roles {sorted(unknown)}")
    return frames
