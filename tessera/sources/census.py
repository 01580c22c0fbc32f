"""Schema census of many files (S01, S06, S09): what each file holds, in one job, and one scan for each distinct schema.

Tasks read Parquet and ORC footers and the header lines of CSV files; the driver gets one short row per file.  Files of one
schema are one scan, whatever their number, and scans are united by name after their types are joined in the permissive
lattice: nulls go with anything, integers widen, integers and floats (or decimals) meet in the wider kind, temporal units in the
finer one; text and numbers do not meet and are an error that names the column and a file of each kind.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

MOST_TASKS = 256
HEADER_BYTES = 1 << 20
SEPARATORS = (",", "\t", ";", "|")


@dataclass
class Group:
    """Files that one scan reads: their kind, separator (CSV), names as far as they are known, and paths."""

    kind: str
    sep: str | None
    names: tuple[str, ...]
    paths: list[str]


def separator_of(path: str, line: str) -> str:
    """S02: ',' for .csv, tab for .tsv, otherwise the most frequent of , tab ; | in the first line."""
    ext = os.path.splitext(path)[1].lower()
    if ext in (".csv", ".tsv"):
        return "," if ext == ".csv" else "\t"
    return max(SEPARATORS, key=lambda s: (line.count(s), s == ","))


def _look(path: str, kind: str, header: bool, sep: str | None) -> dict:
    """What a file says of itself: the schema's text of a Parquet or ORC file, separator and names of a CSV file."""
    import pyarrow.fs as pafs
    files, place = pafs.FileSystem.from_uri(path)
    if kind == "csv":
        with files.open_input_stream(place, compression="detect") as f:
            line = f.read(HEADER_BYTES).split(b"\n", 1)[0].decode("utf-8-sig", "replace").rstrip("\r")
        own = sep or separator_of(path, line)
        names = next(csv.reader([line], delimiter=own), []) if line else []
        return {"sep": own, "names": names if header else [f"_c{i}" for i in range(len(names))]}
    with files.open_input_file(place) as f:
        if kind == "parquet":
            import pyarrow.parquet as pq
            found = pq.read_schema(f)
        else:
            import pyarrow.orc as orc
            found = orc.ORCFile(f).schema
    return {"schema": found.remove_metadata().to_string(), "names": found.names}


def _census(spark: SparkSession, files: list[tuple[str, str]], header: bool, sep: str | None) -> dict[str, dict]:
    """What ``_look`` finds, by path; nothing for files that only Spark's readers reach."""
    look = _look
    schema = "path string, schema string, sep string, names array<string>"

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    found = look(r["path"], r["kind"], header, sep)
                except (OSError, pa.ArrowException):
                    continue
                rows.append({"path": r["path"], "schema": found.get("schema"), "sep": found.get("sep"), "names": found.get("names")})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("schema", pa.string()), ("sep", pa.string()),
                                                              ("names", pa.list_(pa.string()))]))

    from tessera.session import ship_package
    ship_package(spark)
    todo = spark.createDataFrame(files, "path string, kind string").repartition(min(len(files), MOST_TASKS))
    return {r["path"]: r.asDict() for r in todo.mapInArrow(run, schema).collect()}  # a row per file


def groups_of(spark: SparkSession, files: Sequence[tuple[str, str]], csv_options: dict, multiline_json: bool) -> list[Group]:
    """The files (path, kind) by what one scan can read.  Repeated paths are read as often as they are named."""
    header = str((csv_options or {}).get("header", True)).lower() == "true"
    sep = (csv_options or {}).get("sep") or (csv_options or {}).get("delimiter")
    seen = _census(spark, sorted({f for f in files if f[1] != "json"}), header, sep) if any(k != "json" for _, k in files) else {}
    groups: dict[tuple, Group] = {}
    times: dict[str, int] = {}
    for path, kind in files:
        nth = times[path] = times.get(path, 0) + 1
        found = seen.get(path)
        if kind == "json":
            key, made = (kind,), Group(kind, None, (), [])
        elif found is None:
            key, made = ("alone", path), Group(kind, sep, (), [])
        else:
            key = (kind, found["sep"], found["schema"], tuple(found["names"]))
            made = Group(kind, found["sep"], key[3], [])
        groups.setdefault((*key, nth), made).paths.append(path)
    return list(groups.values())


def json_names(spark: SparkSession, paths: list[str], multiline: bool) -> dict[str, tuple[str, ...]]:
    """The keys that occur in each JSON file, by path, in one job."""
    text = spark.read.option("wholetext", multiline).text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    keys = text.where(F.trim("value") != "").select("path", F.explode(F.json_object_keys("value")).alias("key")).distinct()
    found = keys.groupBy("path").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return {r["path"]: tuple(r["keys"]) for r in found.collect()}


def joined_schema(schemas: Sequence[tuple[T.StructType, str]], decided: Sequence[str] = ()) -> T.StructType:
    """The first schema's columns with the join of all types; schemas come with a file of theirs for messages.  ``decided``:
    columns whose type the caller has set."""
    first = schemas[0][0]
    fields = []
    for f in first.fields:
        if f.name in decided:
            fields.append(f)
            continue
        joined, by = to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType)])), schemas[0][1]
        for schema, path in schemas[1:]:
            other = to_arrow_schema(T.StructType([T.StructField(f.name, schema[f.name].dataType)]))
            try:
                joined = pa.unify_schemas([joined, other], promote_options="permissive")
            except pa.ArrowException:
                raise ValueError(f"column {f.name} is {f.dataType.simpleString()} in {by} and "
                                 f"{schema[f.name].dataType.simpleString()} in {path}: no type holds both (set its dtype)") from None
        fields.append(T.StructField(f.name, from_arrow_schema(joined)[0].dataType))
    return T.StructType(fields)


def united(frames: Sequence[tuple[DataFrame, str]], decided: Sequence[str] = ()) -> DataFrame:
    """Frames (each with a file of its) by name, with joined types."""
    names = set(frames[0][0].columns)
    for df, path in frames[1:]:
        if set(df.columns) != names:
            raise ValueError(f"{path}: column names differ from {frames[0][1]}")
    if len(frames) == 1:
        return frames[0][0]
    schema = joined_schema([(df.schema, path) for df, path in frames], decided)
    parts = [df.select(*[F.col(f.name) if f.name in decided or df.schema[f.name].dataType == f.dataType
                         else F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]) for df, _ in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
