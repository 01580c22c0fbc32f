"""WARC archives (one gzip member per record): a writer and a splittable reader, as a Spark data source.

Reading: a task gets byte ranges of the archives.  It scans a range for the gzip magic, takes a candidate for a record only
if the member inflates to its end and begins with decodable WARC headers whose length fits, and owns the records that begin inside
its range (the last one may end beyond it).  So an archive of any size is read by many tasks without an index.

Writing: each task writes archives of its own under unique names; the commit of the job lists them in a manifest, so what
lost or repeated tasks leave behind is never read.  Files are reached through pyarrow's file systems (local or
shared folders, HDFS, object stores).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from tessera.llm.text import checked_broadcast, ship
from tessera.session import checkpoint_dir, cut_lineage

FORMAT = "tessera_warc"
MAGIC = b"\x1f\x8b\x08"
MANIFEST = "_manifest.json"
RANGE = 16 << 20
FILE_BYTES = 1 << 30
READ = 1 << 16
MOST_HEADERS = 1 << 16
BATCH_BYTES = 8 << 20
SALTS = 32
DATE = "2000-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = ("file string, start long, end long, range_end long, type string, record_id string, date string, "
               "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, intact boolean")
WRITE_COLUMNS = ("id", "uri", "payload", "refers_to")


def digest(payload: bytes) -> str:
    """Base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# records

def _header_value(text: str) -> str:
    """A value that cannot end its header line: controls and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_name(id_: int | None) -> str:
    return f"<urn:page:{'none' if id_ is None else id_}>"


def member(id_: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str = DATE, level: int = 6) -> bytes:
    """The gzip member of a page: a response with its payload, or (``refers_to`` given) a revisit with the HTTP headers alone."""
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(id_)}",
             f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header_value(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{own}", f"WARC-Block-Digest: sha1:{digest(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _headers(block: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; folded lines go on the line before."""
    found: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def parse(record: bytes) -> dict | None:
    """The columns of a decoded record; None if it is no whole WARC record."""
    head = record.find(b"\r\n\r\n", 0, MOST_HEADERS)
    if not record.startswith(b"WARC/") or head < 0:
        return None
    named = _headers(record[:head])
    if not named.get("content-length", "").isdigit() or "warc-type" not in named:
        return None
    size = int(named["content-length"])
    block = record[head + 4:head + 4 + size]
    if len(block) != size:
        return None
    payload, length = block, size
    if named.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        http, payload = (block[:cut], block[cut + 4:]) if cut >= 0 else (block, b"")
        length = len(payload)
        if named["warc-type"] == "revisit" and (said := _headers(http).get("content-length", "")).isdigit():
            length = int(said)  # the payload is that of the record it refers to
    kind, _, told = named.get("warc-payload-digest", "").partition(":")
    revisit = named["warc-type"] == "revisit"
    own = told if revisit else digest(payload)
    return {"type": named["warc-type"], "record_id": named.get("warc-record-id"), "date": named.get("warc-date"),
            "target_uri": named.get("warc-target-uri"), "refers_to": named.get("warc-refers-to"), "payload_digest": own or None,
            "payload_bytes": length, "payload": None if revisit else payload,
            "intact": None if revisit or kind != "sha1" else told == own}


# ranges

class _Bytes:
    """Reads a file forwards in blocks from any place, and keeps the current block."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.at, self.data = 0, b""

    def block(self, place: int) -> bytes:
        """Bytes from ``place`` on: what is left of the current block if that is something, else the next one."""
        if not self.at <= place < self.at + len(self.data):
            self.file.seek(place)
            self.at, self.data = place, self.file.read(min(READ, self.size - place))
        return self.data[place - self.at:]

    def find(self, start: int, end: int) -> int:
        """First place of the magic in [start, end), or -1."""
        tail = b""
        while start < end and start < self.size:
            block = self.block(start)
            if not block:
                return -1
            joined = tail + block
            hit = joined.find(MAGIC)
            if hit >= 0:
                place = start - len(tail) + hit
                return place if place < end else -1
            tail = joined[-2:]
            start += len(block)
            if start >= end and start < self.size:  # the magic may begin before the end and go on behind it
                joined = tail + self.block(start)[:2]
                hit = joined.find(MAGIC)
                place = start - len(tail) + hit
                return place if hit >= 0 and place < end else -1
        return -1


def decode(data: _Bytes, place: int) -> tuple[bytes, int] | None:
    """The record whose member begins at ``place`` and where the member ends; None if that is no member with WARC headers."""
    first = data.block(place)
    if len(first) < 4 and place + 4 <= data.size:
        first += data.block(place + len(first))
    if len(first) > 3 and first[3] & 0xE0:
        return None
    unpack = zlib.decompressobj(31)
    parts, known, at = [], 0, place
    while not unpack.eof:
        block = data.block(at) if at < data.size else b""
        if not block:
            return None
        try:
            out = unpack.decompress(block)
        except zlib.error:
            return None
        at += len(block) - len(unpack.unused_data)
        parts.append(out)
        if known < 5 and out:
            begin = b"".join(parts)[:5]
            known = len(begin)
            if not b"WARC/".startswith(begin):
                return None
    return b"".join(parts), at


def owned(file, size: int, start: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """(start, end, columns) of the records that begin in [start, end)."""
    data = _Bytes(file, size)
    while 0 <= (start := data.find(start, end)):
        got = decode(data, start)
        record = parse(got[0]) if got else None
        if record is None:
            start += 1
            continue
        yield start, got[1], record
        start = got[1]


# data source

@dataclass
class Ranges(InputPartition):
    ranges: tuple[tuple[str, int, int, int], ...]  # path, size, start, end


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("rangebytes", RANGE))
        self.payloads = options.get("payloads", "true").lower() == "true"

    def partitions(self):
        files, root = pafs.FileSystem.from_uri(self.path)
        listing = files.get_file_info(f"{root}/{MANIFEST}")
        if listing.type == pafs.FileType.File:
            with files.open_input_stream(listing.path) as f:
                names = json.loads(f.read())
            infos = files.get_file_info([f"{root}/{n}" for n in names]) if names else []
        else:
            here = files.get_file_info(root)
            infos = [here] if here.type == pafs.FileType.File else [
                i for i in files.get_file_info(pafs.FileSelector(root, recursive=True)) if i.path.endswith(".warc.gz")]
        parts, held, room = [], [], self.step
        for info in sorted((i for i in infos if i.size), key=lambda i: i.path):
            for start in range(0, info.size, self.step):
                end = min(start + self.step, info.size)
                if held and end - start > room:  # small files share a task
                    parts.append(Ranges(tuple(held)))
                    held, room = [], self.step
                held.append((info.path, info.size, start, end))
                room -= end - start
        return [*parts, Ranges(tuple(held))]

    def read(self, partition):
        files, _ = pafs.FileSystem.from_uri(self.path)
        schema = _arrow(self.payloads)
        rows, held = [], 0
        for path, size, start, end in partition.ranges:
            with files.open_input_file(path) as f:
                for at, to, record in owned(f, size, start, end):
                    if not self.payloads:
                        record["payload"] = None
                    rows.append({"file": path, "start": at, "end": to, "range_end": end, **record})
                    held += len(record["payload"] or b"") + 512
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _arrow(payloads: bool) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in READ_SCHEMA.split(", "))])


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.most, self.date = int(options.get("filebytes", FILE_BYTES)), options.get("date", DATE)

    def write(self, iterator):
        files, root = pafs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        names, out = [], None
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in WRITE_COLUMNS]
            for i in range(batch.num_rows):  # a record at a time: the batch's payloads aren't copied
                id_, uri, payload, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    names.append(f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz")
                    out = files.open_output_stream(f"{root}/{names[-1]}", compression=None)
                out.write(member(id_, uri, payload or b"", refers_to, self.date))
                if out.tell() >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(tuple(names))

    def commit(self, messages):
        files, root = pafs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m for n in m.names)
        with files.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        files, root = pafs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            files.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """``spark.read.format("tessera_warc").load(folder)`` and ``df.write.format("tessera_warc").mode("append").save(folder)``
    (a new folder; columns id, uri, payload, refers_to).  Options: rangeBytes, payloads; fileBytes, date."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


# operator

def _registered(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(WarcSource)
    return spark


def _first_of_equal(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (id, uri, payload) with ``refers_to``: the smallest id of equal payloads of ``least`` bytes or more (null where
    it is the row's own, or there is no other)."""
    keyed = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    wide = F.octet_length("payload") >= least
    firsts = cut_lineage(keyed.where(wide).groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1 and first is not null").drop("n"))
    small = checked_broadcast(firsts)
    on = ["same"]
    if small is firsts:  # copies of one payload are spread over salts, its first is sent to each
        small = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "uri"), F.lit(SALTS)).cast("int"))
        on = ["same", "salt"]
    joined = keyed.join(small, on, "left")
    refers = F.when(wide & ~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    return joined.select("id", "uri", "payload", refers.alias("refers_to"))


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                least: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Write a record per row of ``pages`` to archives in the new folder ``path``.

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest id is a response and the others revisit
    it; all else are responses.  A null payload is empty, a null uri has no header.  Rows that share the smallest id of a payload are all
    responses; a row without id revisits one that has one, and rows without any are all responses.  An empty table gives
    an empty manifest.  Other columns are ignored."""
    _registered(pages.sparkSession)
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[uri_col].cast("string").alias("uri"), payload.alias("payload"))
    rows = _first_of_equal(rows, least).select(*WRITE_COLUMNS)
    rows.write.format(FORMAT).mode("append").option("date", date).option("fileBytes", str(file_bytes)).save(path)


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``path`` (a folder or one file): the columns of READ_SCHEMA.

    What is no whole member with WARC headers (damage, padding, other members) is passed over.  A record of a range may lie
    inside a longer record that began before the range, as an archive kept as a payload does: such are found by the
    records that run over their range's end and left out."""
    reader = _registered(spark).read.format(FORMAT).option("rangeBytes", str(range_bytes)).option("payloads", str(payloads))
    records = reader.load(path)
    index = reader.option("payloads", "false").load(path)
    div = lambda c: F.call_function("div", c, F.lit(range_bytes))
    over = index.where("end > range_end").select(
        F.col("file").alias("o_file"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(div(F.col("range_end")), div(F.col("end") - 1))).alias("o_range"))
    over = cut_lineage(over)  # at most one that counts for each range
    inside = ((F.col("file") == F.col("o_file")) & (div(F.col("start")) == F.col("o_range"))
              & (F.col("start") > F.col("o_start")) & (F.col("start") < F.col("o_end")))
    return records.join(checked_broadcast(over), inside, "left_anti")


def page_id(record_id: Column) -> Column:
    """The id that ``record_name`` wrote; null for none and for foreign names."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archived(pages: DataFrame, path: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives (in the shared checkpoint folder unless ``path`` is given) and read them
    back: page_id, payload_bytes, payload_digest, record_type and refers_to of each record; see ``write_pages``."""
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    write_pages(pages, path)
    return read_records(spark, path, range_bytes, payloads=False).select(
        page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page_id(F.col("refers_to")).alias("refers_to"))
