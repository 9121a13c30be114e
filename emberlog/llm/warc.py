"""A Python data source for WARC archives: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Each record is a gzip member of its own whose header says how long it is (extra field ``sl``:
compressed and plain length), so a reader can step over a member that it doesn't want; members
without that field, and plain archives, are read through.

Reading: each file is a partition.  Predicates on record_type and on the header columns are taken
over by the source: WARC headers are parsed first, and of a record that they rule out the payload
is never inflated.  ``option("payload", "false")`` leaves payloads of all records alone.

Writing: each job has a folder of its own, where tasks write files of at most ``bytes_per_file`` under names of their own attempt.  The job ends with one small file
there that lists those of successful attempts; readers take no other from it, so tasks may be lost and repeated, and nothing is renamed.  Files of lost attempts go when a job ends, or with ``abort``.
Lengths have 32 bits: a payload is a value of Spark's, which holds 2 GB at most.

Columns: record_id, record_type, target_uri, date, payload_digest (bare hex SHA-256 of the payload,
also for revisits), payload_length (of the full payload), refers_to, content_type, payload (binary, null for
revisits and where not wanted).

Defined results: nulls are left out of the headers and read as nulls; header values lose line
breaks; repeated rows are records each; an empty table gives an empty archive, which reads as no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO, Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import checkpointed, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, content_type string, payload binary"
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
}
_NAMES = {v.lower(): k for k, v in HEADERS.items()}
_LINE_BREAKS = str.maketrans("\r\n", "  ")
_PLAIN = 1 << 16  #: bytes inflated at first, to see the headers


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI: local, HDFS or an object store."""
    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record(fields: dict[str, Any]) -> bytes:
    """One record as a gzip member with its lengths in front."""
    payload = fields.get("payload") or b""
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        value = fields.get(column)
        if value is not None:
            text = str(value).translate(_LINE_BREAKS)
            lines.append(f"{header}: {'sha256:' + text if column == 'payload_digest' else text}")
    lines.append(f"Content-Length: {len(payload)}")
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _fields(headers: dict[str, str]) -> dict[str, Any]:
    out: dict[str, Any] = {k: headers.get(h) for h, k in _NAMES.items()}
    digest, length = out["payload_digest"], out["payload_length"]
    out["payload_digest"] = digest.partition(":")[2] if digest and ":" in digest else digest
    out["payload_length"] = int(length) if length and length.isdigit() else None
    return out


def _wanted(fields: dict[str, Any], tests: list[tuple[str, frozenset | None]]) -> bool:
    return all(fields[c] is not None and (values is None or fields[c] in values) for c, values in tests)


def read_records(stream: IO[bytes], tests: list[tuple[str, frozenset | None]], payloads: bool) -> Iterator[tuple[dict[str, Any], bytes | None]]:
    """(fields, payload) of the records that pass the tests."""
    start = stream.read(2)
    if start != b"\x1f\x8b":
        yield from _read_plain(start, stream, tests, payloads)
        return
    held = start
    while True:
        while len(held) < 18 and (more := stream.read(_PLAIN)):
            held += more
        if len(held) < 18:
            return
        total = None
        if held[3] & 4:
            (n,) = struct.unpack_from("<H", held, 10)
            while len(held) < 12 + n and (more := stream.read(_PLAIN)):
                held += more
            if n == 12 and held[12:14] == b"sl":
                (total,) = struct.unpack_from("<I", held, 16)
        if total:
            if len(held) < min(total, _PLAIN):
                held += stream.read(min(total, _PLAIN) - len(held))
            inflate = zlib.decompressobj(31)
            plain = inflate.decompress(held[:total], 8192)
            while b"\r\n\r\n" not in plain and (inflate.unconsumed_tail or len(held) < total):
                if not inflate.unconsumed_tail:
                    held += (more := stream.read(_PLAIN))
                    plain += inflate.decompress(more, 8192)
                else:
                    plain += inflate.decompress(inflate.unconsumed_tail, 8192)
            head, _, body = plain.partition(b"\r\n\r\n")
            headers = parse_headers(head)
            fields = _fields(headers)
            keep = _wanted(fields, tests)
            if keep and payloads:
                if len(held) < total:
                    held += stream.read(total - len(held))
                plain = zlib.decompress(held[:total], 31)
                at, n = len(head) + 4, int(headers.get("content-length", 0))
                yield fields, plain[at : at + n]
            elif keep:
                yield fields, None
            if len(held) < total:  # the rest of the member is never looked at
                stream.seek(total - len(held), 1)
                held = b""
            else:
                held = held[total:]
        else:  # a foreign member: its end shows only when it is inflated
            inflate, parts = zlib.decompressobj(31), []
            while not inflate.eof:
                held = held or stream.read(_PLAIN)
                if not held:
                    return
                parts.append(inflate.decompress(held))
                held = inflate.unused_data
            head, _, body = b"".join(parts).partition(b"\r\n\r\n")
            headers = parse_headers(head)
            if _wanted(fields := _fields(headers), tests):
                yield fields, body[: int(headers.get("content-length", 0))] if payloads else None


def _read_plain(start: bytes, stream: IO[bytes], tests: list[tuple[str, frozenset | None]], payloads: bool) -> Iterator[tuple[dict[str, Any], bytes | None]]:
    held = start
    while True:
        held = held.lstrip(b"\r\n")
        while b"\r\n\r\n" not in held and (more := stream.read(_PLAIN)):
            held = (held + more).lstrip(b"\r\n")
        if b"\r\n\r\n" not in held:
            return
        head, _, held = held.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        n, fields = int(headers.get("content-length", 0)), _fields(headers)
        keep = _wanted(fields, tests)
        if keep and payloads:
            held += stream.read(max(0, n - len(held)))
            yield fields, held[:n]
        elif keep:
            yield fields, None
        if len(held) < n:
            stream.seek(n - len(held), 1)
            held = b""
        else:
            held = held[n:]


@dataclass
class File(InputPartition):
    path: str


#: The prefix of a job's folder, and the file in it that lists what belongs to the archive.
_JOB, _LIST = "warc-job-", "_files"


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, frozenset([f.value])))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, frozenset(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File]
        listed: set[str] = set()
        for f in files:
            if f.base_name == _LIST:
                folder = f.path.rpartition("/")[0]
                with system.open_input_stream(f.path) as stream:
                    listed.update(f"{folder}/{n}" for n in stream.read().decode().split())
        names = [f for f in files if f.base_name.endswith((".warc", ".warc.gz")) and (f.path in listed or not f.path.rpartition("/")[0].rpartition("/")[2].startswith(_JOB))]
        return [File(f.path) for f in sorted(names, key=lambda f: -f.size)]  # the longest first

    def read(self, partition: File) -> Iterator[tuple]:
        if partition is None:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as stream:
            for f, payload in read_records(stream, self.tests, self.payloads):
                yield (*(f[c] for c in HEADERS), None if f["record_type"] == "revisit" else payload)


@dataclass
class Wrote(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.columns = options["path"], schema.names
        self.most = int(options.get("bytes_per_file", 128 << 20))
        self.job = f"{_JOB}{uuid.uuid4().hex}"
        if overwrite:
            system, root = _open(self.path)
            if system.get_file_info(root).type != fs.FileType.NotFound:
                system.delete_dir_contents(root)

    def write(self, rows: Iterator) -> Wrote:
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        names: list[str] = []
        stream, size = None, 0
        for row in rows:
            if stream is None or size > self.most:
                if stream:
                    stream.close()
                names.append(f"{uuid.uuid4().hex}.warc.gz")
                stream, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
            data = record(dict(zip(self.columns, row, strict=True)))
            stream.write(data)
            size += len(data)
        if stream:
            stream.close()
        return Wrote(names)

    def _folder(self) -> tuple[fs.FileSystem, str]:
        system, root = _open(self.path)
        return system, f"{root.rstrip('/')}/{self.job}"

    def commit(self, messages: list[Wrote | None]) -> None:
        """Writes the list, which makes all files part of the archive at once; then files of lost attempts go."""
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        names = {n for m in messages for n in (m.names if m else ())}
        with system.open_output_stream(f"{folder}/{_LIST}", compression=None) as stream:
            stream.write("\n".join(sorted(names)).encode())
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.base_name not in names and f.base_name != _LIST:
                system.delete_file(f.path)

    def abort(self, messages: list[Wrote | None]) -> None:
        system, folder = self._folder()
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


_PAGE = "urn:page:"


def records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages as records: of equal payloads of ``least`` bytes or more, all but that of the smallest id are revisits.

    The payloads' hashes alone are grouped; of pages with equal ids and payloads each is as the smallest.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), html.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    known = rows.withColumn("payload_length", F.octet_length("payload").cast("long"))
    again = known.filter(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("smallest"), F.count("*").alias("n")).filter("n > 1")
    out = known.join(checkpointed(again.select(F.col("payload_digest").alias("digest"), "smallest")), F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("smallest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("smallest"))
    return out.select(
        F.concat(F.lit(f"<{_PAGE}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        "payload_digest",
        "payload_length",
        F.when(revisit, F.concat(F.lit(f"<{_PAGE}"), F.col("smallest").cast("string"), F.lit(">"))).alias("refers_to"),
        F.lit("text/html").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archive of ``pages`` and reads it: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of responses are those of the payload that was read; revisits have
    them in their headers alone.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records(pages).write.format("warc").mode("append").save(path)
    read = lambda: spark.read.format("warc").load(path)
    number = lambda c: F.regexp_extract(c, rf"^<{_PAGE}(-?[0-9]+)>$", 1).try_cast("long")
    own = read().filter(F.col("record_type") == "response").select(
        number("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    again = read().filter(F.col("record_type") == "revisit").select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return own.unionByName(again)
