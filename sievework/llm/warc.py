"""WARC archives as a Python data source for reading and writing.

Reading plans partitions from files and their marked record starts, takes predicates on record types and headers,
parses a record's headers first and leaves the payload of an unwanted record undecoded: gzip members written here name
their own length in the `sl` extra field, so the reader steps over the rest. Members without it are decoded through.
Writing gives each task files of its own; a manifest names those of the tasks that were committed.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import stored

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Bytes of archive for a partition, between marks, and for a file.
SPLIT, MARK, ROTATE = 32 << 20, 8 << 20, 512 << 20
#: How names of archives begin that are written here: hidden, as their write may have been aborted, unless a manifest names them.
OWN = "_written-"
#: Most payloads with copies whose digests are broadcast (about 100 bytes each).
MOST_SENT = 400_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# writing ----------------------------------------------------------------------------------------------------------


def record(row: dict) -> bytes:
    """An uncompressed record. Length and type of a payload are in the HTTP headers, which a revisit has as well."""
    payload = row["payload"] or b""
    length = len(payload) if row["record_type"] == "response" else row["payload_length"] or 0
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if row["record_type"] == "response" else http
    heads = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<{row['record_id']}>"),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", row["payload_digest"] and f"sha1:{row['payload_digest']}"),
        ("WARC-Refers-To", row["refers_to"] and f"<{row['refers_to']}>"),
        ("WARC-Profile", REVISIT_PROFILE if row["record_type"] == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {re.sub(r'[\r\n]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in heads if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member of one record, with its compressed and full length in the extra field where they fit."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if len(data) >= 1 << 32 or len(body) + 32 >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + tail
    total = 10 + 2 + 12 + len(body) + len(tail)
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data)) + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 4))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        files: list[dict] = []
        out = None
        try:
            for batch in iterator:
                for at in range(batch.num_rows):
                    if out is None or files[-1]["bytes"] > ROTATE:
                        if out is not None:
                            out.close()
                        name = f"{OWN}{uuid.uuid4().hex}.warc.gz"
                        files.append({"name": name, "bytes": 0, "marks": [0]})
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    file = files[-1]
                    if file["bytes"] - file["marks"][-1] > MARK:
                        file["marks"].append(file["bytes"])
                    data = member(record(batch.slice(at, 1).to_pylist()[0]), self.level)
                    out.write(data)
                    file["bytes"] += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Archives of a write that no manifest names are never read; those of finished tasks are removed."""
        store, root = fs.FileSystem.from_uri(self.path)
        for file in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/{file['name']}")


# reading ----------------------------------------------------------------------------------------------------------


@dataclass
class Ranges(InputPartition):
    """(file, first byte, end) of record starts; an end of -1 is the file's."""

    parts: list[tuple[str, int, int]]


TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}
#: Columns that a record's own headers give, before its block is decoded.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.decode = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_COLUMNS and type(f) is IsNotNull:
                self.tests.append((column, IsNotNull, None))
            elif column in HEADER_COLUMNS and type(f) in TESTS and getattr(f, "value", None) is not None:
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        store, root = fs.FileSystem.from_uri(self.path)
        one = store.get_file_info(root)
        found = [one] if one.is_file else sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path)
        ranges = [(f.path, 0, f.size) for f in found if f.path.endswith((".warc", ".warc.gz")) and (one.is_file or not f.base_name.startswith(OWN))]
        for manifest in (f.path for f in found if f.base_name.startswith("_manifest-")):
            with store.open_input_stream(manifest) as own:
                for file in json.loads(own.read()):
                    path = f"{manifest.rpartition('/')[0]}/{file['name']}"
                    ends = [*file["marks"][1:], file["bytes"]]
                    ranges += [(path, a, b) for a, b in zip(file["marks"], ends, strict=True)]
        groups: list[list] = []
        size = SPLIT
        for r in ranges:
            if size + r[2] - r[1] > SPLIT:
                groups.append([])
                size = 0
            groups[-1].append(r)
            size += r[2] - r[1]
        return [Ranges(g) for g in groups] or [Ranges([])]

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            x = row[column]
            if x is None or kind is not IsNotNull and not TESTS[kind](x, value):
                return False
        return True

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in SCHEMA.split(", ")])
        rows: list[dict] = []
        size = 0
        for path, start, stop in partition.parts:
            with store.open_input_file(path) as file:
                for row in records(file, start, stop, self.wanted, self.decode):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Bytes:
    """Decoded bytes of a member or of a plain archive, read forward; step() leaves the rest of a record out."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start = file, start
        file.seek(start)
        head = file.read(24)
        self.packed = head[:2] == b"\x1f\x8b"
        self.length = None
        if self.packed and head[3:4] == b"\x04" and head[12:14] == b"sl":
            self.length = struct.unpack("<I", head[16:20])[0]
        file.seek(start)
        self.inflate = zlib.decompressobj(31) if self.packed else None
        self.buffer, self.taken = b"", 0

    def more(self) -> bool:
        """Decode some more bytes."""
        if self.inflate is None:
            got = self.file.read(1 << 16)
        elif self.inflate.eof:
            return False
        else:
            raw = self.inflate.unconsumed_tail or self.file.read(1 << 14)
            if not raw:
                return False
            got = self.inflate.decompress(raw, 1 << 18)
        self.buffer += got
        return bool(got) or self.inflate is not None

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        parts, missing = [], n
        while missing:
            if not self.buffer and not self.more():
                break
            parts.append(self.buffer[:missing])
            self.buffer = self.buffer[len(parts[-1]) :]
            missing -= len(parts[-1])
        self.taken += n - missing
        return b"".join(parts)

    def step(self, n: int) -> int:
        """Where the next record starts, when n decoded bytes of this one are still to come."""
        if self.inflate is None:
            return self.start + self.taken + n
        if self.length is not None:
            return self.start + self.length
        while not self.inflate.eof:
            self.buffer = b""
            if not self.more():
                break
        return self.file.tell() - len(self.inflate.unused_data)


def records(file: pa.NativeFile, start: int, stop: int, wanted: Callable[[dict], bool], decode: bool) -> Iterator[dict]:
    """Wanted records that start in the range; only their blocks are decoded."""
    at = start
    while at < stop:
        data = Bytes(file, at)
        head = data.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        heads = headers(head)
        length = int(heads["content-length"])
        row = {
            "record_id": heads.get("warc-record-id", "").strip("<>") or None,
            "record_type": heads.get("warc-type"),
            "target_uri": heads.get("warc-target-uri"),
            "date": heads.get("warc-date"),
            "refers_to": heads.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": heads.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "payload_length": None,
            "payload": None,
        }
        left = length
        if wanted(row):
            if heads.get("content-type", "").startswith("application/http"):
                http = data.until(b"\r\n\r\n") or b""
                left -= len(http)
                row["payload_length"] = int(headers(http).get("content-length", left))
            else:
                row["payload_length"] = length
            if decode and row["record_type"] != "revisit":
                row["payload"] = data.take(left)
                left = 0
            yield row
        at = data.step(left + 4)


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, found, v in (line.partition(":") for line in lines) if found}


class WarcSource(DataSource):
    """format("warc"). Options: path; payload=false leaves payloads undecoded; level of compression when writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# DataFrames -------------------------------------------------------------------------------------------------------


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_pages(df: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", date: str = "1970-01-01T00:00:00Z", revisit_from: int = 0) -> None:
    """Archive one record for each row under path, the body in UTF-8 as payload.

    Of rows with equal payloads of at least revisit_from bytes, that with the smallest key is a response, the others
    revisit it. Null bodies are empty payloads and null URLs leave the header out. Null keys revisit any other key and
    are responses where there is none; rows that share the smallest key are all responses.
    """
    pages = df.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(body).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumns({"same": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    firsts = pages.groupBy("same", "payload_length").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    firsts = stored(firsts, "warc-firsts")  # of payloads that occur more than once; the others need none
    few = firsts.limit(MOST_SENT + 1).count() <= MOST_SENT
    found = pages.join(F.broadcast(firsts) if few else firsts, ["same", "payload_length"], "left")  # beyond that, a hot payload's rows are split among tasks as a skewed join
    again = (F.col("payload_length") >= revisit_from) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:x-row:"), F.coalesce(c.cast("string"), F.lit("null")))
    rows = found.select(
        urn(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )
    register(df.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under path, or of the one that path is, in the columns of SCHEMA.

    Archives of others (.warc, .warc.gz) are read whole, those written here once their write is committed. The payload is
    null for revisits or if not asked for; headers that a record lacks are null; a folder without archives gives no rows.
    Bytes that are no record where one must start end the read with an error.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def read_pages(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """What write_pages() archived: key, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Length and digest of a response are those of the payload as read, those of a revisit are in its headers.
    """
    own = lambda c: F.regexp_extract(c, r"^urn:x-row:(-?\d+)$", 1).try_cast("long")
    rows = read_archives(spark, path)
    response = F.col("record_type") == "response"
    return rows.select(
        own(F.col("record_id")).alias(key),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        own(F.col("refers_to")).alias("refers_to"),
        "target_uri",
    )
