"""WARC archives as a Spark data source, in both directions.

Format name ``warc``.  Writing: one archive per task, each record its own gzip member with
the "sl" extra field (compressed and plain length), under a temporary name until the job commits.
Reading: files are grouped into partitions by size; predicates on header columns are pushed
into the reader, which parses a record's header first and jumps over
the member of an unwanted record.  Where payloads are not wanted, no more of a member is inflated than holds
its headers; digests are then as stated, not verified, and a payload without a stated length is inflated to count it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from vitalgrid.llm.common import new_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, "
    "payload_digest string, refers_to string, profile string, http_status int, payload_length long, payload binary"
)
#: Columns that come from the record header alone, and their header names.
HEADER_COLUMNS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "profile": "warc-profile",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIXED_DATE = "1970-01-01T00:00:00Z"
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 16 << 20
AHEAD_BYTES = 2 << 20  # read at once
FIRST_BYTES = 2 << 10  # of a record, inflated at once until its headers end
GZIP_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member that states its own compressed and plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    whole = len(GZIP_HEAD) + 8 + len(body) + 8
    return GZIP_HEAD + struct.pack("<II", whole, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A whole record; header values lose line ends, null ones are left out."""
    lines = ["WARC/1.1"] + [f"{k}: {' '.join(v.splitlines())}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int):
        self.path, self.level = path, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    out = out or fs.open_output_stream(f"{root}/_{name}", compression=None)
                    out.write(gzip_member(self._record(row), self.level))
                    n += 1
        finally:
            if out:
                out.close()
        return Archive(name if n else None, n)

    @staticmethod
    def _record(row: dict) -> bytes:
        payload = row["payload"]
        http = [f"HTTP/1.1 {row['http_status'] or 200} OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {row['payload_length']}"]
        block = ("\r\n".join(http) + "\r\n\r\n").encode() + (payload or b"")
        heads = {
            "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Target-URI": "target_uri",
            "WARC-Payload-Digest": "payload_digest", "WARC-Refers-To": "refers_to", "WARC-Profile": "profile", "Content-Type": "content_type",
        }
        return record([(k, row[c]) for k, c in heads.items()], block)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            if m and m.name:
                fs.move(f"{root}/_{m.name}", f"{root}/{m.name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/_{m.name}")


@dataclass
class Archive(WriterCommitMessage):
    name: str | None
    records: int


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class _Ahead:
    """A file read in large pieces, of which small ones are cut."""

    def __init__(self, f):
        self.f, self.at, self.data = f, 0, b""

    def cut(self, at: int, n: int) -> bytes:
        """The bytes [at, at + n), as far as there are any."""
        skip = at - self.at
        if not 0 <= skip <= len(self.data) - n:
            self.data = self.data[skip:] if 0 <= skip < len(self.data) else b""
            self.at = at
            self.f.seek(at + len(self.data))
            self.data += self.f.read(max(n - len(self.data), AHEAD_BYTES))
            skip = 0
        return self.data[skip : skip + n]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool, partition_bytes: int, verify_all: bool = False):
        self.path, self.payload, self.verify, self.partition_bytes, self.verify_all = path, payload, verify, partition_bytes, verify_all
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep predicates on header columns; the rest go back to Spark."""
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has", IsNotNull: "set"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in kinds and column in HEADER_COLUMNS:
                self.wanted.append((kinds[type(f)], HEADER_COLUMNS[column], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = sorted((x for x in found if x.is_file and x.base_name.endswith(".warc.gz") and not x.base_name.startswith(("_", "."))), key=lambda x: -x.size)
        groups: list[tuple[int, list[str]]] = []
        for x in files:  # next-fit over falling sizes
            if groups and groups[-1][0] + x.size <= self.partition_bytes:
                groups[-1] = (groups[-1][0] + x.size, [*groups[-1][1], x.path])
            else:
                groups.append((x.size, [x.path]))
        return [Files(paths) for _, paths in groups] or [Files([])]

    def _wants(self, head: dict[str, str]) -> bool:
        for kind, key, value in self.wanted:
            have = head.get(key)
            if have is None or not (
                (kind == "set")
                or (kind == "eq" and have == value)
                or (kind == "in" and have in value)
                or (kind == "starts" and have.startswith(value))
                or (kind == "ends" and have.endswith(value))
                or (kind == "has" and value in have)
            ):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.path)
        schema = pa.schema(
            [(c, pa.string()) for c in HEADER_COLUMNS] + [("http_status", pa.int32()), ("payload_length", pa.int64()), ("payload", pa.binary())]
        )
        rows: list[dict] = []
        size = 0
        for path in partition.value:
            with fs.open_input_file(path) as f:
                for row in self._records(f):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, f) -> Iterator[dict]:
        at, end, ahead = 0, f.size(), _Ahead(f)
        while at < end:
            start = ahead.cut(at, 64 << 10)
            member = self._stated_length(start)
            if member is None:  # written elsewhere: find the member's end by inflating it
                plain, member = self._inflate_unstated(f, at)
                more = None
            else:
                unzip = zlib.decompressobj(31)
                plain, more = unzip.decompress(start[:member], FIRST_BYTES), unzip
            while b"\r\n\r\n" not in plain and more and (got := more.decompress(more.unconsumed_tail, FIRST_BYTES)):
                plain += got
            raw_head, _, block = plain.partition(b"\r\n\r\n")
            head = {}
            for line in raw_head.decode(errors="replace").split("\r\n")[1:]:
                k, _, v = line.partition(":")
                head[k.strip().lower()] = v.strip()
            if self._wants(head):
                if more and (self.payload or self.verify_all or not self._told_by_headers(head, block, more)):
                    rest = ahead.cut(at + len(start), member - len(start)) if member > len(start) else b""
                    block += more.decompress(more.unconsumed_tail + rest) if not more.eof else b""
                yield self._row(head, block[: int(head.get("content-length", 0))])
            at += member

    @staticmethod
    def _told_by_headers(head: dict[str, str], block: bytes, more) -> bool:
        """Whether what is inflated so far states the payload's length: HTTP headers that end and hold it."""
        if not head.get("content-type", "").startswith("application/http"):
            return False
        http, end, _ = block.partition(b"\r\n\r\n")
        return bool(end) and re.search(rb"\r\ncontent-length:[ \t]*\d+", http, re.I) is not None

    @staticmethod
    def _stated_length(start: bytes) -> int | None:
        if len(start) >= 24 and start[:4] == GZIP_HEAD[:4] and start[12:14] == b"sl":
            return struct.unpack("<I", start[16:20])[0]
        return None

    @staticmethod
    def _inflate_unstated(f, at: int) -> tuple[bytes, int]:
        unzip, out, read = zlib.decompressobj(31), [], 0
        f.seek(at)
        while not unzip.eof:
            data = f.read(1 << 20)
            if not data:
                break
            read += len(data)
            out.append(unzip.decompress(data))
        return b"".join(out), max(1, read - len(unzip.unused_data))

    def _row(self, head: dict[str, str], block: bytes) -> dict:
        row: dict = {c: head.get(k) for c, k in HEADER_COLUMNS.items()}
        row |= {"http_status": None, "payload_length": len(block), "payload": None}
        payload: bytes | None = block
        if (row["content_type"] or "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            lines = http.decode(errors="replace").split("\r\n")
            status = lines[0].split(" ")
            row["http_status"] = int(status[1]) if len(status) > 1 and status[1].isdigit() else None
            stated = next((x.partition(":")[2].strip() for x in lines[1:] if x.lower().startswith("content-length:")), "")
            row["payload_length"] = int(stated) if stated.isdigit() else len(payload)
        if row["record_type"] == "revisit":
            return row
        if (self.verify_all or self.payload and self.verify) and row["payload_digest"] and row["payload_digest"] != "sha1:" + sha1_base32(payload):
            raise ValueError(f"payload of {row['record_id']} does not match its digest")
        row["payload"] = payload if self.payload else None
        return row


class WarcDataSource(DataSource):
    """Options: path; payload (default true) false leaves payloads out; verify (default true) checks digests of payloads that are wanted; level; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        o = self.options
        return WarcReader(o["path"], o.get("payload", "true") == "true", o.get("verify", "true") == "true", int(o.get("partitionBytes", PARTITION_BYTES)), o.get("verifyall", o.get("verifyAll", "false")) == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", 6)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


#: Base-32 digits of RFC 4648 (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hex40) -> F.Column:
    """Upper-case base 32 of a 40-digit hexadecimal column: eight groups of five hexadecimal digits."""
    groups = []
    for g in range(8):
        value = F.conv(F.substring(hex40, 5 * g + 1, 5), 16, 10).cast("int")
        groups += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*groups)


def _record_id(page_id) -> F.Column:
    """A record id that holds the page id in its last 64 bits."""
    h = F.lower(F.lpad(F.hex(page_id), 16, "0"))
    return F.concat(F.lit("<urn:uuid:77617263-7061-8765-"), F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 12), F.lit(">"))


def page_id_of(record_id) -> F.Column:
    """The page id in such a record id."""
    digits = F.concat(F.substring(record_id, 30, 4), F.substring(record_id, 35, 12))
    return F.conv(digits, 16, -10).cast("long")


ROWS_PER_SALT = 10_000


def to_records(pages: DataFrame, min_revisit_bytes: int = 0, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """WARC records of pages (page_id, url, html): the first page with a payload is a response, later ones revisit it.

    Null html is an empty payload; a null url gives no target; rows with a null page_id are left out of
    the search for equal payloads and stay responses; a repeated row of the first page is a response again.
    Groups of equal payloads may hold any share of the rows: their first page is found with partial
    aggregation, and the join back deals each group over as many keys as the largest needs for ``rows_per_salt`` rows a key.
    A record is one row, so a payload must fit into a task; columns other than the three are ignored.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    first = (
        p.where((F.col("payload_length") >= min_revisit_bytes) & F.col("page_id").isNotNull())
        .groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    )
    most = first.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    n_salts = max(1, -(-most // rows_per_salt))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(n_salts)).cast("int"))
    j = p.join(first.select("sha", "first_id", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))).alias("salt")), ["sha", "salt"], "left")
    revisit = F.coalesce(F.col("first_id") != F.col("page_id"), F.lit(False))
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))
    return j.select(
        F.coalesce(_record_id(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), "sha", F.lit(">"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(FIXED_DATE).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        digest.alias("payload_digest"),
        F.when(revisit, _record_id(F.col("first_id"))).alias("refers_to"),
        F.when(revisit, PROFILE).alias("profile"),
        F.lit(200).alias("http_status"),
        F.col("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True, verify: bool = True, verify_all: bool = False) -> DataFrame:
    """Records of the archives.  ``verify``: payloads that are returned must have their digests; ``verify_all``: so must those that are not."""
    register(spark)
    options = {"payload": payload, "verify": verify, "verifyAll": verify_all}
    return spark.read.format("warc").options(**{k: str(v).lower() for k, v in options.items()}).load(path)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and describe each from what is read back; every payload is inflated and its digest verified."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(to_records(pages, min_revisit_bytes), path)
    back = read_archives(spark, path, payload=False, verify_all=True)
    return back.select(
        F.when(F.col("record_id").startswith("<urn:uuid:"), page_id_of(F.col("record_id"))).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        F.col("record_type"),
        page_id_of(F.col("refers_to")).alias("refers_to"),
    )
