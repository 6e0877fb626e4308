"""WARC archives as a Python data source of Spark: ``format("warc")`` reads and writes them.

Writing makes one gzip member per record and stores the member's length in its header (extra field ``sl``).
Tasks write files of their own; ``_manifest.json``, written once all tasks are done, names those that count, so
a lost or repeated task leaves nothing behind that is read.

Reading plans one partition per file (the writer starts a new file at ``max_file_mb``). Filters on the record type and other
header columns are pushed down: the reader inflates the start of a member, parses the headers, and goes on
to the next member without inflating the payload if a filter fails or no payload is wanted. A payload is
wanted if the schema of the read has ``payload`` or the option ``verify`` is true (its length and
SHA-1 are then compared with the headers). Archives without ``sl``, and ones that are not compressed, are read too.

Cases: a null page id gives a record id without number; a null url gives no target; line ends in a url are
percent-encoded; an empty table writes a manifest alone; a folder without a manifest is read file by file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from postloom.llm.common import few, materialise, query, small_batches, table
from postloom.session import shared_dir

SCHEMA = ("record_id string, record_type string, target_uri string, record_date string, payload_digest string, "
          "refers_to string, payload_length long, payload binary")
#: Payloads shorter than this are stored as they are, however often they occur.
LEAST_REVISIT = 1000
MANIFEST = "_manifest.json"
DATE = "1970-01-01T00:00:00Z"
WINDOW = 1 << 22
HEAD = 1 << 12
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
#: Columns that the record's own headers give; filters on them are pushed down.
_HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "record_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def _open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def _record(row: dict) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>",
             f"WARC-Date: {row.get('record_date') or DATE}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + row["target_uri"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["payload_digest"]:
        lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode())
    if row["refers_to"]:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n"
    block = http.encode() + (row["payload"] or b"")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, most: int) -> None:
        self.path, self.overwrite, self.most = path, overwrite, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open_folder(self.path)
        store.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.most:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = _gzip_member(_record(row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open_folder(self.path)
        store.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        if not self.overwrite:
            files = sorted({*_listed(store, root), *files})
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open_folder(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/{f}")


def _listed(store: fs.FileSystem, root: str) -> list[str]:
    """Files that count: those of the manifest, or all archives of a folder without one, or the file itself."""
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [""]
    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        with store.open_input_stream(f"{root}/{MANIFEST}", compression=None) as file:
            return json.loads(file.read())
    if info.type != fs.FileType.Directory:
        return []
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(x.path[len(root) + 1:] for x in found if x.path.endswith((".warc", ".warc.gz")))


class _Window:
    """A file read forwards through a buffer; ``skip`` seeks."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.data, self.at = file, b"", 0

    def peek(self, n: int) -> bytes:
        if len(self.data) - self.at < n:
            self.data, self.at = self.data[self.at:] + self.file.read(max(n, WINDOW)), 0
        return self.data[self.at:self.at + n]

    def skip(self, n: int) -> None:
        left = len(self.data) - self.at
        if n <= left:
            self.at += n
        else:
            self.file.seek(self.file.tell() + n - left)
            self.data, self.at = b"", 0

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.skip(len(out))
        return out


class _Member:
    """One record: its first bytes at once, the rest only on demand."""

    def __init__(self, window: _Window) -> None:
        self.window = window
        start = window.peek(24)
        self.packed = start[:2] == b"\x1f\x8b"
        self.size = struct.unpack("<I", start[16:20])[0] if self.packed and start[3] & 4 and start[12:14] == b"sl" else 0
        self.unpack = zlib.decompressobj(31)
        self.data, self.read = b"", 0
        self.more(HEAD)

    def more(self, want: int) -> bool:
        """Inflate until ``want`` bytes are there; whether they are."""
        while len(self.data) < want:
            if not self.packed:
                self.data = self.window.peek(want)
                return len(self.data) >= want
            if self.unpack.eof:
                return False
            pending = self.unpack.unconsumed_tail
            if not pending:
                pending = self.window.take(min(1 << 16, self.size - self.read) if self.size else 1 << 16)
                self.read += len(pending)
                if not pending:
                    raise EOFError("a record ends before its gzip member does")
            self.data += self.unpack.decompress(pending, want - len(self.data))
        return True

    def until(self, mark: bytes, start: int = 0) -> int:
        """End of the next ``mark``, or -1."""
        size = max(HEAD, start)
        while True:
            at = self.data.find(mark, start)
            if at >= 0:
                return at + len(mark)
            size *= 2
            if not self.more(size) and self.data.find(mark, start) < 0:
                return -1

    def end(self, length: int) -> None:
        """Go to the next record; ``length``: bytes of this one when it is not compressed."""
        if not self.packed:
            self.window.skip(length)
        elif self.size:
            self.window.skip(self.size - self.read)
        else:
            while not self.unpack.eof:
                self.data = b""
                self.more(WINDOW)
            rest = self.unpack.unused_data
            self.window.data, self.window.at = rest + self.window.data[self.window.at:], 0


def _fields(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _hex_digest(label: str | None) -> str | None:
    """Bare lower-case hex of a ``sha1:`` label in base 32 or hex."""
    if not label or not label.lower().startswith("sha1:"):
        return label
    value = label[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _columns(fields: dict[str, str]) -> dict[str, str | None]:
    row = {c: fields.get(h) for c, h in _HEADER.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c].strip("<>") if row[c] else row[c]
    row["payload_digest"] = _hex_digest(row["payload_digest"])
    return row


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, verify: bool) -> None:
        self.path, self.verify = path, verify
        self.names = schema.fieldNames()
        self.arrow = pa.schema([(f.name, _KINDS[f.dataType.simpleString()]) for f in schema.fields])
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in _HEADER:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, str):
                self.wanted.append((column, "in", (f.value,)))
            elif isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.wanted.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((column, "starts", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((column, "there", ()))
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        store, root = _open_folder(self.path)
        return [WarcFile(f) for f in _listed(store, root)]

    def _keeps(self, row: dict) -> bool:
        return all(row[c] is not None and (kind == "there" or kind == "in" and row[c] in values
                                           or kind == "starts" and row[c].startswith(values)) for c, kind, values in self.wanted)

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, root = _open_folder(self.path)
        rows, size = [], 0
        with store.open_input_file(f"{root}/{partition.path}".rstrip("/")) as file:
            window = _Window(file)
            while window.peek(4):
                row = self._next(window)
                if row is not None:
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                if len(rows) >= 4096 or size > 1 << 23:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], self.arrow.field(n).type) for n in self.names],
                                          schema=self.arrow)

    def _next(self, window: _Window) -> dict | None:
        """The next record if it passes the filters; its payload is inflated only if it is wanted."""
        member = _Member(window)
        head = member.until(b"\r\n\r\n")
        if head < 0 or not member.data.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        fields = _fields(member.data[:head])
        block = int(fields.get("content-length", 0))
        row: dict | None = _columns(fields)
        if not self._keeps(row):
            row = None
        elif "payload_length" in self.names or "payload" in self.names or self.verify:
            start, length = head, block
            if fields.get("content-type", "").startswith("application/http"):
                start = member.until(b"\r\n\r\n", head)
                if start < 0:
                    raise ValueError("no end of the HTTP headers of a record")
                length = int(_fields(member.data[head:start]).get("content-length", head + block - start))
            row["payload_length"] = length
            if row["record_type"] != "revisit" and ("payload" in self.names or self.verify):
                member.more(head + block)
                row["payload"] = member.data[start:head + block]
                if self.verify and (len(row["payload"]) != length
                                    or row["payload_digest"] not in (None, hashlib.sha1(row["payload"]).hexdigest())):
                    raise ValueError(f"the payload of {row['record_id']} differs from its headers")
                if "payload" not in self.names:
                    del row["payload"]
        member.end(head + block + 4)
        return row


class WarcDataSource(DataSource):
    """Options: ``path``; ``verify`` (read); ``max_file_mb`` (write, 256)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("verify", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("max_file_mb", 256)) << 20)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session and let Spark push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def record_decisions(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records of ``pages`` in the columns of SCHEMA: of equal payloads the one with the largest id is stored.

    Only digests that occur more than once are gathered, combined before the shuffle; a small table of them
    is broadcast after it has been counted.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hashed = small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"),
                          F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_length"))
    twice = hashed.filter(F.col("payload_length") >= least).groupBy("payload_digest").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND keeper IS NOT NULL")
    repeated = few(materialise(twice.select(F.col("payload_digest").alias("digest"), "keeper"), "warc-repeated"))
    joined = hashed.join(repeated, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_length") >= least), "left")
    revisit = F.coalesce(F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id")), F.lit(False))

    def name(c: str):
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))

    return joined.select(
        name("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit(DATE).alias("record_date"), "payload_digest",
        F.when(revisit, name("keeper")).alias("refers_to"), "payload_length", F.when(~revisit, F.col("payload")).alias("payload"))


@query("op10_warc", """
WITH sized AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
kept AS (SELECT digest, max(page_id) AS keeper FROM sized WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, sized.digest AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM sized LEFT JOIN kept ON sized.digest = kept.digest AND n >= 1000""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back, each stored payload checked against its headers."""
    register(spark)
    path = shared_dir(spark, "warc")
    record_decisions(table(spark, sf_dir, "pages")).write.format("warc").mode("overwrite").save(path)
    records = spark.read.format("warc").schema(SCHEMA.rsplit(",", 1)[0]).option("verify", "true").load(path)
    number = F.regexp_extract(F.col("record_id"), r"^urn:page:(-?\d+)$", 1)
    origin = F.regexp_extract(F.coalesce("refers_to", F.lit("")), r"^urn:page:(-?\d+)$", 1)
    return records.filter(F.col("record_type").isin("response", "revisit")).select(
        F.nullif(number, F.lit("")).cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        F.nullif(origin, F.lit("")).cast("long").alias("refers_to"))
