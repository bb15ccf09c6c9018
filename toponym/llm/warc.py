"""Web archives (WARC 1.1) as a Spark data source.

Writing: each task writes its own archives, a gzip member per record; each commit lists its finished ones in a manifest of its own, so what a
lost or repeated task left behind is never read, and what is appended stands beside what was written before. A commit that overwrites
removes the older manifests and their archives once its own is written. The member header tells the member's length (extra field `sl`).

Reading: the driver plans partitions of whole files of about PARTITION bytes. Predicates on record_type, record_id, target_uri, refers_to and payload_digest are
pushed down; a reader inflates a record up to the end of its headers, tests them, and jumps over the rest of a record that is
not wanted. With option `payload` = `false` no payload is inflated. Archives of other programs are read too: uncompressed, or gzip members without
that field, which have to be inflated to find their end. A SHA-1 digest is given as bare lower-case hexadecimal digits however it is written; other digests stay as they are. A response
without an end of its HTTP headers has no payload.

Null urls have no target header. Null payloads are empty. Rows that repeat an id are records of their own. An empty table
writes no record and reads as an empty table; a record that cannot be parsed raises an error.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .filters import may_be_in

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Columns whose predicates a reader tests on the headers.
PUSHED = {"record_type", "record_id", "target_uri", "refers_to", "payload_digest"}
#: Bytes after which a task begins another archive, and that a read partition holds.
ROLL = 128 << 20
PARTITION = 64 << 20
#: A manifest is named MANIFEST-<uuid>.json; `_manifest.json` is that of an older version.
MANIFEST = "_manifest"
#: Payload bytes of one Arrow batch, and how much is read at a time.
BATCH = 8 << 20
STEP = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Equal payloads of at least so many bytes are written once.
LEAST_REVISIT = 1000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifests(system: fs.FileSystem, base: str) -> list[str]:
    """Paths of the manifests of all commits."""
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.base_name.startswith((f"{MANIFEST}-", f"{MANIFEST}.")) and x.base_name.endswith(".json"))


def _listed(system: fs.FileSystem, manifest: str) -> list[tuple[str, int]]:
    with system.open_input_stream(manifest, compression=None) as f:
        return [(name, size) for name, size in json.loads(f.read())]


def member(data: bytes) -> bytes:
    """A gzip member whose header tells its own length and that of the data."""
    pack = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(data)) >> 32:  # the field has 32 bits; without it the record is read to its end
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def bare_digest(digest: str | None) -> str | None:
    """A SHA-1 digest, in base 32 or hexadecimal, as lower-case hexadecimal digits; any other as it is."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() == "sha1" and re.fullmatch("[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    if kind.lower() == "sha1" and re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    return digest


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, digest: str, payload_bytes: int, payload: bytes) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"Content-Length: {len(block)}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        files, out, name, size = [], None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(row["record_type"], row["record_id"], row["target_uri"], row["refers_to"], row["payload_digest"], row["payload_bytes"], row["payload"] or b""))
                out.write(data)
                size += len(data)
                if size >= ROLL:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages: list) -> None:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        older = _manifests(system, base) if self.overwrite else []
        # a reader must not find half a manifest: the name comes last
        name = f"{MANIFEST}-{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{base}/{name}.new", compression=None) as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        system.move(f"{base}/{name}.new", f"{base}/{name}")
        for manifest in older:
            archives = _listed(system, manifest)
            system.delete_file(manifest)
            for archive, _ in archives:
                system.delete_file(f"{base}/{archive}")

    def abort(self, messages: list) -> None:
        system, base = _open(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            system.delete_file(f"{base}/{name}")


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Member:
    """A record being read from a stream: headers first, the rest on demand."""

    def __init__(self, f: BinaryIO, start: int):
        self.f, self.start, self.end, self.zip, self.data = f, start, None, None, b""
        f.seek(start)
        first = f.read(STEP)
        self.there = bool(first)
        if first[:2] == b"\x1f\x8b":
            if first[3] & 4 and first[12:14] == b"sl":
                self.end = start + struct.unpack("<I", first[16:20])[0]
            self.zip = zlib.decompressobj(31)
        self._take(first)

    def _take(self, raw: bytes) -> None:
        self.data += self.zip.decompress(raw) if self.zip else raw

    def need(self, n: int) -> None:
        """At least n bytes of the record, if it has them."""
        while len(self.data) < n and not (self.zip and self.zip.eof):
            raw = self.f.read(max(STEP, (n - len(self.data)) // (4 if self.zip else 1)))
            if not raw:
                return
            self._take(raw)

    def headers(self) -> dict[str, str]:
        at = self.data.find(b"\r\n\r\n")
        while at < 0:
            size = len(self.data)
            self.need(size + 1)
            if len(self.data) == size:
                raise ValueError(f"no end of headers in the record at byte {self.start}")
            at = self.data.find(b"\r\n\r\n", max(0, size - 3))
        self.body = at + 4
        lines = self.data[:at].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {self.start}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def next(self, length: int) -> int:
        """Where the next record starts."""
        if self.zip is None:
            return self.start + self.body + length + 4
        if self.end is None:
            self.need(self.body + length + 5)
            while not self.zip.eof:
                raw = self.f.read(STEP)
                if not raw:
                    break
                self._take(raw)
            self.end = self.f.tell() - len(self.zip.unused_data)
        return self.end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path.rstrip("/"), payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1 and column[0] in PUSHED and isinstance(f, EqualTo | In | IsNotNull | StringStartsWith):
                self.filters.append((column[0], type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, base = _open(self.path)
        manifests = _manifests(system, base)
        if manifests:
            found = [(f"{base}/{name}", size) for m in manifests for name, size in _listed(system, m)]
        else:
            found = [(x.path, x.size) for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        parts, now, size = [], [], 0
        for name, n in sorted(found):
            if now and size + n > PARTITION:
                parts.append(_Files(now))
                now, size = [], 0
            now.append(name)
            size += n
        return [*parts, _Files(now)]

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.filters:
            own = row[column]
            if own is None or kind == "EqualTo" and own != value or kind == "In" and own not in value or kind == "StringStartsWith" and not own.startswith(value):
                return False
        return True

    def records(self, files: list[str]) -> Iterator[dict]:
        system, _ = _open(self.path)
        for name in files:
            with system.open_input_file(name) as f:
                at = 0
                while (m := _Member(f, at)).there:
                    head = m.headers()
                    length = int(head["content-length"])
                    digest = head.get("warc-payload-digest")
                    bare = lambda x: x and x.strip("<>")
                    row = {"record_type": head.get("warc-type"), "record_id": bare(head.get("warc-record-id")), "target_uri": head.get("warc-target-uri"), "refers_to": bare(head.get("warc-refers-to"))}
                    row["payload_digest"] = bare_digest(digest)
                    if self.wanted(row):
                        yield row | self.content(m, length, head)
                    at = m.next(length)

    def content(self, m: _Member, length: int, head: dict[str, str]) -> dict:
        """payload_bytes, and the payload if it is asked for."""
        if not head.get("content-type", "").startswith("application/http"):
            if self.payload:
                m.need(m.body + length)
            return {"payload_bytes": length, "payload": m.data[m.body : m.body + length] if self.payload else None}
        past = m.data.find(b"\r\n\r\n", m.body)
        while past < 0 and len(m.data) < m.body + length:
            m.need(min(len(m.data) + STEP, m.body + length))
            past = m.data.find(b"\r\n\r\n", m.body)
        if not m.body <= past <= m.body + length - 4:
            past = m.body + length - 4
        http = m.data[m.body : past].decode("latin-1").lower()
        told = next((int(x.partition(":")[2]) for x in http.split("\r\n") if x.startswith("content-length:")), None)
        own = m.body + length - past - 4
        if not self.payload or head.get("warc-type") == "revisit":
            return {"payload_bytes": own if told is None else told, "payload": None}
        m.need(m.body + length)
        return {"payload_bytes": own, "payload": m.data[past + 4 : m.body + length]}

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        names = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for row in self.records(partition.files):
            rows.append(row)
            size += len(row["payload"] or b"") + 200
            if size >= BATCH:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """format("warc"); options: path, and payload (`false`: headers only)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known to the session, with filter push-down for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


URN = "urn:x-page:"


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """A record per page. Of pages with equal payloads of at least `least` bytes, that with the largest key is the response and others revisit it.

    Only pages whose digest occurs more than once are shuffled.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("target_uri"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"), payload.alias("payload"))
    big = rows.where(F.col("payload_bytes") >= least)
    first = big.groupBy("payload_digest").agg(F.max("key").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "keeper")
    marked = may_be_in(rows, first, "payload_digest")
    may = F.col("may") & (F.col("payload_bytes") >= least)
    single = marked.where(~may).withColumn("keeper", F.lit(None).cast(pages.schema[key].dataType))
    several = marked.where(may).join(first, "payload_digest", "left")
    every = single.unionByName(several)
    revisit = F.col("keeper").isNotNull() & ~F.col("key").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit(URN), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return every.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("key").alias("record_id"), "target_uri", F.when(revisit, urn("keeper")).alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def read_pages(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): responses from their payloads, revisits from headers alone."""
    key = lambda c: F.expr(f"try_cast(substring({c}, {len(URN) + 1}) AS {key_type})")
    whole = spark.read.format("warc").load(path).where("record_type = 'response'")
    heads = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    responses = whole.select(key("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast(key_type).alias("refers_to"))
    revisits = heads.select(key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)
