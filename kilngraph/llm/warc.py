"""WARC records in ZIP archives, written per task and read back by range without extraction.

Writing: each task streams its records into archives in the shared work folder.  An archive holds pairs of stored (not
compressed) members, ``data-N.warc.gz`` with one gzip member per record and ``data-N.idx`` with a line per record: offset
and length inside its data member.  Archives are named by a random id and count only through the manifest that the
successful task returns, so files of failed attempts are never read.

Reading: a task opens an archive, reads its tail for the end-of-central-directory record (and the ZIP64 one where a field
is saturated), parses the central directory, finds each member's data behind its local header, and range-reads the
indexes and then the records.  The archive is never held as a whole.

Record types: of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is a
response and the others revisit it.  Defined cases: a null html is the empty payload; a null page_id ranks lowest and is
kept; of rows that repeat page_id and payload exactly one is the response; a null url becomes a urn; an empty table gives
no archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.llm.storage import materialise, new_folder

#: Uncompressed bytes after which a member, and compressed bytes after which an archive, is closed.
MEMBER_BYTES, ARCHIVE_BYTES = 8_000_000, 256_000_000
LEAST_BYTES = 0
#: Payloads that at least this share of the rows have are joined map-side, so as many at most are broadcast.
HEAVY_PAYLOADS = 1024
WARC_DATE = "2024-01-01T00:00:00Z"

# Fixed values of the ZIP format: signatures, struct layouts and saturated fields.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FMT, CENTRAL_FMT, END_FMT, END64_FMT, LOCATOR64_FMT = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH", "<4sQ2H2I4Q", "<4sIQI"
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1


def payload_sha1(html: Column) -> Column:
    """SHA-1 of the UTF-8 payload; a null payload counts as empty."""
    return F.unhex(F.sha1(F.coalesce(html, F.lit("")).cast("binary")))


# --- ZIP ---------------------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members to a sequential stream; ZIP64 fields where sizes, offsets or counts need them (or if forced)."""

    def __init__(self, stream, force_zip64: bool = False):
        self.stream, self.force, self.at, self.entries = stream, force_zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start = name.encode(), zlib.crc32(data), self.at
        big = self.force or len(data) >= FULL32
        extra = struct.pack("<2H2Q", EXTRA64, 16, len(data), len(data)) if big else b""
        size = FULL32 if big else len(data)
        self._put(struct.pack(LOCAL_FMT, LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, crc, len(data), start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.entries:
            big_size, big_at = self.force or size >= FULL32, self.force or at >= FULL32
            wide = [size, size] * big_size + [at] * big_at
            extra = struct.pack(f"<2H{len(wide)}Q", EXTRA64, 8 * len(wide), *wide) if wide else b""
            short = FULL32 if big_size else size
            self._put(struct.pack(CENTRAL_FMT, CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, FULL32 if big_at else at) + raw + extra)
        length, n = self.at - start, len(self.entries)
        if self.force or n >= FULL16 or start >= FULL32 or length >= FULL32:
            end64 = self.at
            self._put(struct.pack(END64_FMT, END64, 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack(LOCATOR64_FMT, LOCATOR64, 0, end64, 1))
        self._put(struct.pack(END_FMT, END, 0, 0, min(n, FULL16), min(n, FULL16), min(length, FULL32), min(start, FULL32) if not self.force else FULL32, 0))


@dataclass
class Member:
    name: str
    method: int
    crc: int
    size: int
    packed: int
    header_at: int


class ZipReader:
    """Directory of a ZIP archive over any object with ``size`` and ``read(at, length)``."""

    def __init__(self, source):
        self.source = source
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        size = self.source.size
        tail_at = max(0, size - 22 - FULL16)
        tail = self.source.read(tail_at, size - tail_at)
        at = tail.rfind(END)
        # The mark may also occur inside the archive's comment; only the real record's comment ends with the file.
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end-of-central-directory record")
        *_, n, length, start, _ = struct.unpack_from(END_FMT, tail, at)
        where = tail_at + at
        if where >= 20 and (n == FULL16 or length == FULL32 or start == FULL32):
            mark, _, end64, _ = struct.unpack(LOCATOR64_FMT, self.source.read(where - 20, 20))
            if mark == LOCATOR64:
                mark, *_, n, length, start = struct.unpack(END64_FMT, self.source.read(end64, 56))
                if mark != END64:
                    raise ValueError("broken ZIP64 end record")
        data, p = self.source.read(start, length), 0
        for _ in range(n):
            mark, _, _, _, method, _, _, crc, packed, full, n_name, n_extra, n_note, _, _, _, header = struct.unpack_from(CENTRAL_FMT, data, p)
            if mark != CENTRAL:
                raise ValueError("broken central directory")
            p += 46
            name, extra = data[p : p + n_name].decode(), data[p + n_name : p + n_name + n_extra]
            p += n_name + n_extra + n_note
            full, packed, header = self._wide(extra, full, packed, header)
            yield Member(name, method, crc, full, packed, header)

    @staticmethod
    def _wide(extra: bytes, full: int, packed: int, header: int) -> tuple[int, int, int]:
        p = 0
        while p + 4 <= len(extra):
            kind, length = struct.unpack_from("<2H", extra, p)
            if kind == EXTRA64:
                values = iter(struct.unpack_from(f"<{length // 8}Q", extra, p + 4))
                full, packed, header = (next(values) if x == FULL32 else x for x in (full, packed, header))
            p += 4 + length
        return full, packed, header

    def data_at(self, member: Member) -> int:
        """Where a stored member's bytes begin: its local header has name and extra lengths of its own."""
        if member.method != 0:
            raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
        mark, *_, n_name, n_extra = struct.unpack(LOCAL_FMT, self.source.read(member.header_at, 30))
        if mark != LOCAL:
            raise ValueError(f"no local header for {member.name}")
        return member.header_at + 30 + n_name + n_extra


class RangeFile:
    """Ranged reads of a file in any store that the executors reach."""

    def __init__(self, path: str):
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        self.size = self.file.size()

    def read(self, at: int, length: int) -> bytes:
        return self.file.read_at(length, at)

    def close(self) -> None:
        self.file.close()


# --- WARC --------------------------------------------------------------------------------------------------------


def record_id(page_id: Any) -> str:
    """The record's name: the id percent-encoded, so that any text comes back; a null id has a form that no id takes."""
    return "<urn:nopage>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(urn: str) -> str | None:
    return None if urn == "<urn:nopage>" else unquote(urn.removeprefix("<urn:page:").removesuffix(">"))


def warc_record(page_id: Any, url: str | None, payload: bytes, digest: str, refers_to: tuple[Any] | None) -> bytes:
    """A response with its payload, or a revisit (``refers_to`` is the response's page) with the HTTP header alone."""
    target = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url else record_id(page_id).strip("<>")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to[0])}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict[str, Any]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and the payload (None in a revisit).

    A response's payload is measured and hashed again; a mismatch with its headers is an error.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if not version.startswith("WARC/") or kind == "response" and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": page_of(fields["WARC-Record-ID"]), "payload_bytes": stated, "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": payload if kind == "response" else None}


def _write(folder: str, member_bytes: int, archive_bytes: int, force_zip64: bool):
    """Streams a task's rows into archives; yields one manifest row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: ZipWriter | None = None
        fs, inner = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(inner, recursive=True)
        data, index, raw, members, records, name = [], [], 0, 0, 0, ""

        def flush() -> None:
            nonlocal data, index, raw, members
            if data:
                out.add(f"data-{members:06d}.warc.gz", b"".join(data))
                out.add(f"data-{members:06d}.idx", "".join(index).encode())
                data, index, raw, members = [], [], 0, members + 1

        def close() -> pa.RecordBatch:
            nonlocal out
            flush()
            out.close()
            out.stream.close()
            out = None
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([records], pa.int64())})

        offset = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url")), batch.column("html").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("sha1", "revisit", "refers_to")), strict=True):
                page_id, url, html, sha1, revisit, refers_to = row
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zip"
                    out, members, records = ZipWriter(fs.open_output_stream(f"{inner}/{name}"), force_zip64), 0, 0
                record = warc_record(page_id, url, html or b"", base64.b32encode(sha1).decode(), (refers_to,) if revisit else None)
                packed = gzip.compress(record, 3, mtime=0)
                offset = 0 if not data else offset
                data.append(packed)
                index.append(f"{offset} {len(packed)}\n")
                offset += len(packed)
                raw += len(record)
                records += 1
                if raw >= member_bytes:
                    flush()
                    if out.at >= archive_bytes:
                        yield close()
        if out is not None:
            yield close()

    return run


def read_archive(source) -> Iterator[dict[str, Any]]:
    """Every record of one archive, found through its indexes and read by range."""
    archive = ZipReader(source)
    for name, member in archive.members.items():
        if not name.endswith(".idx"):
            continue
        lines = source.read(archive.data_at(member), member.size).decode().splitlines()
        base = archive.data_at(archive.members[name.removesuffix(".idx") + ".warc.gz"])
        for line in lines:
            offset, length = map(int, line.split())
            yield parse_record(gzip.decompress(source.read(base + offset, length)))


def _read(id_type: pa.DataType, with_payload: bool, batch_rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[dict[str, Any]]) -> pa.RecordBatch:
            cols = {c: pa.array([r[c] for r in rows], pa.string()).cast(id_type) for c in ("page_id", "refers_to")}
            cols |= {"payload_bytes": pa.array([r["payload_bytes"] for r in rows], pa.int64())}
            cols |= {c: pa.array([r[c] for r in rows], pa.string()) for c in ("payload_digest", "record_type")}
            if with_payload:
                cols["payload"] = pa.array([r["payload"] for r in rows], pa.binary())
            return pa.RecordBatch.from_pydict({c: cols[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload)})

        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, rows = RangeFile(path), []
                for record in read_archive(source):
                    rows.append(record)
                    if len(rows) >= batch_rows:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)
                source.close()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least_bytes: int = LEAST_BYTES, member_bytes: int = MEMBER_BYTES, archive_bytes: int = ARCHIVE_BYTES, force_zip64: bool = False) -> DataFrame:
    """Write all pages; returns the manifest (path, records), itself a written table."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).withColumn("sha1", payload_sha1(F.col("html")))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    groups = materialise(rows.select("page_id", "sha1", size.alias("bytes")), "warc-payloads")
    # One row per payload that is shared by several rows: the response's page, and how many rows repeat that very page.
    groups = groups.where(F.col("bytes") >= least_bytes).groupBy("sha1", "page_id").agg(F.count("*").alias("same"))
    groups = groups.groupBy("sha1").agg(F.sum("same").alias("rows"), F.max(F.struct("page_id", "same")).alias("top")).where("rows > 1")
    groups = materialise(groups.select(F.col("sha1").alias("group_sha1"), "rows", F.col("top.page_id").alias("top_id"), F.col("top.same").alias("top_rows"), F.lit(True).alias("shared")), "warc-groups")
    joined = _with_groups(rows, groups)
    is_top = F.col("page_id").eqNullSafe(F.col("top_id"))
    once = joined.where(F.col("shared").isNull() | (F.col("top_rows") == 1) | ~is_top).withColumn("revisit", F.col("shared").isNotNull() & ~is_top)
    # Rows that repeat the response's page exactly: one of them stays the response.  Usually there are none.
    again = rows.join(groups.where("top_rows > 1"), F.col("sha1") == F.col("group_sha1")).where(is_top)
    again = again.withColumn("revisit", F.row_number().over(Window.partitionBy("sha1").orderBy(F.lit(0))) > 1)
    refers_to = F.when(F.col("revisit"), F.col("top_id")).alias("refers_to")
    once, again = (part.select("page_id", "url", "html", "sha1", "revisit", refers_to) for part in (once, again))
    both = once.unionByName(again)
    manifest = both.mapInArrow(_write(new_folder(spark, "warc"), member_bytes, archive_bytes, force_zip64), "path string, records long")
    return materialise(manifest, "warc-manifest")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the columns of their group, null without one; no task gathers the rows of a frequent payload."""
    least = max(2, -(-(groups.agg(F.sum("rows")).first()[0] or 0) // HEAVY_PAYLOADS))
    heavy, light = groups.where(F.col("rows") >= least), groups.where(F.col("rows") < least)
    found = rows.join(F.broadcast(heavy), F.col("sha1") == F.col("group_sha1"), "left")
    # Rows that have their group meet no light one: they are spread by a key of their own.
    names = [c for c in groups.columns if c != "group_sha1"]
    light = light.select("group_sha1", *(F.col(c).alias(f"light_{c}") for c in names)).withColumnRenamed("group_sha1", "light_sha1")
    key = F.when(F.col("shared").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("-"), F.col("page_id").cast("string")).cast("binary"))
    found = found.join(light, key == F.col("light_sha1"), "left")
    return found.select(*rows.columns, *(F.coalesce(c, f"light_{c}").alias(c) for c in names))


def read_archives(manifest: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """The records of the manifest's archives, one task per group of archives."""
    spark = manifest.sparkSession
    arrow_id = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    kinds = f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}" + ", payload binary" * with_payload
    parts = max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism))
    return manifest.select("path").repartition(parts).mapInArrow(_read(arrow_id, with_payload), kinds)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives and read them back."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archives(write_archives(pages), kind)
