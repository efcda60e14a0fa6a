"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts an archive.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, in which every WARC record is a gzip
member of its own, and ``indexes/index.cdxj``, one line per record with its place in the former. The reader looks
for the end-of-central-directory record at the file's end (and the ZIP64 locator and record before it), parses the
central directory with its ZIP64 extra fields, finds the stored members by their local headers, reads the index, and
deals ranges of whole records to tasks, which read just those bytes.

Of records with equal payloads of at least ``least_bytes`` the one with the smallest page id holds the payload
(``response``), all others refer to it (``revisit``, with the HTTP head of the whole payload). Smaller payloads are always written.

Tasks write archives of about ``ARCHIVE_BYTES`` to the shared folder, under a name of the attempt, and the names that
count are those in a written table; an attempt that was lost leaves a file that nobody reads.
A task holds one record and the index of one archive while it writes, and one range of records while it reads.

Results in special cases: a null page is an empty payload; a null id is written without one, read back as null, and
never referred to (equal payloads under null ids only are all responses); a null URL leaves its field out; control
signs of a URL are percent-encoded; rows that repeat an id with one payload are responses all; payloads are compared by
SHA-256; an empty table makes no archive and an empty result. A record whose payload doesn't fit its digest, a
compressed member and a file cut short are errors. Other columns aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.skew import salted_join
from wayloom.session import materialize, scratch_path

LEAST_BYTES = 100
#: Bytes of records after which a task begins the next archive.
ARCHIVE_BYTES = 256 << 20
#: Bytes of records that a reading task is dealt at once.
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the formats.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _open(path: str) -> tuple[pa_fs.FileSystem, str]:
    """File system and inner path of a local path or URI that all executors reach."""
    if "://" not in path and not path.startswith("file:"):
        return pa_fs.LocalFileSystem(), path
    if urlsplit(path).scheme == "file":
        return pa_fs.LocalFileSystem(), urlsplit(path).path
    return pa_fs.FileSystem.from_uri(path)


# --- writing ---------------------------------------------------------------------------------------------------


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _of_uri(text: str | None) -> int | None:
    inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: head, block and end."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _uri(page_id),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        fields["WARC-Target-URI"] = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)
    if revisit:
        fields |= {"WARC-Refers-To": _uri(refers_to), "WARC-Profile": PROFILE}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


class _Archive:
    """An archive that is being written; records go to the file as they come, index lines are kept."""

    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip"
        fs, inner = _open(self.path)
        fs.create_dir(os.path.dirname(inner), recursive=True)
        self.file = fs.open_output_stream(inner, compression=None)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(DATA, "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, kind: str, packed: bytes) -> None:
        self.lines.append(json.dumps({"offset": self.size, "length": len(packed), "id": page_id, "type": kind}))
        self.member.write(packed)
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            for line in self.lines:
                f.write(line.encode() + b"\n")
        self.zip.close()
        self.file.close()
        return self.path, len(self.lines), self.size


def with_references(pages: DataFrame, page_id: str, html: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``id, url, payload, digest, refers_to``: ``refers_to`` is the smallest id with an equal payload, where that is another.

    Only digests that occur twice take part in a join; the pages themselves are not shuffled where these are few,
    and copies of one payload, however many, are spread where they are not.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.withColumn("payload", payload).withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.length("payload") >= least_bytes)
    least = long.groupBy("digest").agg(F.min(page_id).alias("first"), F.count(F.lit(1)).alias("n"))
    least = materialize(least.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "copies")
    # Some 100 bytes each; beyond, hot digests are salted.
    if least.count() <= 200_000:
        joined = rows.join(F.broadcast(least), "digest", "left")
    else:
        joined = salted_join(rows, least, ["digest"], [page_id], "left")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col(page_id))
    return joined.withColumn("refers_to", F.when(other, F.col("first"))).drop("first")


def write(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES,
    folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write every page to an archive below ``folder`` (by default a new one in the shared folder); rows ``path,
    records, bytes`` of the archives, as a written table."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    rows = with_references(rows, "id", "html", least_bytes).select("id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for b in batches:
            for page, link, payload, digest, first in zip(*b.columns):
                page, first, digest = page.as_py(), first.as_py(), digest.as_py()
                archive = archive or _Archive(folder)
                kind = "response" if first is None else "revisit"
                raw = record(page, link.as_py(), payload.as_py(), digest, first, first is not None)
                archive.add(page, kind, gzip.compress(raw, 4, mtime=0))
                if archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        columns = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "records", "bytes"])

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


# --- reading ---------------------------------------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    method: int  # 0: stored
    size: int
    header: int  # place of its local header


def _at(file: BinaryIO, place: int, n: int) -> bytes:
    file.seek(place)
    out = file.read(n)
    if len(out) < n:
        raise ValueError("the archive is cut short")
    return out


def directory(file: BinaryIO, size: int) -> list[Member]:
    """Members of a ZIP file by its central directory."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = _at(file, tail_at, size - tail_at)
    end = tail.rfind(END)
    # A comment may hold the mark; the true record's comment reaches the end of the file.
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, place = struct.unpack_from("<HII", tail, end + 10)
    before = tail_at + end - 20
    if before >= 0 and (locator := _at(file, before, 20))[:4] == LOCATOR64:
        record64 = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record64[:4] != END64:
            raise ValueError("the ZIP64 locator leads nowhere")
        count, length, place = struct.unpack_from("<QQQ", record64, 32)
    raw, at, out = _at(file, place, length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header, = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that overflow, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        out.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def content_place(file: BinaryIO, member: Member) -> int:
    """First byte of a stored member's content."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read in ranges")
    local = _at(file, member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


def ranges(path: str, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[str, int, list[int]]]:
    """Ranges of whole records of an archive: path, first byte in the file, length of each record."""
    fs, inner = _open(path)
    with fs.open_input_file(inner) as file:
        members = {m.name: m for m in directory(file, file.size())}
        data, index = content_place(file, members[DATA]), content_place(file, members[INDEX])
        lines = _at(file, index, members[INDEX].size).splitlines()
    begin, lengths, held = 0, [], 0
    for line in lines:
        entry = json.loads(line)
        if not lengths:
            begin = entry["offset"]
        lengths.append(entry["length"])
        held += entry["length"]
        if held >= range_bytes:
            yield path, data + begin, lengths
            lengths, held = [], 0
    if lengths:
        yield path, data + begin, lengths


def parse(raw: bytes) -> dict:
    """Fields and payload of one record; a revisit has no payload but the length of the one it refers to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't fit its digest")
    return {
        "page_id": _of_uri(fields["WARC-Record-ID"]), "target_uri": fields.get("WARC-Target-URI"), "record_type": kind,
        "payload_bytes": length, "payload_digest": digest, "refers_to": _of_uri(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


_FIELDS = {
    "page_id": pa.int64(), "target_uri": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
}
_TYPES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def read(archives: DataFrame, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives in column ``path``. Archives are dealt to tasks, then ranges of their records."""
    names = columns or list(_FIELDS)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                found = list(ranges(path, range_bytes))
                types = (pa.string(), pa.int64(), pa.list_(pa.int64()))
                arrays = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "begin", "lengths"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin, lengths in zip(*(c.to_pylist() for c in b.columns)):
                fs, inner = _open(path)
                with fs.open_input_file(inner) as file:
                    raw = memoryview(_at(file, begin, sum(lengths)))
                rows, at = [], 0
                for n in lengths:
                    rows.append(parse(zlib.decompress(raw[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _FIELDS[c]) for c in names], names=names)

    # Stated numbers of partitions: by their few bytes, paths and ranges would be merged into one task.
    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    found = materialize(spread.mapInArrow(locate, "path string, begin long, lengths array<long>"), "ranges")
    schema = ", ".join(f"{c} {_TYPES[_FIELDS[c]]}" for c in names)
    return found.repartition(min(max(1, found.count()), 100_000), "path", "begin").mapInArrow(fetch, schema)


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM q
"""


def query(pages: DataFrame) -> DataFrame:
    found = read(write(pages), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
