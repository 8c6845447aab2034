"""WARC records in ZIP archives, read by range.

An archive has two stored members: ``archive/data.warc.gz`` with the records, each a gzip
member of its own, and ``indexes/index.cdxj`` with a line for each. Of the pages with one payload digest the
one with the smallest id is a response and the others revisit it; payloads shorter than
``revisit_bytes`` are all responses. A revisit carries the HTTP head only, whose
Content-Length is that of the full payload.

The reader never extracts. It finds the end-of-directory record and the ZIP64 one where
there is one, reads the central directory, and takes the index by range; records are
then read in ranges of about ``RANGE_BYTES``, which are dealt over the cluster, and each
response's digest is checked.

Payloads travel to the writer compressed. Archives are rolled at ``roll_bytes`` and named by the attempt that wrote them; only those
in the written manifest count.

Null html is an empty payload. A null url leaves out the target; blanks and control
characters in one are percent-encoded. Rows that repeat the smallest id of a digest are
all responses. A null id is a response; it is nobody's reference. An empty table writes
no archive. Other columns are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from wardlens.llm.files import create, fresh, opened

RANGE_BYTES = 4 << 20
#: Bytes of archives for each task that reads them.
TASK_BYTES = 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"
# Fixed values of the ZIP format: signatures of its directory records.
END, END64, LOCATOR64, ENTRY = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; ``digest`` is base32 SHA-1 of the full payload of ``size`` bytes."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{NAME}{'' if page is None else page}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(0x21, 0x7F)))))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def _base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


@arrow_udf(BinaryType())
def _squeezed(payload: pa.Array) -> pa.Array:
    """Payloads compressed for the way to the writer."""
    return pa.array([pa.compress(raw, codec="zstd", asbytes=True) if raw else raw for raw in payload.to_pylist()], pa.binary())


def _full(squeezed: bytes | None, size: int) -> bytes:
    return pa.decompress(squeezed, decompressed_size=size, codec="zstd", asbytes=True) if squeezed else b""


class _Archive:
    """One archive being written; the records pass straight through."""

    def __init__(self, folder: str):
        self.path = fresh(folder, "pages") + ".zip"
        self.file = create(self.path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, row: dict) -> None:
        digest = _base32(row["digest"])
        raw = record(row["page"], row["url"], _full(row["payload"], row["size"]), row["size"], digest, row["refers_to"])
        raw = gzip.compress(raw, 6, mtime=0)
        self.data.write(raw)
        self.lines.append(json.dumps({"id": row["page"], "offset": self.size, "length": len(raw)}))
        self.size += len(raw)

    def close(self) -> dict:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.file.close()
        return {"path": self.path, "records": len(self.lines), "bytes": self.size}


def write(pages: DataFrame, key: str, url: str, html: str, folder: str, revisit_bytes: int = 0, roll_bytes: int = 256 << 20) -> str:
    """Write the pages below a shared folder; the manifest (a Parquet table) names the archives."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    digest, size = F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), _squeezed(payload).alias("payload"), size, digest)
    first = pages.select(F.col(key).cast("long").alias("page"), digest).groupBy("digest").agg(F.min("page").alias("first"))
    later = (F.col("page") > F.col("first")) & (F.col("size") >= revisit_bytes)
    marked = rows.join(first, "digest").select(
        "page", "url", "digest", "size", F.when(later, F.col("first")).alias("refers_to"), F.when(~F.coalesce(later, F.lit(False)), F.col("payload")).alias("payload")
    )
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive: _Archive | None = None
        for batch in batches:
            for row in batch.to_pylist():
                archive = archive or _Archive(f"{folder}/archives")
                archive.add(row)
                if archive.size >= roll_bytes:
                    yield pa.RecordBatch.from_pylist([archive.close()], schema)
                    archive = None
        if archive is not None:
            yield pa.RecordBatch.from_pylist([archive.close()], schema)

    manifest = f"{folder}/manifest"
    marked.mapInArrow(written, "path string, records long, bytes long").write.parquet(manifest)
    return manifest


def _at(file: pa.NativeFile, begin: int, size: int) -> bytes:
    file.seek(begin)
    return file.read(size)


def members(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Begin and size of each stored member of a ZIP archive, from its directories."""
    total = file.size()
    tail_at = max(total - (22 + 0xFFFF), 0)
    tail = _at(file, tail_at, total - tail_at)
    end = tail.rfind(struct.pack("<I", END))
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(struct.pack("<I", END), 0, end)  # a signature inside the comment
    if end < 0:
        raise ValueError("not a ZIP archive: no end of the central directory")
    count, size, begin = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or begin == 0xFFFFFFFF:
        mark, _, place, _ = struct.unpack("<IIQI", _at(file, tail_at + end - 20, 20))
        if mark != LOCATOR64:
            raise ValueError("ZIP64 locator is missing")
        mark, _, _, _, _, _, _, count, size, begin = struct.unpack("<IQHHIIQQQQ", _at(file, place, 56))
        if mark != END64:
            raise ValueError("ZIP64 end of the central directory is missing")
    directory, at, out = _at(file, begin, size), 0, {}
    for _ in range(count):
        mark, _, _, flags, method, _, _, _, packed, full, names, extra, comment, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if mark != ENTRY:
            raise ValueError("broken central directory")
        name = directory[at + 46 : at + 46 + names].decode()
        more, end_of_more = at + 46 + names, at + 46 + names + extra
        while more + 4 <= end_of_more:
            kind, length = struct.unpack_from("<HH", directory, more)
            if kind == 1:  # the 64-bit values of those fields that are full
                wide = iter(struct.unpack_from(f"<{length // 8}Q", directory, more + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            more += 4 + length
        if method != 0 or flags & 1:
            raise ValueError(f"{name} is compressed or encrypted")
        local_names, local_extra = struct.unpack("<HH", _at(file, header + 26, 4))
        out[name] = header + 30 + local_names + local_extra, packed
        at += 46 + names + extra + comment
    return out


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to ranges of whole records."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with opened(path) as file:
                found = members(file)
                base, (begin, size) = found[DATA][0], found[INDEX]
                lines = [json.loads(line) for line in _at(file, begin, size).decode().split("\n") if line]
            ranges: list[dict] = []
            for line in lines:
                if not ranges or ranges[-1]["size"] >= RANGE_BYTES:
                    ranges.append({"path": path, "begin": base + line["offset"], "size": 0})
                ranges[-1]["size"] += line["length"]
            yield pa.RecordBatch.from_pylist(ranges, pa.schema([("path", pa.string()), ("begin", pa.int64()), ("size", pa.int64())]))


def unzipped(raw: bytes) -> Iterator[bytes]:
    """The records of a range of gzip members."""
    while raw:
        member = zlib.decompressobj(31)
        yield member.decompress(raw) + member.flush()
        if not member.eof:
            raise ValueError("a record is cut short")
        raw = member.unused_data


def records(raw: bytes) -> Iterator[dict]:
    """The records of a plain range, their payload digests checked."""
    at = 0
    while at < len(raw):
        body = raw.index(b"\r\n\r\n", at) + 4
        version, *lines = raw[at : body - 4].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("a range does not begin at a record")
        head = dict(line.split(": ", 1) for line in lines)
        end = body + int(head["Content-Length"])
        split = raw.index(b"\r\n\r\n", body) + 4
        http = dict(line.split(": ", 1) for line in raw[body : split - 4].decode().split("\r\n")[1:])
        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        payload = raw[split:end] if kind == "response" else None
        if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have its digest")
        number, target = (head.get(name, "").strip("<>").removeprefix(NAME) for name in ("WARC-Record-ID", "WARC-Refers-To"))
        yield {
            "page_id": int(number) if number else None,
            "url": head.get("WARC-Target-URI"),
            "payload_bytes": int(http["Content-Length"]) if payload is None else len(payload),
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": int(target) if target else None,
            "payload": payload,
        }
        at = end + 4


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with opened(row["path"]) as file:
                found = unzipped(_at(file, row["begin"], row["size"]))
                yield pa.RecordBatch.from_pylist([own for raw in found for own in records(raw)], _OUT)


def read(spark: SparkSession, manifest: str) -> DataFrame:
    """``RECORDS`` of all archives of a manifest."""
    listed = spark.read.parquet(manifest)
    archives, size = listed.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # The rows are a few bytes each, what they stand for isn't: the numbers of tasks follow the archives.
    ranges = listed.select("path").repartition(max(archives, 1), "path").mapInArrow(_locate, "path string, begin long, size long")
    return ranges.repartition(size // TASK_BYTES + 1, "path", "begin").mapInArrow(_records, RECORDS)
