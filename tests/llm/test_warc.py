import base64
import hashlib
import io
import zipfile

import pytest

from wardlens.llm import warc
from wardlens.session import scratch_path

PAGES = "page_id long, url string, html string, digest string, first string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages():
    rows = [(9, "http://a/1", "same"), (3, "http://a/2?x=é \n", "same"), (5, None, "same"), (3, "http://a/2", "same"), (7, "u", ""), (8, "u", None), (11, "", "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "null id"), (12, "n", "null id"), (20, "l", "long " * 200_000)]
    return [(k, u, h, "x", "y") for k, u, h in rows]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    table = spark.createDataFrame(pages(), PAGES).repartition(3)
    manifest = warc.write(table, "page_id", "url", "html", scratch_path(spark, "warc"), revisit_bytes=least, roll_bytes=300)
    found = [tuple(r) for r in warc.read(spark, manifest).drop("url", "payload").collect()]
    first = {}
    for key, _, html, *_ in pages():
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    expected = []
    for key, _, html, *_ in pages():
        size = len((html or "").encode())
        later = key is not None and key > first[html or ""] and size >= least
        expected.append((key, size, digest(html), "revisit" if later else "response", first[html or ""] if later else None))
    assert sorted(found, key=str) == sorted(expected, key=str)
    texts = {r["page_id"]: r["payload"] for r in warc.read(spark, manifest).collect()}
    assert bytes(texts[11]).decode() == "é\r\n\r\nWARC/1.1\r\n" and len(texts[20]) == 1_000_000
    assert spark.read.parquet(manifest).count() > 3


def test_reading_tasks_follow_the_bytes(spark, monkeypatch):
    """Ranges of a few bytes a row are not merged into one task."""
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000)
    rows = [(k, "u", "".join(hashlib.sha512(f"{k} {n}".encode()).hexdigest() for n in range(4)), "x", "y") for k in range(900)]
    manifest = warc.write(spark.createDataFrame(rows, PAGES).repartition(2), "page_id", "url", "html", scratch_path(spark, "warc"), roll_bytes=8000)
    size = sum(row["bytes"] for row in spark.read.parquet(manifest).collect())
    found = warc.read(spark, manifest)
    held = [len(part) for part in found.select("page_id").rdd.glom().collect()]
    assert len(held) == size // 20_000 + 1 > 5 and sum(map(bool, held)) > 3
    assert sum(held) == 900


def test_no_pages(spark):
    manifest = warc.write(spark.createDataFrame([], PAGES), "page_id", "url", "html", scratch_path(spark, "warc"))
    assert warc.read(spark, manifest).collect() == []


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_zip64_directory_and_comment():
    raw = File()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as out:
        with out.open(zipfile.ZipInfo(warc.DATA), "w", force_zip64=True) as member:
            member.write(b"records")
        out.writestr(warc.INDEX, "lines")
        out.comment = b"a comment with PK\x05\x06 in it" + b"." * 40
    found = warc.members(raw)
    assert {name: raw.getvalue()[a : a + n] for name, (a, n) in found.items()} == {warc.DATA: b"records", warc.INDEX: b"lines"}


def test_zip64_of_many_members():
    raw = File()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as out:
        for k in range(66_000):  # more than a plain directory counts
            out.writestr(f"m{k}", str(k))
    found = warc.members(raw)
    begin, size = found["m65999"]
    assert len(found) == 66_000 and raw.getvalue()[begin : begin + size] == b"65999"


def test_broken_archives_and_records():
    with pytest.raises(ValueError, match="not a ZIP archive"):
        warc.members(File(b"nothing"))
    packed = File()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("x", "y" * 100)
    with pytest.raises(ValueError, match="compressed"):
        warc.members(packed)
    raw = warc.record(1, "u", b"payload", 7, digest("payload"), None)
    assert next(warc.records(raw))["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(raw.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaf")))
