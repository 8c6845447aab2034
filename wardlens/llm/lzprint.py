"""Lempel-Ziv phrase fingerprints, compared with an edited text and the next document.

A text is parsed into dictionary phrases (LZ78: each phrase is the shortest that is not
in the dictionary yet). The set of phrases is hashed; each of ``BINS`` equal ranges of
hashes keeps its smallest one, and an empty range borrows from the next that is not. The
fingerprint is these minima in hexadecimal, the likeness of two fingerprints the share
of ranges that agree.

Documents are dealt by ascending key to buckets, each sorted; the first row of a bucket
is also given to the bucket before it (that of the first bucket to the last), so each
task sees the next document of each of its rows. The text moves once. The two halves of
a text are parsed in one pass, and the edited text goes on from the middle of it.

Null text counts as empty; a text without phrases has the empty fingerprint, alike to
itself only. A null key comes before all others. Rows with equal keys follow each other
by text; a table of one row is its own next document. An empty table gives none. Other
columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.ordering import buckets, dealt
from wardlens.llm.text import mix, range_hashes

BINS = 64
BLOCK_CHARS = 1 << 19
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def phrases(text: str, known: set[str], begun: str = "") -> tuple[list[str], str]:
    """The new phrases of a text that goes on from ``begun``, and what is left of it; adds them to ``known``."""
    out, learn, phrase = [], known.add, begun
    for letter in text:
        phrase += letter
        if phrase not in known:
            learn(phrase)
            out.append(phrase)
            phrase = ""
    return out, phrase


def minima(sets: list[list[str]]) -> np.ndarray:
    """A row of ``BINS`` minimum hashes for each list of phrases; all ones if it is empty."""
    flat = [phrase for own in sets for phrase in own]
    out = np.full((len(sets), BINS), _NONE)
    if flat:
        data = np.frombuffer("".join(flat).encode(), np.uint8)
        letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        edge = letters[np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))])]
        value = range_hashes(data, edge[:-1], edge[1:])
        row = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
        place = row * BINS + (value >> np.uint64(58)).astype(np.int64)
        np.minimum.at(out.reshape(-1), place, value & np.uint64((1 << 58) - 1))
        for _ in range(BINS - 1):
            empty = out == _NONE
            if not empty[empty.any(axis=1) & ~empty.all(axis=1)].any():
                break
            lent = np.roll(out, -1, axis=1)
            out = np.where(empty & (lent != _NONE), mix(lent) >> np.uint64(6), out)
    return out


def spelt(row: np.ndarray) -> str:
    """A fingerprint: 32 bits of each minimum; empty for no phrase."""
    return "" if row[0] == _NONE else (row & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()


def _block(rows: list[tuple[object, str]], following: str) -> pa.RecordBatch:
    """Results of consecutive documents, given the text after them."""
    own, edited, digest = [], [], []
    for k, (_, text) in enumerate(rows):
        after = rows[k + 1][1] if k + 1 < len(rows) else following
        half = len(text) // 2
        graft = after[:half]
        known: set[str] = set()
        head, begun = phrases(text[: len(text) - half], known)
        other = known.copy()
        tail, left = phrases(text[len(text) - half :], known, begun)
        grafted, over = phrases(graft, other, begun)
        own.append(head + tail + ([left] if left else []))
        edited.append(head + grafted + ([over] if over else []))
        digest.append(hashlib.sha256((text[: len(text) - half] + graft).encode()).hexdigest())
    last, left = phrases(following, set())
    prints = minima([*own, [*last, left] if left else last])
    edits = minima(edited)
    mine, after = prints[:-1], prints[1:]
    return pa.record_batch(
        [
            pa.array([key for key, _ in rows], pa.int64()),
            pa.array([len(text) for _, text in rows], pa.int64()),
            pa.array(digest),
            pa.array([spelt(row) for row in mine]),
            pa.array([spelt(row) for row in edits]),
            pa.array((mine == edits).mean(axis=1)),
            pa.array((mine == after).mean(axis=1)),
        ],
        ["key", *(part.split()[0] for part in COLUMNS.split(", "))],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, its own first, then the one that follows the bucket."""
    rows: list[tuple[object, str]] = []
    size = 0
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("ahead", "key", "text"))
        for ahead, key, text in zip(*columns, strict=True):
            if rows and (ahead or size > BLOCK_CHARS):
                yield _block(rows, text)
                rows, size = [], 0
            if not ahead:
                rows.append((key, text))
                size += len(text)


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key (a whole number) and ``COLUMNS`` of each document."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bucket, count = buckets(rows.select("key"), "key")
    # The first key of each bucket that has rows: as many numbers as buckets.
    found = rows.select("key").groupBy(bucket.alias("bucket")).agg(F.min("key").alias("key"), F.max(F.col("key").isNull()).alias("none"))
    first = sorted((row["bucket"], None if row["none"] else row["key"]) for row in found.collect())
    before = {key: first[place - 1][0] for place, (_, key) in enumerate(first)}
    numbers = [(key, place) for key, place in before.items() if key is not None]
    target = F.lit(None).cast("int")
    if numbers:
        places = F.create_map(*(F.lit(x).cast("long") if k == 0 else F.lit(x) for pair in numbers for k, x in enumerate(pair)))
        target = F.try_element_at(places, F.col("key"))
    if None in before:
        target = F.when(F.col("key").isNull(), before[None]).otherwise(target)
    own = F.struct(bucket.cast("int").alias("bucket"), F.lit(False).alias("ahead"))
    extra = F.struct(target.cast("int").alias("bucket"), F.lit(True).alias("ahead"))
    goes = F.explode(F.when(target.isNull(), F.array(own)).otherwise(F.array(own, extra)))
    ordered = dealt(rows.select("key", "text", goes.alias("goes")).select("goes.*", "key", "text"), count, "ahead", "key", "text")
    return ordered.mapInArrow(_walk, f"key long, {COLUMNS}").withColumnRenamed("key", key)
