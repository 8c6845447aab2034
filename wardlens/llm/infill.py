"""Fill-in-the-middle by displacement: texts cut in three, their parts moved, and moved back.

A text of n code points is cut at two of its n + 1 places, which come from a hash of its
key. The bytes of a batch are not copied part by part: at the start of each part a
difference array holds by how much the displacement changes, its running sum is the
displacement of every byte, and one scatter puts all bytes in place; marks are written
into the gaps. The way back reads nothing but the output and its form: the marks, which
no cut text contains, give the parts, and a gather with the opposite displacements
restores the text.

Null and empty texts are plain, as are texts that contain a mark and those the draw
leaves alone; plain output is the text itself. A null key draws as an empty one. Equal
rows are treated alike, texts of any length as a whole (a batch works on slices of about
1 MB or one longer text). Empty tables give empty ones. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from wardlens.llm.text import parts

# The marks before prefix, suffix and middle, all of one length.
MARKS = ("<P>", "<S>", "<M>")
WIDE = len(MARKS[0])
PREFIX, SUFFIX, MIDDLE = (np.frombuffer(mark.encode(), np.uint8) for mark in MARKS)
#: Of a hundred texts those cut at all, and of a hundred cut ones those with the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
FORMS = np.array(["plain", "psm", "spm"], object)
PLAIN, PSM, SPM = range(3)
RESULT = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four whole numbers of 32 bits from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def marked(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of every mark that lies within a row."""
    if len(data) < WIDE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data[: 1 - WIDE] == PREFIX[0]) & (data[WIDE - 1 :] == PREFIX[-1]))
    at = at[np.isin(data[at + 1], (PREFIX[1], SUFFIX[1], MIDDLE[1]))]
    row = np.searchsorted(starts, at, side="right") - 1
    inside = at + WIDE <= starts[row + 1]
    return at[inside], row[inside]


def _moved(size: int, places: list[np.ndarray], shifts: list[np.ndarray]) -> np.ndarray:
    """Where each byte goes (or comes from): places and shifts of the successive parts of each row."""
    change = np.zeros(size + 1, np.int64)
    every = np.stack(shifts, axis=1).ravel()
    np.add.at(change, np.stack(places, axis=1).ravel(), np.diff(every, prepend=0))
    return np.cumsum(change[:size]) + np.arange(size)


def cut(data: np.ndarray, starts: np.ndarray, drawn: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Code points, form, prefix and middle (code points) of each row, output bytes and their starts."""
    begin, end = starts[:-1], starts[1:]
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(lead, starts)
    n = np.diff(first)
    one, two = drawn[0] % (n + 1), drawn[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    form = np.where(drawn[3] % 100 < SUFFIX_FIRST_PERCENT, SPM, PSM)
    form[(n == 0) | (drawn[2] % 100 >= CUT_PERCENT)] = PLAIN
    form[marked(data, starts)[1]] = PLAIN
    p, m = lead[first[:-1] + low], lead[first[:-1] + high]
    before, middle, after = p - begin, m - p, end - m
    size = before + middle + after + np.where(form == PLAIN, 0, 3 * WIDE)
    out_starts = np.concatenate([[0], np.cumsum(size)])
    out = out_starts[:-1]
    plain, psm = form == PLAIN, form == PSM
    to_before = np.where(plain, out, np.where(psm, out + WIDE, out + 2 * WIDE + after))
    to_middle = np.where(plain, out + before, out + 3 * WIDE + before + after)
    to_after = np.where(plain, out + before + middle, np.where(psm, out + 2 * WIDE + before, out + WIDE))
    result = np.zeros(int(out_starts[-1]), np.uint8)
    result[_moved(len(data), [begin, p, m], [to_before - begin, to_middle - p, to_after - m])] = data
    for mark, place in ((PREFIX, to_before), (SUFFIX, to_after), (MIDDLE, to_middle)):
        result[place[~plain, None] + np.arange(-WIDE, 0)] = mark
    return n, form, low, high - low, result, out_starts


def uncut(data: np.ndarray, starts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, and their starts, from outputs and their forms."""
    begin, end = starts[:-1], starts[1:]
    moved = np.flatnonzero(form != PLAIN)
    at, row = marked(data, starts)
    at = at[form[row] != PLAIN]
    if len(at) != 3 * len(moved) or not np.array_equal(row[form[row] != PLAIN], np.repeat(moved, 3)):
        raise ValueError("an output does not hold its three marks")
    at = at.reshape(-1, 3)
    own = [begin.copy(), end.copy(), end.copy()]  # from where prefix, middle and suffix come
    ends = [end.copy(), end.copy(), end.copy()]
    spm = form[moved] == SPM
    own[0][moved], ends[0][moved] = np.where(spm, at[:, 1], at[:, 0]) + WIDE, np.where(spm, at[:, 2], at[:, 1])
    own[1][moved] = at[:, 2] + WIDE
    own[2][moved], ends[2][moved] = np.where(spm, at[:, 0], at[:, 1]) + WIDE, np.where(spm, at[:, 1], at[:, 2])
    size = [b - a for a, b in zip(own, ends, strict=True)]
    out_starts = np.concatenate([[0], np.cumsum(sum(size))])
    out = out_starts[:-1]
    places = [out, out + size[0], out + size[0] + size[1]]
    source = _moved(int(out_starts[-1]), places, [a - b for a, b in zip(own, places, strict=True)])
    return data[source], out_starts


def _strings(blocks: list[np.ndarray], starts: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate([np.zeros(1, np.int64), *map(np.diff, starts)])
    data = np.concatenate([np.zeros(0, np.uint8), *blocks])
    offsets = np.cumsum(sizes)
    if offsets[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(sizes) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    return pa.LargeStringArray.from_buffers(len(sizes) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def fill_in_middle(text: Column, drawn: list[Column]) -> Column:
    """``RESULT``: code points, form, code points of prefix and middle (null if plain) and the output."""

    @arrow_udf(RESULT)
    def made(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for column, *numbers in columns:
            numbers = [number.to_numpy(zero_copy_only=False) for number in numbers]
            found: list[list[np.ndarray]] = [[] for _ in range(6)]
            for low, high, data, starts in parts(column):
                for kept, value in zip(found, cut(data, starts, [number[low:high] for number in numbers]), strict=True):
                    kept.append(value)
            n, form, before, middle = (np.concatenate([np.zeros(0, np.int64), *values]) for values in found[:4])
            fields = [
                pa.array(n, pa.int64()),
                pa.array(FORMS[form], pa.string()),
                *(pa.array(values, pa.int64(), mask=form == PLAIN) for values in (before, middle)),
                _strings(found[4], found[5]),
            ]
            yield pa.StructArray.from_arrays(fields, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return made(text, *drawn)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""

    @arrow_udf("string")
    def back(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, forms in columns:
            names = forms.to_numpy(zero_copy_only=False)
            kind = np.select([names == "psm", names == "spm"], [PSM, SPM], PLAIN)
            found = [uncut(data, starts, kind[low:high]) for low, high, data, starts in parts(column)]
            yield _strings([data for data, _ in found], [starts for _, starts in found])

    return back(output, form)
