"""Arrow text columns as byte arrays, their words, and 64-bit hashes of byte ranges.

Everything works on slices of at most ``SLICE_BYTES`` (a longer row is a slice of
its own), so a task's memory follows the slice and not the batch.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: The blanks of the word contract: space and the five controls from tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of letters, digits and everything beyond ASCII.
WORDY = np.zeros(256, bool)
WORDY[128:] = True
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    WORDY[_low : _high + 1] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Scripts written without blanks between words: Thai, Lao, Myanmar, Khmer, Tai, Javanese, Balinese, kana, bopomofo, Yi, Tangut, Han.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x19E0, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
    (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18D8F), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: The C library's call that frees what numpy's arrays leave behind, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """What this task process holds without using it goes back to the system, for the stages that come after."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def returned(f: Callable[..., pa.Array], *of: pa.Array) -> pa.Array:
    """What the function returns, when what it needed on the way is given back."""
    out = f(*of)
    give_back()
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the start of each row, the end added."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(places, np.int64 if wide else np.int32)
    starts = starts[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes, or one longer row."""
    low, rows = 0, len(starts) - 1
    while low < rows:
        high = int(np.searchsorted(starts, starts[low] + most, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def parts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice: its rows from and to, its bytes, and its rows' starts in them."""
    data, starts = utf8(column)
    for low, high in slices(starts, most):
        yield low, high, data[starts[low] : starts[high]], starts[low : high + 1] - starts[low]


def runs(kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each longest run of one kind inside a row; kind 0 is left out."""
    n = len(kind)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[starts] = True
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1], cuts[1:]
    keep = kind[begin] != 0
    begin, end = begin[keep], end[keep]
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 no part of a word, 1 letter, mark or digit, 2 one of a script without blanks."""
    kind = np.fromiter((unicodedata.category(chr(code))[0] in "LMN" for code in range(sys.maxunicode + 1)), np.uint8)
    kind[0xFE00:0xFE10] = kind[0xE0100:0xE01F0] = 0  # they choose the look of a sign
    for low, high in UNSPACED:
        kind[low : high + 1] *= 2
    return kind


def unicode_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each run of letters and digits; in scripts without blanks, of each code point."""
    if not len(data) or data.max() < 128:
        return runs(WORDY[data], starts)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[code]
    alone = np.flatnonzero(kind == 2)
    kind = kind.astype(np.uint32)
    kind[alone] = alone + 2  # no two neighbours alike
    begin, end, row = runs(kind, np.searchsorted(lead, starts))
    edge = np.append(lead, len(data))
    return edge[begin], edge[end], row


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            power = np.full(size, base, np.uint64)
            power[0] = 1
            _POWERS[k] = np.cumprod(power, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1]


def mix(value: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value = value ^ (value >> np.uint64(27))
    value = value * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: equal for equal ranges, wherever they stand."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def gram_hashes(word: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of n words of one row."""
    count = len(word) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:count] == row[n - 1 :])
    value = np.full(len(at), n, np.uint64)
    for k in range(n):
        value = value * np.uint64(0xD6E8FEB86659FD93) + word[at + k]
    return mix(value), at


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of the values between successive edges."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]
