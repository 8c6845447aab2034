"""Byte-level BPE: encode whole texts by walking the prefix tree of their words, and decode.

A slice of the texts is cut at blanks into units that no merge crosses. The distinct
units are split into words by the vocabulary's pattern; the distinct words not met
before go, sorted, through ``Merges.encode_sorted``, which shares the work on common
prefixes. A text's tokens are those of its units in order. Special strings inside a
text become their special token, as the library's default has it. Texts with blanks
beyond ASCII or special strings are cut as one unit.

Null and empty text: no token, decoded to the empty text. Any valid text decodes to
itself. Repeated rows are encoded alike; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from wardlens.llm.bpe import Merges, byte_letters, byte_level
from wardlens.llm.text import BLANK, give_back, parts, range_hashes

SLICE = 1 << 20
#: Words and units whose tokens a task remembers, unless longer than ``LONG``; past that those in use since the last turn stay.
REMEMBERED, LONG = 200_000, 256
# Fixed value: the pattern that cuts a text into words before the merges.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_BEYOND = np.zeros(256, bool)
_BEYOND[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_BLANKS = regex.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def units(data: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where units start: at rows, and around blanks unless the row is kept whole.

    Of a run of blanks before a word, a final space belongs to the word, a final
    other blank stands alone, and those before it are one unit.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        blank = BLANK[data]
        after, before = np.ones(n, bool), np.zeros(n, bool)
        after[:-1], before[1:] = blank[1:], blank[:-1]
        last = starts[1:][starts[1:] > starts[:-1]] - 1
        after[last] = True  # nothing follows: the run stays in one piece
        previous = np.zeros(n, np.uint8)
        previous[1:] = data[:-1]
        cut[:n] = (blank & (~before | ~after)) | (~blank & before & (previous != 0x20))
        for row in np.flatnonzero(whole):
            cut[starts[row] : starts[row + 1]] = False
    cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes slices of texts; keeps the words it has met."""

    def __init__(self, path: str):
        self.merges: Merges
        self.merges, self.ids, self.special = byte_level(path)
        self.numbers = [self.ids[name] for name in self.merges.names]
        self.letters = byte_letters()
        byte_of = {ord(letter): byte for byte, letter in enumerate(self.letters)}
        #: By token, its bytes and its decimal number.
        self.spelt = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for name, number in self.ids.items():
            self.spelt[number] = name.encode() if name in self.special else name.translate(byte_of).encode("latin-1")
        for name, number in self.special.items():
            self.spelt[number] = name.encode()
        #: The same as columns, for whole slices.
        self.bytes_of = pa.array(self.spelt, pa.large_binary())
        self.digits_of = pa.array([b"%d" % number for number in range(len(self.spelt))], pa.large_binary())
        self.known = self._special()
        #: What was known before the last turn; a word met again moves back.
        self.older: dict[str, tuple[int, ...]] = {}
        self.stops = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _special(self) -> dict[str, tuple[int, ...]]:
        return {name: (number,) for name, number in self.special.items()}

    def _learn(self, words: set[str]) -> None:
        letters, blank, number = self.letters, self.letters[0x20], self.numbers.__getitem__
        spelt = {}
        for word in words:
            if word.isascii() and word.isprintable():
                spelt[word.replace(" ", blank)] = word
            else:
                spelt[word.encode().decode("latin-1").translate(letters)] = word
        order = sorted(spelt)
        for name, tokens in zip(order, self.merges.encode_sorted(order), strict=True):
            self.known[spelt[name]] = tuple(map(number, tokens))

    def _new(self, words: Iterable[str]) -> Iterator[str]:
        """The words whose tokens are not known; those known before the last turn move back."""
        for word in words:
            tokens = self.older.get(word)
            if tokens is None:
                yield word
            else:
                self.known[word] = tokens

    def _cut(self, unit: str, stops: bool) -> list[str]:
        if unit.isalpha() or (unit[:1] == " " and unit[1:].isalpha()):
            return [unit]
        if not stops or not self.stops.search(unit):
            return WORDS.findall(unit)
        return [word for k, piece in enumerate(self.stops.split(unit)) for word in ([piece] if k % 2 else WORDS.findall(piece))]

    def slice(self, data: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """Tokens of each distinct unit, the unit at each place, and where each row's places begin."""
        whole = np.zeros(len(starts) - 1, bool)
        raw = data.tobytes()
        odd = [m.start() for m in _BLANKS.finditer(raw)] if _BEYOND[data].any() else []
        plain = len(odd)
        for name in self.special:
            odd += [m.start() for m in regex.finditer(regex.escape(name.encode()), raw)]
        stops = len(odd) > plain
        if odd:
            whole[np.searchsorted(starts, odd, side="right") - 1] = True
        edge = units(data, starts, whole)
        begin, end = edge[:-1], edge[1:]
        _, first, place = np.unique(range_hashes(data, begin, end), return_index=True, return_inverse=True)
        names = [raw[a:b].decode() for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.known) > REMEMBERED:
            self.known, self.older = self._special(), self.known
        known = self.known
        cuts = {name: self._cut(name, stops) for name in self._new([name for name in names if name not in known])}
        self._learn(set(self._new({word for cut in cuts.values() for word in cut if word not in known})))
        for name, cut in cuts.items():
            if len(cut) != 1:
                known[name] = tuple(chain.from_iterable(map(known.__getitem__, cut)))
        tokens = list(map(known.__getitem__, names))
        for name in [name for name in cuts if len(name) > LONG]:
            for word in (name, *cuts[name]):
                if len(word) > LONG:
                    known.pop(word, None)
        return tokens, place, np.searchsorted(begin, starts)

    def decoded(self, tokens: Sequence[int]) -> bytes:
        """The bytes that the tokens spell; special tokens spell their name."""
        return b"".join(map(self.spelt.__getitem__, tokens))

    def written(self, flat: np.ndarray, edge: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """Of each row of tokens their decimal numbers, joined by commas, and the bytes they spell."""
        edge = pa.array(edge, pa.int32())
        numbers, spelt = (pa.ListArray.from_arrays(edge, names.take(pa.array(flat))) for names in (self.digits_of, self.bytes_of))
        for low in range(0, len(numbers), 256):
            listed = pc.binary_join(numbers.slice(low, 256), pa.scalar(b",", pa.large_binary()))
            decoded = pc.binary_join(spelt.slice(low, 256), pa.scalar(b"", pa.large_binary()))
            yield from zip(listed.to_pylist(), decoded.to_pylist(), strict=True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This task process's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget(path: str) -> None:
    """Drop this task process's encoder of a vocabulary file, and the vocabulary.

    To be called by name: a function that Spark sends to the tasks has its own copy of ``_ENCODERS``.
    """
    _ENCODERS.pop(path, None)
    byte_level.cache_clear()
    give_back()


def encode(text: Column, path: str) -> Column:
    """array<int>: the tokens of a text column."""

    @arrow_udf("array<int>")
    def tokens_of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in column:
            values, lengths = [np.zeros(0, np.int32)], [np.zeros(1, np.int32)]
            for _, _, data, starts in parts(array, SLICE):
                tokens, place, edge = encoder(path).slice(data, starts)
                flat, size = spread(tokens, place)
                values.append(flat)
                lengths.append(np.diff(np.concatenate([[0], np.cumsum(size)])[edge]))
            offsets = np.cumsum(np.concatenate(lengths)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))

    return tokens_of(text)


def spread(tokens: list[tuple[int, ...]], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens at all places in a row, and how many each place has."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = np.fromiter((t for own in tokens for t in own), np.int32, int(size.sum()))
    start = np.cumsum(size) - size
    own = size[place]
    ahead = np.cumsum(own) - own
    return flat[np.repeat(start[place] - ahead, own) + np.arange(int(own.sum()))], own


def digests(text: Column, path: str, keep: bool = True) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: encode a text, decode the tokens, and hash both.

    The first hash is over the decimal ids joined by commas, the second over the decoded text.
    Without ``keep`` a task drops vocabulary and words in the end, for stages that share
    their task processes with others; the next task loads them anew.
    """

    @arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def hashed(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in column:
            count, ids, decoded = [], [], []
            for _, _, data, starts in parts(array, SLICE):
                own = encoder(path)
                tokens, place, edge = own.slice(data, starts)
                flat, size = spread(tokens, place)
                edge = np.concatenate([[0], np.cumsum(size)])[edge]
                count.append(np.diff(edge))
                for listed, spelt in own.written(flat, edge):
                    ids.append(hashlib.sha256(listed).hexdigest())
                    decoded.append(hashlib.sha256(spelt.decode(errors="replace").encode()).hexdigest())
            columns = [pa.array(np.concatenate(count) if count else [], pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])
        if not keep:
            own = None
            forget(path)

    return hashed(text)
