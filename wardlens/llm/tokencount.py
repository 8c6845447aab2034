"""Token counts of a sentence-piece BPE vocabulary by a deterministic transducer.

A state of the transducer is what later merges can still depend on: the text's longest
end that begins some piece, the last token of each prefix inside it (``Merges``), and
the token counts there relative to the count so far. A transition reads one character
and emits the change of the count, so a text's count is the sum along its path. States
and transitions are compiled when first reached and kept for the task; past ``STATES``
the table is dropped and compiled afresh.

A text is cut into chunks whose maps {entry state: (exit state, emitted)} compose. A
chunk that begins at a synchronising place (before a run of blanks, or beside a
character that no piece holds) has one entry, the start state, so the prefix scan over
those maps is a running sum, taken for a whole slice of texts at once; equal chunks are
run once. A longer chunk is cut further every ``CHUNK`` characters, entered in the state
that the characters before the cut lead to, and joined pairwise, level by level; an
entry that was guessed wrongly is run again.

Null and empty text: 0 tokens. Repeated rows are counted alike; other columns are never
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from wardlens.llm.bpe import Merges
from wardlens.llm.text import parts, range_hashes, sums

SLICE = 4 << 20
STATES = 300_000
CHUNK = 4096
#: Distinct chunks whose count a task remembers, unless longer than ``LONG`` characters.
REMEMBERED, LONG = 600_000, 256
# Fixed value: the letter that stands for a blank in the pieces.
BLANK = "▁"
START = 0
State = tuple[str, tuple[int, ...], tuple[int, ...]]
Map = dict[int, tuple[int, int]]


class Transducer:
    """States by number, 0 the start; ``moves[state][character]`` is (next state, emitted)."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            k
            for k in range(model.vocab_size())
            if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or model.is_unused(k))
        ]
        order = sorted(normal, key=lambda k: -model.get_score(k))
        ranks = {model.id_to_piece(k): place for place, k in enumerate(order)}
        self.merges = Merges(ranks, lambda a, b: ranks.get(a + b))
        self.letters = set("".join(ranks))
        self.begins = {piece[:k] for piece in ranks for k in range(1, len(piece))}
        #: Whether nothing merges across the place before a run of blanks.
        self.blank_resets = not any(BLANK in piece.lstrip(BLANK) for piece in ranks)
        self._reset()

    def _reset(self) -> None:
        first: State = ("", (-1,), (0,))
        self.states: list[State] = [first]
        self.numbers = {first: START}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _move(self, state: int, letter: str) -> tuple[int, int]:
        """Compile one transition."""
        tail, lasts, counts = self.states[state]
        if letter not in self.letters:  # spelt in bytes; no merge crosses it
            return START, len(letter.encode())
        text, ends = tail + letter, list(lasts)
        self.merges.extend(text, ends, [tail])
        size = self.merges.lengths[ends[-1]]
        emitted = counts[len(text) - size] + 1
        keep = 0
        while text[keep:] not in self.begins and keep < len(text):
            keep += 1
        reached = (text[keep:], tuple(ends[keep:]), tuple(c - emitted for c in (*counts, emitted)[keep:]))
        number = self.numbers.get(reached)
        if number is None:
            number = self.numbers[reached] = len(self.states)
            self.states.append(reached)
            self.moves.append({})
        return number, emitted

    def run(self, state: int, text: str) -> tuple[int, int]:
        """Exit state and emitted count of a text entered in a state."""
        moves, total = self.moves, 0
        for letter in text:
            move = moves[state].get(letter)
            if move is None:
                move = moves[state][letter] = self._move(state, letter)
            state, emitted = move
            total += emitted
        return state, total

    def count(self, text: str) -> int:
        """Tokens of a chunk entered in the start state."""
        if len(text) <= CHUNK:
            return self.run(START, text)[1]
        chunks = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]
        entry = [START, *(self.run(START, chunk[-64:])[0] for chunk in chunks[:-1])]
        level: list[tuple[str, Map]] = [(chunk, {at: self.run(at, chunk)}) for chunk, at in zip(chunks, entry, strict=True)]
        while len(level) > 1:
            joined = [self._compose(*level[k : k + 2]) for k in range(0, len(level) - 1, 2)]
            level = joined + level[len(joined) * 2 :]
        return level[0][1][START][1]

    def _compose(self, one: tuple[str, Map], two: tuple[str, Map]) -> tuple[str, Map]:
        """The map of two neighbouring chunks."""
        out: Map = {}
        for entry, (middle, before) in one[1].items():
            if middle not in two[1]:
                two[1][middle] = self.run(middle, two[0])
            end, after = two[1][middle]
            out[entry] = (end, before + after)
        return one[0] + two[0], out


class Counter:
    """Counts slices of texts; keeps the chunks it has met."""

    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.known: dict[str, int] = {}
        letters = self.transducer.letters
        self.walls = np.array([chr(b) not in letters and chr(b) != " " for b in range(128)] + [False] * 128)

    def _count(self, text: str) -> int:
        if len(self.transducer.states) > STATES:
            self.transducer._reset()
        return self.transducer.count(text)

    def slice(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n:
            space, wall = data == 0x20, self.walls[data]
            cut[1:n] = wall[1:] | wall[:-1]
            if self.transducer.blank_resets:
                cut[1:n] |= space[1:] & ~space[:-1]
        cut[starts] = True
        edge = np.flatnonzero(cut)
        begin, end = edge[:-1], edge[1:]
        opens = np.isin(begin, starts)  # a text is read with a blank before it
        key = range_hashes(data, begin, end) ^ np.where(opens, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        raw, known, counts = data.tobytes(), self.known, np.empty(len(first), np.float64)
        for k, (a, b, new) in enumerate(zip(begin[first].tolist(), end[first].tolist(), opens[first].tolist(), strict=True)):
            chunk = raw[a:b].decode().replace(" ", BLANK)
            if new:
                chunk = BLANK + chunk
            count = known.get(chunk)
            if count is None:
                count = self._count(chunk)
                if len(chunk) <= LONG:
                    known[chunk] = count
            counts[k] = count
        return sums(counts[place], np.searchsorted(begin, starts)).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(text: Column, path: str) -> Column:
    """Tokens of a text column, as the vocabulary's library counts them."""

    @arrow_udf("bigint")
    def counted(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        for array in column:
            out = [np.zeros(0, np.int64)]
            out += [_COUNTERS[path].slice(data, starts) for _, _, data, starts in parts(array, SLICE)]
            yield pa.array(np.concatenate(out), pa.int64())

    return counted(F.replace(text, F.lit(BLANK), F.lit(" ")))
