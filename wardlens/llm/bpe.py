"""Byte-pair encoding by last tokens.

Of all token sequences that spell a text, the one that the merges produce is the only
one whose neighbours are *stable*: encoding the two together gives the same two. So the
last token of a prefix follows from the last tokens of shorter prefixes, and an
encoding grows character by character. ``Merges`` holds the vocabulary, and answers
which neighbours are stable by undoing their merges from the latest on.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

#: Stable pairs and last merges that a task remembers; past that it starts afresh.
REMEMBERED = 400_000


class Merges:
    """A vocabulary of strings, the rank of each merge (small: early), None for no merge.

    ``ids`` numbers the strings that the merges make. ``ends`` below are lists of such
    numbers: at place k the last token of the first k characters, -1 where a text begins.
    """

    def __init__(self, tokens: Iterable[str], rank: Callable[[str, str], int | None]):
        self.rank = rank
        self._last: dict[str, tuple[int, str, str] | None] = {}
        self._stable: dict[int, bool] = {}
        self.names = [token for token in tokens if len(token) < 2 or self._last_merge(token)]
        self.ids = {token: k for k, token in enumerate(self.names)}
        self.lengths = [len(token) for token in self.names]
        self._sorted = sorted(self.names)
        self._steps: dict[str, tuple[str, tuple[tuple[int, int], ...]]] = {}

    def _last_merge(self, token: str) -> tuple[int, str, str] | None:
        """Rank, left and right of the merge that makes the token; None if the merges stop short of it."""
        if token in self._last:
            return self._last[token]
        parts, found = list(token), None
        while len(parts) > 1:
            ranks = [(r, k) for k in range(len(parts) - 1) if (r := self.rank(parts[k], parts[k + 1])) is not None]
            if not ranks:
                found = None
                break
            r, k = min(ranks)
            found = (r, parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        self._last[token] = found
        return found

    def stable(self, one: int, two: int) -> bool:
        """Whether the merges keep the two tokens apart when they stand side by side."""
        key = one << 32 | two
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > REMEMBERED:
                self._stable.clear()
            known = self._stable[key] = self._apart(self.names[one], self.names[two])
        return known

    def _apart(self, one: str, two: str) -> bool:
        if self.rank(one, two) is not None:
            return False
        while len(one) > 1 or len(two) > 1:
            a = self._last_merge(one) if len(one) > 1 else None
            b = self._last_merge(two) if len(two) > 1 else None
            if b is not None and (a is None or b[0] >= a[0]):  # the right one was made later; ties go left to right
                two = b[1]
                cross = self.rank(one, two)
                if cross is not None and cross <= b[0]:
                    return False
            else:
                one = a[2]
                cross = self.rank(one, two)
                if cross is not None and cross < a[0]:
                    return False
        return True

    def _step(self, key: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """The longest end of a string that a token begins with, and length and number of the tokens that end there, longest first.

        Those of one character are left out.
        """
        if len(self._steps) > REMEMBERED // 4:
            self._steps.clear()
        state = key
        while len(state) > 1:
            at = bisect_left(self._sorted, state)
            if at < len(self._sorted) and self._sorted[at].startswith(state):
                break
            state = state[1:]
        ends = (state[k:] for k in range(len(state) - 1))
        found = self._steps[key] = state, tuple((len(end), self.ids[end]) for end in ends if end in self.ids)
        return found

    def extend(self, text: str, ends: list[int], states: list[str]) -> None:
        """Append the last token of each further prefix of the text.

        ``states`` holds, for each place of ``ends``, the longest end of the prefix that a token begins with.
        """
        steps, known, state = self._steps.get, self._stable.get, states[-1]
        add, remember, first = ends.append, states.append, len(ends)
        for at, letter in enumerate(text[first - 1 :], first):
            key = state + letter
            state, sizes = steps(key) or self._step(key)
            for size, token in sizes:
                before = ends[at - size]
                if before < 0:
                    break
                apart = known(before << 32 | token)
                if apart or (apart is None and self.stable(before, token)):
                    break
            else:
                token = self.ids[letter]
            add(token)
            remember(state)

    def tokens(self, ends: list[int]) -> list[int]:
        """The whole encoding, last token first."""
        out, at, lengths = [], len(ends) - 1, self.lengths
        while at:
            token = ends[at]
            out.append(token)
            at -= lengths[token]
        return out

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """The tokens of words in ascending order: a depth-first walk of their prefix tree.

        ``ends`` is the path to a word, so a prefix shared with the word before is not
        looked at again.
        """
        ends, states, before = [-1], [""], ""
        for word in words:
            same = 0
            for old, new in zip(before, word):  # noqa: B905
                if old != new:
                    break
                same += 1
            del ends[same + 1 :], states[same + 1 :]
            self.extend(word, ends, states)
            out = self.tokens(ends)
            out.reverse()
            yield out
            before = word


@lru_cache(1)
def byte_letters() -> str:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others, in order, for the letters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


@lru_cache(2)
def byte_level(path: str) -> tuple[Merges, dict[str, int], dict[str, int]]:
    """Merges, token numbers and special tokens of a byte-level vocabulary file (JSON)."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    pairs = (tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["merges"])
    ranks = {pair: k for k, pair in enumerate(pairs)}
    special = {token["content"]: token["id"] for token in content["added_tokens"]}
    return Merges(model["vocab"], lambda a, b: ranks.get((a, b))), model["vocab"], special
