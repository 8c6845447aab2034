"""A bidirectional FM-index over word numbers, for phrases of a few words.

Positions of a token sequence are sorted by the ``DEPTH`` tokens that follow; the tokens
before them in this order are the transform. The same is done for the sequence read
backwards. A phrase is an interval of either order, of one size, and grows by a word at
either end: the words on that side are read off the one transform, sorted inside the
interval, and their ranks give the longer phrase's interval in both orders. All phrases
of a length are grown at once, as arrays.

Token 0 stands between pieces, first and last; no phrase holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 4


def _order(tokens: np.ndarray, symbols: int) -> np.ndarray:
    """Places in the order of the next ``DEPTH`` tokens (beyond the end: 0), by doubling."""
    rank, wide, reach = tokens.astype(np.int64), symbols, 1
    while reach < DEPTH:
        follow = np.zeros(len(rank), np.int64)
        follow[:-reach] = rank[reach:]
        key = rank * wide + follow
        order = np.argsort(key)
        reach *= 2
        if reach < DEPTH:
            new = np.ones(len(key), bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(new) - 1
            wide = int(new.sum())
    return order


class Side:
    """The transform of one direction, with ranks of a token below a place."""

    def __init__(self, transform: np.ndarray, symbols: int):
        self.transform = transform
        self.first = np.concatenate([[0], np.cumsum(np.bincount(transform, minlength=symbols))])
        self.wide = len(transform) + 1
        order = np.argsort(transform, kind="stable")
        self.places = transform[order].astype(np.int64) * self.wide + order

    def start(self, token: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Where the interval of token + phrase begins, if that of the phrase begins at a place."""
        return np.searchsorted(self.places, token.astype(np.int64) * self.wide + below)

    def tokens_in(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval, token and count of the different tokens of each interval, in ascending order."""
        ahead = np.cumsum(size) - size
        at = np.repeat(low - ahead, size) + np.arange(int(size.sum()))
        symbols = len(self.first)
        key = np.repeat(np.arange(len(low), dtype=np.int64) * symbols, size) + self.transform[at]
        key, count = np.unique(key, return_counts=True)
        return key // symbols, key % symbols, count


@dataclass
class Phrases:
    """Phrases of one length: a row of words each, their counts, and where their intervals begin."""

    words: np.ndarray
    count: np.ndarray
    ahead: np.ndarray  # in the order of the sequence
    back: np.ndarray  # in the order of the sequence read backwards

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words[keep], self.count[keep], self.ahead[keep], self.back[keep])


class Index:
    """Both transforms of a sequence whose tokens are below ``symbols``."""

    def __init__(self, before: np.ndarray, after: np.ndarray, symbols: int):
        self.symbols = symbols
        self.before, self.after = Side(before, symbols), Side(after, symbols)

    @staticmethod
    def transforms(tokens: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """The token before each place in sorted order, and the same for the sequence read backwards."""
        backwards = tokens[::-1]
        return tokens[_order(tokens, symbols) - 1], backwards[_order(backwards, symbols) - 1]

    def single(self) -> Phrases:
        """Every word as a phrase."""
        words = np.arange(1, self.symbols)
        low = self.before.first[1:-1]
        return Phrases(words[:, None], np.diff(self.before.first)[1:], low, low)

    def pairs(self, one: np.ndarray, two: np.ndarray) -> Phrases:
        """Given phrases of two words, found by a step backwards; count 0 where there is none."""
        low, high = self.before.first[two], self.before.first[two + 1]
        ahead = self.before.start(one, low)
        back = self.after.start(two, self.after.first[one])
        return Phrases(np.stack([one, two], axis=1), self.before.start(one, high) - ahead, ahead, back)

    def grown(self, phrases: Phrases, right: bool) -> Phrases:
        """All phrases one word longer at the right or left end."""
        near, side = (phrases.back, self.after) if right else (phrases.ahead, self.before)
        far = phrases.ahead if right else phrases.back
        owner, token, count = side.tokens_in(near, phrases.count)
        # Inside the far interval the longer phrases lie in the order of the new word.
        smaller = np.cumsum(count) - count
        base = np.zeros(len(phrases.count), np.int64)
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        base[owner[head]] = smaller[head]
        within = far[owner] + smaller - base[owner]
        start = side.start(token, near[owner])
        own = phrases.words[owner]
        words = np.column_stack([own, token] if right else [token, own])
        ahead, back = (within, start) if right else (start, within)
        return Phrases(words, count, ahead, back).where(token > 0)
