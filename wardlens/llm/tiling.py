"""Benchmark decontamination by greedy string tiling.

Texts and test items are sequences of lower-case tokens: runs of Unicode letters, marks
and digits, and each such code point alone in scripts without blanks (``UNSPACED``);
punctuation, signs and blanks don't count. Every run of ``MIN_MATCH`` tokens of an item
is a seed, and an item of fewer tokens is one as a whole. Hashes of such runs roll over a whole text and meet the seeds in a sorted table,
through a bit map that turns most away; neighbouring hits on one diagonal are a longest
match. For each text and item the longest match of which no token is marked is marked,
again and again; one that is partly marked is cut to its free parts, down to
``MIN_MATCH`` tokens. Coverage is the marked share of the item's tokens, so a passage
whose sentences stand in another order is found. Pairs whose hits together can't reach
the threshold are not tiled.

Items go to tasks in blocks of about ``BLOCK_TOKENS`` tokens, each a bounded closure; the
results of blocks are merged row by row, so any number of items is tested against each
row in one scan, without a shuffle.

Null and empty text and text without tokens: coverage 0, no item. An item with fewer
than ``MIN_MATCH`` tokens is found where all of them stand in a row, as one tile; items
without text count as empty; items with equal texts all count, the smallest id is
reported. An item whose id is null counts like others and is reported, with null for its
id, unless an item with an id is covered no less. No item: coverage 0 everywhere. Repeated rows are treated alike; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from wardlens.llm.text import give_back, gram_hashes, parts, range_hashes, unicode_words

MIN_MATCH = 4
THRESHOLD = 0.5
BLOCK_TOKENS = 200_000
_BITS = 22


@dataclass(frozen=True)
class Items:
    """A block of test items, ``named`` those that have an id: seeds sorted by hash, with item number and token place."""

    ids: np.ndarray
    named: np.ndarray
    sizes: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, str]]) -> Items:
        rows = sorted(rows, key=lambda row: (row[0] is None, row[0] or 0, row[1]))  # without an id: last
        seeds, items, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sizes = np.zeros(len(rows), np.int64)
        for low, high, data, starts in parts(pa.array([text for _, text in rows], pa.string())):
            word, row = tokens(data, starts)
            sizes[low:high] = np.bincount(row, minlength=high - low)
            for n in range(1, MIN_MATCH + 1):
                seed, at = gram_hashes(word, row, n)
                own = np.flatnonzero((sizes[low + row[at]] == n) | (n == MIN_MATCH))  # shorter ones of whole items only
                seed, at = seed[own], at[own]
                seeds.append(seed)
                items.append(row[at] + low)
                places.append(at - np.searchsorted(row, row[at]))
        seed = np.concatenate(seeds)
        order = np.argsort(seed, kind="stable")
        return Items(np.array([key or 0 for key, _ in rows], np.int64), np.array([key is not None for key, _ in rows], bool), sizes, seed[order], np.concatenate(items)[order], np.concatenate(places)[order])


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token."""
    begin, end, row = unicode_words(data, starts)
    return range_hashes(data, begin, end), row


def tile(matches: list[tuple[int, int, int]], size: int) -> tuple[int, int]:
    """Marked tokens and tiles, given (length, place in item, place in text) of the longest matches."""
    heap = [(-length, i, d) for length, i, d in matches]
    heapq.heapify(heap)
    item, text, covered, tiles = bytearray(size), set(), 0, 0
    while heap and size - covered >= MIN_MATCH:
        length, i, d = heapq.heappop(heap)
        length = -length
        free = [k for k in range(length) if not item[i + k] and d + k not in text]
        if len(free) == length:
            item[i : i + length] = b"\1" * length
            text.update(range(d, d + length))
            covered, tiles = covered + length, tiles + 1
            continue
        begin = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - begin >= MIN_MATCH:
                    heapq.heappush(heap, (begin - k, i + free[begin], d + free[begin]))
                begin = k
    return covered, tiles


def _hits(items: Items, allowed: np.ndarray, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, place in the item and place in the slice of each seed met."""
    word, row = tokens(data, starts)
    short = np.unique(items.sizes[(items.sizes > 0) & (items.sizes < MIN_MATCH)]).tolist()
    found = []
    for n in [*short, MIN_MATCH]:
        gram, at = gram_hashes(word, row, n)
        maybe = np.flatnonzero(allowed[(gram >> np.uint64(64 - _BITS)).astype(np.int64)])
        gram, at = gram[maybe], at[maybe]
        if n < MIN_MATCH:  # one place of a row says all
            first = np.unique(np.stack([gram, row[at].astype(np.uint64)]), axis=1, return_index=True)[1]
            gram, at = gram[first], at[first]
        low, high = np.searchsorted(items.seed, gram), np.searchsorted(items.seed, gram, side="right")
        many = high - low
        at = np.repeat(at, many)
        seed = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(at))
        found.append((row[at], items.item[seed], items.place[seed], at))
    return tuple(np.concatenate(columns) for columns in zip(*found, strict=True))


def _tiled(items: Items, threshold: float, row: np.ndarray, item: np.ndarray, place: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """Row, item, coverage and tiles of each pair that reaches the threshold."""
    order = np.lexsort((at, at - place, item, row))
    row, item, place, at = row[order], item[order], place[order], at[order]
    edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]), [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        size = int(items.sizes[item[a]])
        if size < MIN_MATCH:
            yield int(row[a]), int(item[a]), 1.0, 1
            continue
        met = np.unique(place[a:b])
        if np.minimum(np.diff(met, append=met[-1] + MIN_MATCH), MIN_MATCH).sum() < threshold * size:
            continue
        i, d = place[a:b], at[a:b]
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 1) | (np.diff(i) != 1)]))
        lengths = np.diff(np.append(begins, b - a)) + MIN_MATCH - 1
        covered, tiles = tile(list(zip(lengths.tolist(), i[begins].tolist(), d[begins].tolist(), strict=True)), size)
        if covered >= threshold * size:
            yield int(row[a]), int(item[a]), covered / size, tiles


def _tested(items: Items, text: Column, threshold: float) -> Column:
    allowed = np.zeros(1 << _BITS, bool)
    filled = np.unique((items.seed >> np.uint64(64 - _BITS)).astype(np.int64))

    @arrow_udf("struct<coverage: double, item_id: bigint, n_items: bigint, n_tiles: bigint>")
    def covered(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        allowed[filled] = True
        for column in columns:
            best = np.zeros(len(column)), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            named = np.zeros(len(column), bool)
            for low, _, data, starts in parts(column):
                hits = _hits(items, allowed, data, starts)
                if not len(hits[0]):
                    continue
                for row, item, coverage, tiles in _tiled(items, threshold, *hits):  # items ascend with their ids, null last
                    best[2][low + row] += 1
                    if coverage > best[0][low + row]:
                        best[0][low + row], best[1][low + row], best[3][low + row] = coverage, items.ids[item], tiles
                        named[low + row] = items.named[item]
            columns_out = [pa.array(best[0]), pa.array(best[1], mask=~named), pa.array(best[2]), pa.array(best[3])]
            yield pa.StructArray.from_arrays(columns_out, ["coverage", "item_id", "n_items", "n_tiles"])
        give_back()

    return covered(F.lower(text))


@arrow_udf(LongType())
def _size(column: pa.Array) -> pa.Array:
    """The number of tokens of each text."""
    return pa.array(np.concatenate([np.zeros(0, np.int64), *(np.bincount(tokens(data, starts)[1], minlength=high - low) for low, high, data, starts in parts(column))]), pa.int64())


def blocks(benchmark: DataFrame, key: str, text: str) -> list[Items]:
    """The test items in blocks of about ``BLOCK_TOKENS`` tokens, one after the other on the driver."""
    rows = benchmark.select(F.col(key).cast("long").alias("key"), F.lower(F.col(text)).alias("text")).where("text is not null")
    total = rows.agg(F.sum(_size("text"))).first()[0] or 0
    count = -(-total // BLOCK_TOKENS)
    deal = F.pmod(F.xxhash64("key", "text"), F.lit(max(count, 1)))
    return [Items.of([tuple(row) for row in rows.where(deal == k).collect()]) for k in range(count)]


def contamination(items: list[Items], text: Column, threshold: float = THRESHOLD) -> Column:
    """struct<coverage, item_id, n_items, n_tiles> of a text column.

    Of the items covered to the threshold, how many there are, and of the best covered one
    (ties: the smallest id, null last) coverage, id and tiles.
    """
    if not items:
        return F.expr("named_struct('coverage', 0D, 'item_id', cast(null as bigint), 'n_items', 0L, 'n_tiles', 0L)")
    found = F.array(*(_tested(block, text, threshold) for block in items))
    if len(items) == 1:
        return found[0]
    best = F.array_max(F.transform(found, lambda x: F.struct(x.coverage, (-x.item_id).alias("item_id"), x.n_tiles)))
    return F.struct(
        best.coverage.alias("coverage"),
        (-best.item_id).alias("item_id"),
        F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + x.n_items).alias("n_items"),
        best.n_tiles.alias("n_tiles"),
    )
