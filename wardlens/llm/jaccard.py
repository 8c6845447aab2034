"""Similarity join of documents on word shingles by count-vector R-trees.

A document's set holds its distinct 5-word shingles (64-bit hashes). Equal sets form a
class; all that follows is between classes. Two sets link when 100 * intersection is at
least 80 * union, that is when the intersection is at least 80 / 180 of the sizes' sum.

*Points.* The shingles of a set are hashed into groups, about one for each shingle. The
point is the group counts, each up to 3, with all that is above 3 as one more coordinate.
The sum of the coordinate minima of two points bounds their intersection from above, also
after groups are added up to fewer.

*Blocks.* Linked sets share one of the first ``n / 5 + 1`` shingles of either in any one
order, so each class is sent to the blocks of these. The order puts shingles that are
frequent in a bounded sample last, and goes by hash otherwise; it changes the size of
blocks and not the result. Near copies are joined before, each to the smallest class
with an equal minimum hash, so that blocks only look for links between components.

*Trees.* A block of at most ``LEAF`` points is one leaf, whose pairs are bounded at
once. In a larger one an R-tree is packed over the points, with about one group for eight
shingles, in order of size, and joined with itself from the root: two nodes are followed
only while the summed minima of their largest corners reach the smallest overlap that a
pair below could need. Pairs of the leaves are bounded again with all groups. Blocks are
split into tiles of ``TILE`` points (fewer of long texts) whose pairs are joined in
separate tasks.

*Check.* Points of a pair of tiles that have a surviving pair meet their texts once for
that pair of tiles. One task searches them again and counts exactly, the closest pairs
first, and passes over what its links have joined already. Surviving pairs of leaves are
grouped by one side, in groups of bounded size, meet the texts of both, and are counted
exactly. Components come from the links (``components``).

*Order.* A class goes to the largest of its blocks first. What is linked there is one
component when all blocks are searched, most of which then hold one component only.

Null and empty text and text without words: size 0, linked with nothing, its own
component. With fewer than five words the whole sequence is the one shingle. Copies and
repeated rows are in one component. A null key gets the smallest key that is not null
in its component, or null. Other columns are never read.

Of each component one row is the first: that of the smallest key (null last), and of its
texts that with the smallest hash. Each row without words is first, as it stands alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType, LongType

from wardlens.llm.components import components
from wardlens.llm.text import BLANK, LOWER, give_back, gram_hashes, mix, parts, range_hashes, runs
from wardlens.session import scratch_path

WORDS = 5
LEAF, FAN = 16, 8
TILE = 1024
#: Shingles for which a point counts as one in the size of a tile, and rows of a task of tile pairs.
LONG, ROWS_PER_TASK = 512, 20_000
#: Rows of the sample from which frequent shingles are taken, how often makes one, and how many at most.
SAMPLE, FREQUENT, MOST = 4000, 4, 200_000
NEAR_KEYS = 4
#: Texts that meet one other text in one group.
PARTNERS = 256
SIEVE_BITS = 1 << 24


def needed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Smallest intersection of linked sets of these sizes."""
    return -(-80 * (one + two) // 180)


def shingles(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = LOWER[data]
    begin, end, row = runs(~BLANK[data], starts)
    word = range_hashes(data, begin, end)
    rows = len(starts) - 1
    edge = np.searchsorted(row, np.arange(rows + 1))
    gram, at = gram_hashes(word, row, WORDS)
    cut = np.searchsorted(row[at], np.arange(rows + 1))
    out = []
    for k in range(rows):
        size = edge[k + 1] - edge[k]
        if size >= WORDS:
            own = np.sort(gram[cut[k] : cut[k + 1]])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif size:
            out.append(gram_hashes(word[edge[k] : edge[k + 1]], row[edge[k] : edge[k + 1]], int(size))[0])
        else:
            out.append(gram[:0])
    return out


def signature(own: np.ndarray) -> np.uint64:
    """One hash of a whole set."""
    return mix(np.array([mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(own))], np.uint64))[0]


def dimensions(size: int) -> int:
    """Groups for a set of this size: a power of two."""
    return max(16, 1 << (size - 1).bit_length())


def point(own: np.ndarray) -> np.ndarray:
    """Counts of the groups, each up to 3, and what is above."""
    groups = dimensions(len(own))
    counts = np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    low = np.minimum(counts, 3)
    return np.append(low, len(own) - low.sum()).astype(np.int32)


def packed(values: np.ndarray) -> bytes:
    """A point as bytes, four counts in one."""
    low = values[:-1].reshape(-1, 4) << np.array([0, 2, 4, 6])
    return low.sum(axis=1).astype(np.uint8).tobytes() + int(values[-1]).to_bytes(4, "little")


def unpacked(raw: bytes) -> np.ndarray:
    low = np.frombuffer(raw, np.uint8, len(raw) - 4)[:, None] >> np.array([0, 2, 4, 6], np.uint8)
    return np.append((low & 3).ravel(), int.from_bytes(raw[-4:], "little")).astype(np.int32)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points of more groups as points of fewer."""
    low = points[:, :-1].reshape(len(points), -1, groups).sum(axis=1, dtype=np.int32)
    return np.concatenate([low, points[:, -1:]], axis=1)


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, starts in parts(batch.column("text")):
            sets = shingles(data, starts)
            size = np.array([len(own) for own in sets], np.int64)
            sign = _signed(np.array([signature(own) for own in sets], np.uint64))
            near = []
            for own in sets:
                bins = own & np.uint64(NEAR_KEYS - 1)
                firsts = [own[bins == j][:1] for j in range(NEAR_KEYS)]
                near.append(_signed(mix(np.concatenate(firsts))))
            yield pa.record_batch(
                [
                    batch.column("key").slice(low, high - low),
                    batch.column("mark").slice(low, high - low),
                    pa.array(size),
                    pa.array(sign, mask=size == 0),
                    pa.array([packed(point(own)) if len(own) else None for own in sets], pa.binary()),
                    pa.array(near, pa.list_(pa.int64())),
                ],
                ["key", "mark", "n", "sig", "point", "near"],
            )
    give_back()


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, starts in parts(batch.column("text")):
            for own in shingles(data, starts):
                yield pa.record_batch([pa.array(_signed(own))], ["shingle"])


def frequent(docs: DataFrame) -> np.ndarray:
    """Sorted shingles that several rows of the sample hold."""
    rows = docs.count()
    share = min(1.0, SAMPLE / max(rows, 1))
    sample = docs.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counted = sample.select("text").mapInArrow(_all_shingles, "shingle long").groupBy("shingle").count()
    top = counted.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(MOST)
    return np.sort(np.array([row["shingle"] for row in top.collect()], np.int64).view(np.uint64))


def _prefixes(common: np.ndarray):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, sig) for the first shingles of each set; equal sets of a slice once."""
        for batch in batches:
            for _, _, data, starts in parts(batch.column("text")):
                seen, keys, signs = set(), [], []
                for own in shingles(data, starts):
                    sign = signature(own)
                    if not len(own) or sign in seen:
                        continue
                    seen.add(sign)
                    size = len(own) // 5 + 1
                    if len(common):
                        place = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        late = common[place] == own
                        if late.any():
                            own = np.concatenate([own[~late], own[late]])
                    keys.append(own[:size])
                    signs.append(np.full(size, sign, np.uint64))
                if keys:
                    yield pa.record_batch([pa.array(_signed(np.concatenate(keys))), pa.array(_signed(np.concatenate(signs)))], ["key", "sig"])
        give_back()

    return prefixes


def _routes(batches: Iterator[pa.RecordBatch], leaf: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, sig) to pairs of small blocks (key null) and members of large ones (b null)."""
    pairs, held = [], 0
    key, sign, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # a block that may go on; a large one's key

    def pair_batch() -> pa.RecordBatch:
        found = np.unique(np.concatenate(pairs), axis=0)
        return _route(np.zeros(len(found), np.int64), found[:, 0], found[:, 1], True)

    def blocks(key: np.ndarray, sign: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal held
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.repeat(np.diff(edge), np.diff(edge))
        small = (size > 1) & (size <= leaf)
        k, s = key[small], sign[small]
        for ahead in range(1, leaf):
            same = k[ahead:] == k[:-ahead]
            if not same.any():
                break
            pairs.append(np.stack([s[:-ahead][same], s[ahead:][same]], axis=1))
            held += int(same.sum())
        members = size > leaf
        if members.any():
            yield _route(key[members], sign[members], sign[members], False)
        if held > 500_000:
            yield pair_batch()
            pairs.clear()
            held = 0

    for batch in batches:
        new_key, new_sign = batch.column("key").to_numpy(), batch.column("sig").to_numpy()
        if large is not None:  # the rest of a large block needs no look at its other rows
            rest = int(np.searchsorted(new_key, large, side="right"))
            if rest:
                yield _route(new_key[:rest], new_sign[:rest], new_sign[:rest], False)
            new_key, new_sign = new_key[rest:], new_sign[rest:]
            if not len(new_key):
                continue
            large = None
        key, sign = np.concatenate([key, new_key]), np.concatenate([sign, new_sign])
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (sign[1:] != sign[:-1])
        key, sign = key[fresh], sign[fresh]
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        yield from blocks(key[:last], sign[:last])
        key, sign = key[last:], sign[last:]
        if len(key) > leaf:
            yield _route(key, sign, sign, False)
            large, key, sign = key[0], key[:0], sign[:0]
    yield from blocks(key, sign)
    if pairs:
        yield pair_batch()
    pairs.clear()
    give_back()


def _route(key: np.ndarray, a: np.ndarray, b: np.ndarray, pair: bool) -> pa.RecordBatch:
    hidden = np.full(len(key), True)
    return pa.record_batch([pa.array(key, mask=hidden if pair else None), pa.array(a), pa.array(b, mask=None if pair else hidden)], ["key", "a", "b"])


class Tree:
    """A packed R-tree. A level has, for each node, the largest corner, the smallest and largest size, and the smallest and largest component.

    Leaves are in order of size; those of a component with at least ``FAN`` points stand
    together, so that whole nodes of one component are passed over.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        _, code, many = np.unique(component, return_inverse=True, return_counts=True)
        self.order = np.lexsort((points.argmax(axis=1), sizes, np.where(many[code] >= FAN, code, -1)))
        own = component[self.order]
        level = [points[self.order], sizes[self.order], sizes[self.order], own, own]
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), FAN)
            level = [way.reduceat(column, cuts) for way, column in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), level, strict=True)]
            self.levels.append(level)

    def join(self, other: Tree) -> np.ndarray:
        """Pairs of points of different components whose summed minima reach the needed overlap.

        Of a join with itself, each pair once.
        """
        pairs = np.zeros((1, 2), np.int64)
        for level in range(max(len(self.levels), len(other.levels)) - 1, -1, -1):
            one, two = (tree.levels[min(level, len(tree.levels) - 1)] for tree in (self, other))
            kept, step = [pairs[:0]], max(64, (1 << 20) // one[0].shape[1])
            for begin in range(0, len(pairs), step):
                i, j = pairs[begin : begin + step].T
                near = (5 * one[2][i] >= 4 * two[1][j]) & (5 * two[2][j] >= 4 * one[1][i])
                near &= (np.minimum(one[3][i], two[3][j]) != np.maximum(one[4][i], two[4][j]))
                i, j = i[near], j[near]
                bound = np.minimum(one[0][i], two[0][j]).sum(axis=1, dtype=np.int64)
                reach = bound >= needed(one[1][i], two[1][j])
                kept.append(np.stack([i[reach], j[reach]], axis=1))
            pairs = np.concatenate(kept)
            if level and len(pairs):
                pairs = self._below(pairs, other, level - 1)
                if self is other:
                    pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        return np.stack([self.order[pairs[:, 0]], other.order[pairs[:, 1]]], axis=1)

    def _below(self, pairs: np.ndarray, other: Tree, level: int) -> np.ndarray:
        """Children on a level of both sides; a tree that is lower than that waits at its root."""
        for side, tree in enumerate((self, other)):
            if level >= len(tree.levels) - 1:
                continue
            child = pairs[:, side : side + 1] * FAN + np.arange(FAN)
            real = child < len(tree.levels[level][0])
            rest = np.repeat(pairs[:, 1 - side], FAN).reshape(-1, FAN)
            pairs = np.stack([child[real], rest[real]][:: 1 if side == 0 else -1], axis=1)
        return pairs


def _between(points: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, one: np.ndarray, two: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``one`` and ``two`` that pass the trees and the bound of all groups, and how far above the need each is."""
    fine = [folded(np.stack([points[k] for k in at]), groups) for at in ((one,) if one is two else (one, two))]
    trees = [Tree(folded(own, max(16, groups // 16)), sizes[at], component[at]) for own, at in zip(fine, (one, two), strict=False)]
    found = trees[0].join(trees[-1])
    kept, spare, step = [found[:0]], [np.zeros(0)], max(64, (1 << 20) // groups)
    for begin in range(0, len(found), step):
        i, j = found[begin : begin + step].T
        need = needed(sizes[one[i]], sizes[two[j]])
        over = np.minimum(fine[0][i], fine[-1][j]).sum(axis=1, dtype=np.int64) / need
        kept.append(found[begin : begin + step][over >= 1])
        spare.append(over[over >= 1])
    found = np.concatenate(kept)
    return np.stack([one[found[:, 0]], two[found[:, 1]]], axis=1), np.concatenate(spare)


def tree_pairs(points: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs of points of different components that may be linked, the closest first.

    With ``side`` (0 or 1 for each point) only pairs of both sides. Linked sizes differ by
    a quarter at most, so their points by one halving at most.
    """
    groups = np.array([len(own) - 1 for own in points], np.int64)
    side = np.zeros(len(points), int) if side is None else side
    sets = {(which, many): np.flatnonzero((side == which) & (groups == many)) for which, many in set(zip(side.tolist(), groups.tolist(), strict=True))}
    crossed = len({which for which, _ in sets}) > 1
    out, spare = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    for (which, many), one in sets.items():
        for (other, more), two in sets.items():
            if more < many or (which == other) == crossed or (crossed and more == many and which > other):
                continue
            if 4 * sizes[two].min() <= 5 * sizes[one].max():
                pairs, over = _between(points, sizes, component, one, two, many)
                out.append(pairs)
                spare.append(over)
    return np.concatenate(out)[np.argsort(-np.concatenate(spare), kind="stable")]


TASK = ("key", "t1", "t2")


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each pair of tiles, from rows in this order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in TASK], axis=1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(ids[a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of(rows: pa.Table, points: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The surviving pairs of a pair of tiles; of two tiles those between them."""
    tile = rows.column("tile").to_numpy()
    side = None if rows.column("t1")[0] == rows.column("t2")[0] else (tile == rows.column("t2")[0].as_py()).astype(int)
    if side is not None and side.min() == side.max():
        return np.zeros((0, 2), np.int64)
    return tree_pairs(points, sizes, rows.column("component").to_numpy(), side)


MEMBER = "key long, t1 int, t2 int, tile int, sig long, component long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of each pair of tiles that have a surviving pair there."""
    names = [part.split()[0] for part in MEMBER.split(", ")]
    waiting: list[pa.Table] = []
    held = 0
    for rows in _tasks(batches):
        points = [unpacked(raw) for raw in rows.column("point").to_pylist()]
        found = np.unique(_pairs_of(rows, points, rows.column("n").to_numpy()))
        if len(found):
            waiting.append(rows.select(names).take(pa.array(found)))
            held += len(found)
        if held > 10_000:
            yield from pa.concat_tables(waiting).combine_chunks().to_batches()
            waiting, held = [], 0
    if waiting:
        yield from pa.concat_tables(waiting).combine_chunks().to_batches()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of each pair of tiles, with their texts, to links that join all that is linked there."""
    for rows in _tasks(batches):
        sets = [own for _, _, data, starts in parts(rows.column("text").combine_chunks()) for own in shingles(data, starts)]
        found = _pairs_of(rows, [point(own) for own in sets], np.array([len(own) for own in sets], np.int64))
        _, code = np.unique(rows.column("component").to_numpy(), return_inverse=True)
        code = code.tolist()
        root = list(range(len(sets)))
        links = []

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in found.tolist():
            one, two = find(code[a]), find(code[b])
            if one == two:
                continue
            own, values = sets[a], sets[b]
            both = int((own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values).sum())
            if 100 * both >= 80 * (len(own) + len(values) - both):
                root[one] = two
                links.append((a, b))
        if links:
            sign, at = rows.column("sig").to_numpy(), np.array(links)
            yield pa.record_batch([pa.array(sign[at[:, 0]]), pa.array(sign[at[:, 1]])], ["a", "b"])
    give_back()


@arrow_udf(BooleanType())
def may_link(one: pa.Array, two: pa.Array, size_one: pa.Array, size_two: pa.Array) -> pa.Array:
    """Whether the summed minima of two points reach the needed overlap."""
    n, m = size_one.to_numpy(zero_copy_only=False), size_two.to_numpy(zero_copy_only=False)
    need = needed(n, m)
    out = np.zeros(len(n), bool)
    for k, (a, b) in enumerate(zip(one.to_pylist(), two.to_pylist(), strict=True)):
        a, b = unpacked(a), unpacked(b)
        groups = min(len(a), len(b)) - 1
        if 5 * min(n[k], m[k]) >= 4 * max(n[k], m[k]):
            out[k] = np.minimum(folded(a[None], groups), folded(b[None], groups)).sum() >= need[k]
    return pa.array(out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (a, part), the hub first, to the pairs that are linked."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        ones, twos = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        for low, high, data, starts in parts(batch.column("text")):
            found = []
            for k, values in enumerate(shingles(data, starts), low):
                if ones[k] == twos[k]:
                    hub, own = ones[k], values
                elif hub == ones[k] and len(own):
                    place = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    both = int((own[place] == values).sum())
                    if 100 * both >= 80 * (len(own) + len(values) - both):
                        found.append(k)
            yield pa.record_batch([pa.array(ones[found]), pa.array(twos[found])], ["a", "b"])
    give_back()


@arrow_udf(LongType())
def signed(text: pa.Array) -> pa.Array:
    """The signature of a text's set."""
    return pa.array(_signed(np.array([signature(own) for _, _, data, starts in parts(text) for own in shingles(data, starts)], np.uint64)))


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bit map of fixed size of the hashed keys."""
    place = F.pmod(F.xxhash64("key"), F.lit(SIEVE_BITS)) + 1  # bit positions count from 1
    maps = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(SIEVE_BITS // 8, np.uint8)
    for row in maps.collect():  # at most SIEVE_BITS / 32768 rows of 4 kB
        own = np.frombuffer(row["bits"], np.uint8)
        out[(row["bucket"] - 1) * 4096 :][: len(own)] = own
    return out


def _texts(wanted: DataFrame, docs: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """(sig, text) of the wanted classes; their keys are written below ``folder``."""
    spark = docs.sparkSession
    wanted.select("sig").distinct().join(classes.select("sig", "key"), "sig").write.parquet(f"{folder}/wanted")
    wanted = spark.read.parquet(f"{folder}/wanted")
    sieve = _sieve(wanted)

    @arrow_udf("boolean")
    def maybe(place: pa.Array) -> pa.Array:
        at = place.to_numpy(zero_copy_only=False)
        return pa.array((sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    place = F.pmod(F.xxhash64("key"), F.lit(SIEVE_BITS))
    likely = docs.where(maybe(place))
    texts = likely.join(wanted, likely["key"].eqNullSafe(wanted["key"])).select("sig", "text")
    return texts.where(signed("text") == F.col("sig")).dropDuplicates(["sig"])  # a key may have several texts


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets are linked, counted exactly; written below ``folder``."""
    spark = docs.sparkSession
    pairs.write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    texts = _texts(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")), docs, classes, folder)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("long").alias("split"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "split").alias("part"))
    hubs = dealt.select("a", F.col("a").alias("b"), "part").distinct()
    met = dealt.union(hubs).withColumnRenamed("b", "sig").join(texts, "sig").select("a", "part", F.col("sig").alias("b"), "text")
    ordered = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b") != F.col("a"))
    ordered.select("a", "b", "text").mapInArrow(_verify, "a long, b long").write.parquet(f"{folder}/links")
    return spark.read.parquet(f"{folder}/links")


def _by_task(rows: DataFrame, count: int) -> DataFrame:
    """The rows of a pair of tiles together; as many tasks as ``count`` rows ask for."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-count // ROWS_PER_TASK)), *TASK).sortWithinPartitions(*TASK)


def _tiled(members: DataFrame, docs: DataFrame, classes: DataFrame, parts_of: DataFrame, tile: int, folder: str) -> DataFrame:
    """Links (a, b) that join all that is linked within the blocks that are larger than a leaf."""
    spark = docs.sparkSession
    dealt = _by_task(_tiles(members, classes, parts_of, tile), members.count())
    dealt.mapInArrow(_search, MEMBER).write.parquet(f"{folder}/met")
    met = spark.read.parquet(f"{folder}/met")
    texts = _texts(met, docs, classes, folder)
    _by_task(met.join(texts, "sig"), met.count()).mapInArrow(_counted, "a long, b long").write.parquet(f"{folder}/links")
    return spark.read.parquet(f"{folder}/links")


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose points leave a link possible."""
    one = classes.select(F.col("sig").alias("a"), F.col("point").alias("point_a"), F.col("n").alias("n_a"))
    two = classes.select(F.col("sig").alias("b"), F.col("point").alias("point_b"), F.col("n").alias("n_b"))
    sized = pairs.join(one.select("a", "n_a", "point_a"), "a").join(two, "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    return sized.where(may_link("point_a", "point_b", "n_a", "n_b")).select("a", "b")


def _tiles(members: DataFrame, classes: DataFrame, parts_of: DataFrame, tile: int) -> DataFrame:
    """The points of each pair of tiles, of the blocks that are larger than a leaf.

    The points of a block's largest component never meet each other: tiles of the others
    (numbered from 0) meet among themselves and with tiles of the largest (from -1 down).
    """
    known = members.select("key", F.col("a").alias("sig")).distinct().join(parts_of, "sig", "left")
    known = known.withColumn("component", F.coalesce("component", "sig"))
    known = known.join(classes.select("sig", "n", "point"), "sig")
    weight = F.sum(F.greatest(F.lit(1.0), F.col("n") / LONG))
    sizes = known.groupBy("key", "component").agg(weight.alias("size")).groupBy("key").agg(
        F.max_by("component", F.struct("size", "component")).alias("largest"), F.max("size").alias("most"), F.sum("size").alias("all"), F.count("*").alias("components")
    )
    pieces = [F.greatest(F.lit(1), F.ceil(size / tile).cast("int")) for size in (F.col("all") - F.col("most"), F.col("most"))]
    mixed = sizes.where("components > 1").select("key", "largest", pieces[0].alias("others"), pieces[1].alias("larges"))
    rows = known.join(mixed, "key")
    large, draw = F.col("component") == F.col("largest"), F.xxhash64("sig")
    own = F.when(large, -1 - F.pmod(draw, "larges")).otherwise(F.pmod(draw, "others")).cast("int")
    among = F.sequence(F.lit(0), F.col("others") - 1)
    meets = F.when(large, among).otherwise(F.concat(among, F.sequence(-F.col("larges"), F.lit(-1))))
    held = ("key", "sig", "component", "tile", "n", "point")
    rows = rows.withColumn("tile", own).select(*held, F.explode(meets).alias("other"))
    return rows.select(*held, F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"))


def _largest(members: DataFrame) -> DataFrame:
    """Each class in the largest of its blocks only."""
    members = members.distinct()
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    chosen = members.join(sizes, "key").groupBy("a").agg(F.max(F.struct("size", "key")).alias("block"))
    return chosen.select("block.key", "a")


def _near_pairs(classes: DataFrame) -> DataFrame:
    """Each class with the smallest class that shares a minimum hash."""
    near = classes.select("sig", F.explode("near").alias("near"))
    stars = near.groupBy("near").agg(F.min("sig").alias("a"), F.count("*").alias("size")).where("size > 1")
    pairs = near.join(stars, "near").where("sig != a").groupBy(F.col("sig").alias("b")).agg(F.min("a").alias("a"))
    return pairs.select("a", "b")


def join(documents: DataFrame, key: str, text: str, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """(key, n_shingles, component) of each document, the component named by its smallest key.

    ``leaf`` and ``tile`` change the work and not the result.
    """
    return grouped(documents, key, text, leaf, tile).select("key", "n_shingles", "component")


def grouped(documents: DataFrame, key: str, text: str, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """As ``join``, with the text's ``xxhash64`` as mark, and first: true for one key and mark of each component.

    ``leaf`` and ``tile`` change the work and not the result.
    """
    spark: SparkSession = documents.sparkSession
    folder = scratch_path(spark, "jaccard")
    docs = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    marked = docs.withColumn("mark", F.xxhash64("text"))
    marked.mapInArrow(_profile, "key long, mark long, n long, sig long, point binary, near array<long>").write.parquet(f"{folder}/profile")
    profile = spark.read.parquet(f"{folder}/profile")
    row = F.struct(F.col("key").isNull().alias("unnamed"), "key", "mark")
    firsts = profile.where("sig is not null").groupBy("sig").agg(F.min(row).alias("row"), F.any_value("n").alias("n"), F.any_value("point").alias("point"), F.any_value("near").alias("near"))
    firsts = firsts.select("sig", "row.key", "row.mark", "n", "point", "near")
    firsts.write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")

    copies = _linked(_bounded(_near_pairs(classes), classes), docs, classes, f"{folder}/near")
    components(copies).write.parquet(f"{folder}/parts")
    parts_of = spark.read.parquet(f"{folder}/parts").withColumnRenamed("node", "sig")

    dealt = docs.select("text").mapInArrow(_prefixes(frequent(docs)), "key long, sig long")
    ordered = dealt.repartition("key").sortWithinPartitions("key", "sig")
    ordered.mapInArrow(lambda batches: _routes(batches, leaf), "key long, a long, b long").write.parquet(f"{folder}/routes")
    routes = spark.read.parquet(f"{folder}/routes")
    direct = routes.where("key is null").select("a", "b").distinct()
    for side in ("a", "b"):
        labels = parts_of.select(F.col("sig").alias(side), F.col("component").alias(f"{side}_part"))
        direct = direct.join(labels, side, "left").withColumn(f"{side}_part", F.coalesce(f"{side}_part", side))
    direct = _bounded(direct.where("a_part != b_part").select("a", "b"), classes)
    others = _linked(direct, docs, classes, f"{folder}/others")
    members = routes.where("key is not null").select("key", "a")
    first = _tiled(_largest(members), docs, classes, parts_of, tile, f"{folder}/first")
    known = copies.union(others).union(first)
    components(known).write.parquet(f"{folder}/known")
    parts_of = spark.read.parquet(f"{folder}/known").withColumnRenamed("node", "sig")
    rest = _tiled(members, docs, classes, parts_of, tile, f"{folder}/rest")

    whole = components(known.union(rest)).withColumnRenamed("node", "sig")
    names = classes.select("sig", "key", "mark").join(whole, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = names.groupBy("component").agg(F.min(row).alias("least"))
    named = names.join(least, "component").select("sig", F.col("least.key").alias("first_key"), F.col("least.mark").alias("first_mark"))
    joined = profile.select("key", "mark", "n", "sig").join(named, "sig", "left")
    alone = F.col("sig").isNull()
    return joined.select(
        "key",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("key")).otherwise(F.col("first_key")).alias("component"),
        "mark",
        (alone | (F.col("key").eqNullSafe(F.col("first_key")) & (F.col("mark") == F.col("first_mark")))).alias("first"),
    )
