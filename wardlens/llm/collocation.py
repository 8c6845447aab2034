"""Collocations: phrases of two to four words that stand together more than their parts do.

Three passes count phrases exactly, each ended by a sum over all shards:

1. Each task cuts its texts into words and gathers those of one language in shards of
   about ``SHARD`` words, ended at pieces. A shard's words are numbered and written to a
   file; the words and their counts go to Spark, which sums them and numbers the frequent
   ones of a language over all shards.
2. Shard by shard the frequent words, other words being gaps, become an FM-index
   (``fmindex``), written to a file; pairs of words are read off its intervals.
3. Frequent pairs come back to the shards that hold them, where they are grown to the
   right and then to the left, as long as all pairs inside are frequent.

Phrases travel packed, a row for each shard and bucket of phrases; a bucket holds what about
``MEETING`` shards have. No phrase is more frequent than a part of it, so nothing frequent is lost. What comes
back to a shard is bounded by the shard. The scores are joins of the frequent phrases.

A language's share of the rows doesn't matter, as shards are cut by size. Null texts are
empty, null languages ``und``; a piece of more than ``SHARD`` words is a shard of its own.
Repeated rows count as often as they stand; a table without words gives no row. Other
columns are never read. Files of words carry random names and count if a written table names them,
so attempts that were lost leave nothing that is read; those of indexes carry their shard's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.files import create, opened
from wardlens.llm.fmindex import Index, Phrases
from wardlens.llm.text import LOWER, mix, parts, runs
from wardlens.session import scratch_path

#: Words of a shard.
SHARD = 2_000_000
UNKNOWN = "und"
# The bytes between pieces, and those between words of a piece.
STOPS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
STOP, WORD = np.zeros(256, np.uint8), np.ones(256, bool)
STOP[list(STOPS)] = 1
WORD[list(STOPS + BLANKS)] = False

VOCABULARY = "lang string, shard bigint, local int, word string, count bigint"
PACKED = "index bigint, bucket int, size int, data binary"
PHRASES = "one bigint, two bigint, count bigint"
#: Shards for each bucket in which phrases of all shards meet.
MEETING = 2
#: Places of the strata in which the first phrases of a language are found before they meet.
STRATA = 64


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of some texts in order, and whether a piece begins with each."""
    begin, end, row = runs(WORD[data].view(np.uint8), starts)
    stops = np.cumsum(STOP[data], dtype=np.int64)[begin]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    letters = LOWER[data[WORD[data]]]
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), fresh


def _store(folder: str, columns: dict[str, np.ndarray], number: int | None = None) -> int:
    """Write arrays to a file of a new or a given number, which appears whole; its number."""
    attempt = uuid.uuid4().int >> 65
    row = pa.record_batch([pa.array([values], pa.large_list(pa.from_numpy_dtype(values.dtype))) for values in columns.values()], list(columns))
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    path = f"{folder}/{attempt:016x}.arrow"
    with create(path) as file, pa.ipc.new_file(file, row.schema, options=options) as out:
        out.write_batch(row)
    if number is None:
        return attempt
    system, place = fs.FileSystem.from_uri(path)
    system.move(place, f"{place.rsplit('/', 1)[0]}/{number:016x}.arrow")
    return number


def _load(folder: str, number: int) -> dict[str, np.ndarray]:
    with opened(f"{folder}/{number:016x}.arrow") as file:
        row = pa.ipc.open_file(file).get_batch(0)
        return {name: row.column(name).flatten().to_numpy() for name in row.schema.names}


class _Shards:
    """Gathers the words of each language; the fullest one is written out when enough are held."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most
        self.waiting: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        self.held: dict[str, int] = {}

    def add(self, lang: str, words: pa.Array, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(words):
            high = min(at + self.most, len(words))
            if high < len(words):
                edges = np.flatnonzero(fresh[at + 1 : high + 1])
                after = np.flatnonzero(fresh[high + 1 :])
                high = at + 1 + int(edges[-1]) if len(edges) else high + 1 + int(after[0]) if len(after) else len(words)
            self.waiting.setdefault(lang, []).append((words.slice(at, high - at), fresh[at:high]))
            self.held[lang] = self.held.get(lang, 0) + high - at
            at = high
            if sum(self.held.values()) >= self.most:
                yield self.written(max(self.held, key=self.held.__getitem__))

    def written(self, lang: str) -> pa.RecordBatch:
        blocks = self.waiting.pop(lang)
        del self.held[lang]
        named = pa.concat_arrays([words for words, _ in blocks]).dictionary_encode()
        fresh = np.concatenate([begins for _, begins in blocks])
        local = named.indices.to_numpy().astype(np.int32) + 1
        tokens = np.zeros(len(local) + int(fresh.sum()) + 1, np.int32)
        tokens[np.arange(len(local)) + np.cumsum(fresh)] = local
        shard = _store(self.folder, {"tokens": tokens})
        count = np.bincount(local, minlength=len(named.dictionary) + 1)[1:]
        size = len(count)
        return pa.record_batch(
            [
                pa.array([lang] * size, pa.string()),
                pa.array(np.full(size, shard), pa.int64()),
                pa.array(np.arange(1, size + 1), pa.int32()),
                named.dictionary.cast(pa.string()),
                pa.array(count, pa.int64()),
            ],
            ["lang", "shard", "local", "word", "count"],
        )


@dataclass(frozen=True)
class Counts:
    """Words (id, lang, word, count), all words of a language, and phrases of packed ids that are frequent."""

    words: DataFrame
    totals: DataFrame
    phrases: DataFrame


def _kept(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    """The rows with ``count`` summed over all that are equal in some columns."""
    return rows.withColumn("count", F.sum("count").over(Window.partitionBy(*by)))


def _numbered(rows: DataFrame, path: str) -> DataFrame:
    """Rows sorted by word within partitions that hold all rows of a word, with ``id`` (1, 2, ...) and its ``first`` row.

    Each written part numbers its own words; a number for each part goes through the driver.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, base = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(name).dictionary_encode() for name in ("lang", "word")]
            code = np.stack([column.indices.to_numpy() for column in key])
            first = np.ones(batch.num_rows, bool)
            first[1:] = (code[:, 1:] != code[:, :-1]).any(axis=0)
            first[0] = last != (batch.column("lang")[0].as_py(), batch.column("word")[0].as_py())
            place = base + np.cumsum(first)
            base, last = int(place[-1]), (batch.column("lang")[-1].as_py(), batch.column("word")[-1].as_py())
            added = [pa.array(np.full(len(place), part)), pa.array(place), pa.array(first)]
            yield pa.record_batch([*batch.columns, *added], [*batch.schema.names, "part", "place", "first"])

    kept = _kept(rows.mapInArrow(own, f"{VOCABULARY}, part bigint, place bigint, first boolean"), path)
    sizes = {row["part"]: row["size"] for row in kept.groupBy("part").agg((F.max("place") + 1).alias("size")).collect()}
    if sum(sizes.values()) >= 1 << 31:
        raise ValueError("more frequent words than numbers of 31 bits")
    ahead, begins = 1, []
    for part in sorted(sizes):
        begins.append((part, ahead))
        ahead += sizes[part]
    begin = kept.sparkSession.createDataFrame(begins, "part bigint, ahead bigint")
    return kept.join(begin, "part").withColumn("id", F.col("ahead") + F.col("place"))


def _packed(words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to four words as two numbers of two ids each, 0 where there is no word."""
    full = np.zeros((len(words), 4), np.int64)
    full[:, : words.shape[1]] = ids[words]
    return full[:, 0] << 32 | full[:, 1], full[:, 2] << 32 | full[:, 3]


def _pack(one: np.ndarray, two: np.ndarray, count: np.ndarray) -> bytes:
    """Packed phrases in ascending order and their counts: the bytes of equal weight side by side, compressed."""
    halves = [half for values in (one, two, count) for half in (values >> 32, values & 0xFFFFFFFF)]
    halves[0] = np.diff(halves[0], prepend=0)
    planes = np.stack(halves).astype("<u4").view(np.uint8).reshape(6, -1, 4).transpose(0, 2, 1)
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(size: int, data: bytes) -> np.ndarray:
    """What ``_pack`` was given, as three rows."""
    planes = np.frombuffer(pa.decompress(data, 24 * size, codec="zstd", asbytes=True), np.uint8).reshape(6, 4, size)
    halves = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(6, size).astype(np.int64)
    halves[0] = np.cumsum(halves[0])
    return halves[::2] << 32 | halves[1::2]


def _rows(found: list[tuple[int | None, int, int, bytes]]) -> pa.Table:
    names, types = ("index", "bucket", "size", "data"), (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({name: pa.array([row[k] for row in found], kind) for k, (name, kind) in enumerate(zip(names, types, strict=True))})


def _dealt(index: int, one: np.ndarray, two: np.ndarray, count: np.ndarray, buckets: int) -> pa.Table:
    """The phrases of one index, a row for each bucket; the same phrase is in the same bucket everywhere."""
    bucket = (mix(one.astype(np.uint64) ^ mix(two.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((two, one, bucket))
    one, two, count, bucket = one[order], two[order], count[order], bucket[order]
    own, begin = np.unique(bucket, return_index=True)
    ends = np.append(begin, len(bucket))[1:].tolist()
    return _rows([(index, at, b - a, _pack(one[a:b], two[a:b], count[a:b])) for at, a, b in zip(own.tolist(), begin.tolist(), ends, strict=True)])


def _often(table: pa.Table, least: int, back: bool) -> pa.Table:
    """The phrases of a bucket that are frequent, with their counts over all indexes, as a row without index.

    With ``back`` also those of each index.
    """
    one, two, count = np.concatenate([_unpack(row["size"], row["data"]) for row in table.select(["size", "data"]).to_pylist()], axis=1)
    order = np.lexsort((two, one))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    total = np.add.reduceat(count[order], np.flatnonzero(first))
    enough = total >= least
    kept = np.empty(len(order), bool)
    kept[order] = enough[np.cumsum(first) - 1]
    head = order[first][enough]
    bucket, out = table.column("bucket")[0].as_py(), []
    if len(head):
        out.append((None, bucket, len(head), _pack(one[head], two[head], total[enough])))
    end = 0
    for row in table.select(["index", "size"]).to_pylist() if back else []:
        at = end + np.flatnonzero(kept[end : end + row["size"]])
        end += row["size"]
        if len(at):
            out.append((row["index"], bucket, len(at), _pack(one[at], two[at], count[at])))
    return _rows(out)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each phrase of packed rows."""
    for batch in batches:
        for row in batch.to_pylist():
            one, two, count = _unpack(row["size"], row["data"])
            yield pa.record_batch([pa.array(one), pa.array(two), pa.array(count)], ["one", "two", "count"])


def counts(docs: DataFrame, text: str, lang: str, least: int, shard_words: int = SHARD) -> Counts:
    """Words and phrases of up to four words that stand in the texts of a language ``least`` times or more."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "collocation")
    shards, indexes = f"{folder}/shards", f"{folder}/indexes"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Shards(shards, shard_words)
        for batch in batches:
            named = batch.column("lang").dictionary_encode()
            code = named.indices.to_numpy()
            for k, name in enumerate(named.dictionary.to_pylist()):
                for _, _, data, starts in parts(batch.column("text").take(pa.array(np.flatnonzero(code == k)))):
                    yield from gathered.add(name, *words_of(data, starts))
        for name in list(gathered.waiting):
            yield gathered.written(name)

    def indexed(table: pa.Table) -> pa.Table:
        local, ids = table.column("local").to_numpy(), table.column("id").to_numpy()
        order = np.argsort(ids)
        shard = table.column("shard")[0].as_py()
        tokens = _load(shards, shard)["tokens"]
        number = np.zeros(max(int(tokens.max()), int(local.max())) + 1, np.int32)
        number[local[order]] = np.arange(1, len(ids) + 1)
        tokens, ids = number[tokens], np.concatenate([[0], ids[order]])
        gap = tokens == 0
        tokens = tokens[~gap | ~np.concatenate([[False], gap[:-1]])]
        before, after = Index.transforms(tokens, len(ids))
        # Each attempt writes the same, under the shard's number: the pairs need no table that says which one counts.
        name = _store(indexes, {"before": before, "after": after, "ids": ids}, shard)
        index = Index(before, after, len(ids))
        found = index.grown(index.single(), right=True)
        return _dealt(name, *_packed(found.words, ids), found.count, buckets)

    def grown(table: pa.Table) -> pa.Table:
        name = table.column("index")[0].as_py()
        stored = _load(indexes, name)
        ids = stored["ids"]
        index = Index(stored["before"], stored["after"], len(ids))
        pair = np.sort(np.concatenate([_unpack(row["size"], row["data"])[0] for row in table.select(["size", "data"]).to_pylist()]))
        one, two = (np.searchsorted(ids, part) for part in (pair >> 32, pair & 0xFFFFFFFF))
        known = one * len(ids) + two

        def frequent(phrases: Phrases, at: int) -> Phrases:
            key = phrases.words[:, at] * len(ids) + phrases.words[:, at + 1]
            near = np.minimum(np.searchsorted(known, key), len(known) - 1)
            return phrases.where(known[near] == key)

        three = frequent(index.grown(index.pairs(one, two), right=True), 1)
        four = frequent(index.grown(three, right=False), 0)
        packed = [_packed(found.words, ids) for found in (three, four)]
        one, two = (np.concatenate([part[k] for part in packed]) for k in (0, 1))
        return _dealt(name, one, two, np.concatenate([three.count, four.count]), buckets)

    def met(packed: DataFrame, back: bool) -> DataFrame:
        dealt = packed.repartition(buckets, "bucket").groupBy("bucket")
        return dealt.applyInArrow(lambda table: _often(table, least, back), PACKED)

    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # One shuffle each counts words and pairs and tells the rows of their shards: a word has a
    # row for each shard that holds it, a pair a place in one of the shard's packed rows.
    vocabulary = _kept(rows.mapInArrow(cut, VOCABULARY), f"{folder}/vocabulary")
    often = F.col("count") >= least
    frequent = _summed(vocabulary, "lang", "word").where(often).sortWithinPartitions("lang", "word")
    numbered = _numbered(frequent, f"{folder}/held")
    words, local = numbered.where("first").select("id", "lang", "word", "count"), numbered.select("shard", "local", "id")
    # As many tasks as shards: what is shuffled is small, what is read from the files isn't.
    tasks = max(1, vocabulary.select("shard").distinct().count())
    buckets = -(-tasks // MEETING)
    pairs = local.repartition(tasks, "shard").groupBy("shard").applyInArrow(indexed, PACKED)
    back = _kept(met(pairs, True), f"{folder}/back")
    longer = back.where("index is not null").repartition(tasks, "index").groupBy("index").applyInArrow(grown, PACKED)
    phrases = back.where("index is null").union(met(longer, False)).select("size", "data").mapInArrow(_spread, PHRASES)
    none = F.lit(0).cast("bigint").alias("two")
    single = words.select(F.shiftleft("id", 32).alias("one"), none, "count")
    totals = vocabulary.groupBy("lang").agg(F.sum("count").alias("n"))
    return Counts(words, totals, _kept(single.union(phrases), f"{folder}/phrases"))


def _key(*words: Column) -> Column:
    """A phrase of up to four word ids as the two numbers of the phrase table."""
    full = [*words, *[F.lit(0).cast("bigint")] * (4 - len(words))]
    packed = [F.shiftleft(full[k], 32).bitwiseOR(full[k + 1]) for k in (0, 2)]
    return F.struct(packed[0].alias("one"), packed[1].alias("two"))


def _ids() -> list[Column]:
    low = lambda name: F.col(name).bitwiseAND(0xFFFFFFFF)
    return [F.shiftright("one", 32), low("one"), F.shiftright("two", 32), low("two")]


def _by_length(made: dict[int, Column]) -> Column:
    """A value for phrases of two, three and four words."""
    w = _ids()
    return F.when(w[3] > 0, made[4]).when(w[2] > 0, made[3]).otherwise(made[2])


def scored(found: Counts) -> DataFrame:
    """Phrases of two words and more: count a, that of both parts of the lowest-scoring cut (l, r), the score.

    The score of a cut is 2000000 a / (l + r), rounded down; ties go to the shortest first
    part. Phrases of which a longer one holds 80 % of the occurrences are left out: if one
    does, so does one that is a word longer, as counts don't rise with the length.
    """
    phrases, w = found.phrases, _ids()
    several = phrases.where(w[1] > 0).withColumnRenamed("count", "a")
    inner = {m: F.array(_key(*w[: m - 1]), _key(*w[1:m])) for m in (2, 3, 4)}
    longer = several.where(w[2] > 0).select(F.col("a").alias("more"), F.explode(_by_length(inner)).alias("inner"))
    longer = longer.groupBy("inner.one", "inner.two").agg(F.max("more").alias("more"))
    held = F.expr("cast(more as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * 80")
    kept = several.join(longer, ["one", "two"], "left").where(~F.coalesce(held, F.lit(False)))
    cuts = {m: F.array(*(F.struct(F.lit(k).alias("k"), _key(*w[:k]).alias("left"), _key(*w[k:m]).alias("right")) for k in range(1, m))) for m in (2, 3, 4)}
    parted = kept.select("one", "two", "a", F.inline(_by_length(cuts)))
    size = lambda name: phrases.select(F.struct("one", "two").alias(name), F.col("count").alias(name[0]))
    parted = parted.join(size("left"), "left").drop("left").join(size("right"), "right").drop("right")
    parted = parted.withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000 div (l + r)"))
    lowest = parted.groupBy("one", "two", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("one", "two", "a", "cut.*")


def _first(rows: DataFrame, most: int, place: Column, strata: Column, *order: Column) -> DataFrame:
    """The rows of each language whose ``place`` in an order is at most ``most``, as ``rank``.

    First within strata, so that no task sorts more than its share or that many rows of each.
    """
    rows = rows.withColumn("stratum", F.pmod(strata, F.lit(STRATA)))
    for by in (["lang", "stratum"], ["lang"]):
        rank = place.over(Window.partitionBy(*by).orderBy(*order))
        rows = rows.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most)
    return rows.drop("stratum")


def collocations(docs: DataFrame, text: str, lang: str, least: int = 30, most: int = 2000, shard_words: int = SHARD) -> DataFrame:
    """The first ``most`` phrases of each language by score, count and phrase, with the counts behind the score."""
    found = counts(docs, text, lang, least, shard_words)
    rows = scored(found).select("*", *(F.coalesce(word, F.lit(0)).alias(f"w{k}") for k, word in enumerate(_ids())))
    word = lambda k: [F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")]
    rows = rows.join(found.words.select("lang", *word(0)), "w0")
    # Ties of the last place stay until they have their words, which only these rows need.
    by_score = [F.desc("score"), F.desc("a")]
    rows = _first(rows, most, F.rank(), F.xxhash64("one", "two"), *by_score).drop("rank")
    for k in (1, 2, 3):
        rows = rows.join(found.words.select(*word(k)), f"w{k}", "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *(f"word{k}" for k in range(4))))
    rows = _first(rows, most, F.row_number(), F.xxhash64("phrase"), *by_score, F.asc("phrase"))
    return rows.join(found.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
