"""Token ids of a corpus in Arrow files of fixed-size lists.

Documents are dealt by ascending key to buckets; each bucket's task encodes its rows in
order, appends the end id, and writes one Arrow file: every row is a list of ``length``
ids (the smallest unsigned type that holds the vocabulary) and a mask, the last one
padded. Buffers are not compressed, so a sequence is found by its number and read in
place. A second Arrow file beside it holds the key, start and length of each document. A
bucket's place in the whole stream is the sum of the counts of those before it: one
number for each file.

Files carry the name of the attempt that wrote them; those that count are listed in the
written manifest, so an attempt that was lost leaves nothing that is read.

Encoding is the tokenizers library's. Texts are cut at ASCII blanks, over which the
vocabulary's rules never look. Under the expected rules (NFC, lower case, word pattern,
byte letters) units of common letters and signs are cut into words as a slice, and only the
library's merges are called, once for each word the task has not met. Other units go
through the library as they are, each distinct one that the task has not met once.

Null and empty text: the end id alone. A null key comes before all others; rows with
equal keys follow each other by text. An empty table writes no file. Other columns are
never read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm.bpe import byte_letters
from wardlens.llm.files import create, fresh, opened
from wardlens.llm.ordering import buckets, dealt
from wardlens.llm.text import BLANK, LOWER, parts, range_hashes, runs

SLICE = 4 << 20
#: Sequences of a record batch.
BATCH = 256
REMEMBERED, LONG = 600_000, 256
# The rules under which the short way holds, and the units it takes.
RULES = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
COMMON = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
WORDS = regex.compile(RULES["pattern"])
#: The first byte of the common letters beyond ASCII, and the letters that a shortened word's ending begins with.
LATIN = 0xC3
SHORT = np.zeros(256, bool)
SHORT[list(b"stmdrvlSTMDRVL")] = True
#: Of the signs of ASCII: 1 letter, 2 digit, 3 any other, 0 blanks, controls and all beyond.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 3
KIND[0x30:0x3A] = 2
KIND[0x41:0x5B] = KIND[0x61:0x7B] = 1
MANIFEST = "bucket int, path string, index string, ids long, docs long"


class WordEncoder:
    """Encodes slices of texts with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer  # reads the setting above when it is loaded

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = [step.get("type") for step in (rules["normalizer"] or {}).get("normalizers", [])]
        cut = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.short_way = steps == RULES["normalizer"] and cut == RULES["pattern"]
        self.letters = byte_letters()
        self._forget()

    def _forget(self) -> None:
        #: The entry of each word or unit met; of each entry its ids in a row, and where they end.
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def _word(self, word: str) -> list[int]:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [token.id for token in self.model.tokenize(spelt)]

    def _unit(self, unit: str) -> list[int]:
        if self.short_way and "<|" not in unit and COMMON.fullmatch(unit):
            return list(chain.from_iterable(map(self._word, WORDS.findall(unit.lower()))))
        return self.library.encode(unit, add_special_tokens=False).ids

    def _cut(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with the words in lower case, where words or whole units begin and end, and which are whole.

        A unit stays whole and as it is if it has a letter or sign that is not common, or
        what may be a special string or a shortened word.
        """
        begin, end, _ = runs(~BLANK[data], starts)
        if not self.short_way:
            return data, begin, end, np.ones(len(begin), bool)
        before, after = np.zeros_like(data), np.zeros_like(data)
        before[1:], after[:-1] = data[:-1], data[1:]
        latin = (before == LATIN) & (data != 0x97) & (data != 0xB7)
        lead = (data == LATIN) & (after != 0x97) & (after != 0xB7)
        kind = KIND[data].astype(np.uint32)
        odd = (kind == 0) & ~BLANK[data] & ~latin & ~lead
        odd |= ((data == 0x27) & SHORT[after]) | ((data == 0x3C) & (after == 0x7C))
        kind[latin | lead] = 1
        alone = np.flatnonzero(kind == 2)
        kind[alone] = alone + 4  # no two digits alike
        at = np.unique(np.searchsorted(begin, np.flatnonzero(odd), side="right") - 1)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[begin[at]] += 1
        inside[end[at]] -= 1
        whole = np.cumsum(inside[:-1], dtype=np.int8) > 0
        kind[whole] = 2
        seen = LOWER[data]
        seen[latin & (data < 0x9F)] += 0x20
        seen[whole] = data[whole]
        begin, end, _ = runs(kind, starts)
        return seen, begin, end, whole[begin]

    def slice(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after the other, and where each row's begin."""
        if len(self.known) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self._forget()
        seen, begin, end, whole = self._cut(data, starts)
        _, first, place = np.unique(range_hashes(seen, begin, end), return_index=True, return_inverse=True)
        raw, known = seen.tobytes(), self.known
        names = [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        for name, unit in zip(names, whole[first].tolist(), strict=True):
            if name not in known:
                self.ids.extend(self._unit(name.decode()) if unit else self._word(name.decode()))
                known[name] = len(self.ends) - 1
                self.ends.append(len(self.ids))
        entry = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[place]
        for k in np.flatnonzero((end - begin)[first] > LONG).tolist():
            del known[names[k]]
        ids, ends = np.array(self.ids, np.int32), np.array(self.ends, np.int64)
        size = (ends[1:] - ends[:-1])[entry]
        edge = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.repeat(ends[entry] - edge[:-1], size) + np.arange(edge[-1])]
        return flat, edge[np.searchsorted(begin, starts)]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Writer:
    """One bucket's two files."""

    def __init__(self, folder: str, bucket: int, length: int, kind: pa.DataType):
        self.bucket, self.length, self.kind = bucket, length, kind
        name = fresh(folder, f"ids-{bucket:06d}")
        self.path, self.index = f"{name}.arrow", f"{name}.index.arrow"
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.listed = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [create(self.path), create(self.index)]
        self.ids = pa.ipc.new_file(self.files[0], self.schema)
        self.docs = pa.ipc.new_file(self.files[1], self.listed)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = self.rows = 0

    def add(self, keys: pa.Array, ids: np.ndarray, edge: np.ndarray) -> None:
        starts = pa.array(self.total + edge[:-1], pa.int64())
        self.docs.write_batch(pa.record_batch([keys, starts, pa.array(np.diff(edge), pa.int64())], schema=self.listed))
        self.waiting.append(ids.astype(self.kind.to_pandas_dtype()))
        self.held += len(ids)
        self.total += len(ids)
        self.rows += len(keys)
        if self.held >= BATCH * self.length:
            self._flush(self.held // (BATCH * self.length))

    def _flush(self, batches: int) -> None:
        everything = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind.to_pandas_dtype())
        size = BATCH * self.length
        for k in range(batches):
            self._batch(everything[k * size : (k + 1) * size], size)
        self.waiting = [everything[batches * size :]]
        self.held = len(self.waiting[0])

    def _batch(self, ids: np.ndarray, full: int) -> None:
        mask = np.arange(full) < len(ids)
        ids = np.pad(ids, (0, full - len(ids)))
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(values), self.length) for values in (ids, mask)]
        self.ids.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> pa.RecordBatch:
        self._flush(self.held // (BATCH * self.length))
        if self.held:
            self._batch(self.waiting[0], -(-self.held // self.length) * self.length)
        for part in (self.ids, self.docs, *self.files):
            part.close()
        row = {"bucket": self.bucket, "path": self.path, "index": self.index, "ids": self.total, "docs": self.rows}
        return pa.RecordBatch.from_pylist([row], pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("index", pa.string()), ("ids", pa.int64()), ("docs", pa.int64())]))


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are listed: a Parquet table of ``MANIFEST``."""

    manifest: str
    length: int


def write(docs: DataFrame, key: str, text: str, path: str, folder: str, end_id: int, length: int = 2048) -> TokenFiles:
    """Encode the texts with the vocabulary file and write them below a shared folder."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    most = max(end_id, *content["model"]["vocab"].values(), *(token["id"] for token in content["added_tokens"]))
    kind = pa.uint16() if most < 1 << 16 else pa.uint32()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bucket, count = buckets(rows.select("key"), "key")
    where = f"{folder}/files"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: _Writer | None = None
        for batch in batches:
            number = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if writer is None or writer.bucket != number[a]:
                    if writer is not None:
                        yield writer.close()
                    writer = _Writer(where, int(number[a]), length, kind)
                keys, texts = batch.column("key").slice(a, b - a), batch.column("text").slice(a, b - a)
                for low, high, data, starts in parts(texts, SLICE):
                    ids, edge = word_encoder(path).slice(data, starts)
                    writer.add(keys.slice(low, high - low), np.insert(ids, edge[1:], end_id), edge + np.arange(len(edge)))
        if writer is not None:
            yield writer.close()

    manifest = f"{folder}/manifest"
    ordered = dealt(rows.select(bucket.cast("int").alias("bucket"), "key", "text"), count, "key", "text")
    ordered.mapInArrow(written, MANIFEST).write.parquet(manifest)
    return TokenFiles(manifest, length)


def ids_between(path: str, length: int, start: int, stop: int) -> np.ndarray:
    """The ids at places start to stop of one file; only the batches that hold them are touched."""
    with opened(path) as file:
        return _range(pa.ipc.open_file(file), length, start, stop).copy()


def _range(reader: pa.ipc.RecordBatchFileReader, length: int, start: int, stop: int) -> np.ndarray:
    size = BATCH * length
    out = [np.zeros(0, reader.schema.field("ids").type.value_type.to_pandas_dtype())]
    for k in range(start // size, -(-stop // size)):
        values = reader.get_batch(k).column("ids").flatten().to_numpy()
        out.append(values[max(start - k * size, 0) : stop - k * size])
    return out[1] if len(out) == 2 else np.concatenate(out)


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """key, start in the whole stream, n_tokens and ids_crc32 of each document, read back from the files."""
    listed = spark.read.parquet(files.manifest).orderBy("bucket").collect()  # a row for each file
    length, base, todo = files.length, 0, []
    for row in listed:
        todo.append((row["path"], row["index"], base))
        base += row["ids"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as ids, opened(row["index"]) as index:
                    reader, docs = pa.ipc.open_file(ids), pa.ipc.open_file(index)
                    for k in range(docs.num_record_batches):
                        own = docs.get_batch(k)
                        starts, sizes = own.column("start").to_numpy(), own.column("n_tokens").to_numpy()
                        first = int(starts[0]) if len(starts) else 0
                        values = _range(reader, length, first, int(starts[-1] + sizes[-1]) if len(starts) else 0).astype("<u4")
                        sums = [zlib.crc32(values[a - first : a - first + n].tobytes()) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                        columns = [own.column("key"), pa.array(starts + row["base"]), own.column("n_tokens"), pa.array(sums, pa.int64())]
                        yield pa.record_batch(columns, ["key", "start", "n_tokens", "ids_crc32"])

    paths = spark.createDataFrame(todo, "path string, index string, base long").repartition(max(len(todo), 1))
    return paths.mapInArrow(found, "key long, start long, n_tokens long, ids_crc32 long")
