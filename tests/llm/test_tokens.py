import hashlib
import random
import shutil
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import empty_docs, odd_docs, odd_rows
from wardlens.llm import encoding, tokencount, tokenfiles
from wardlens.llm.text import parts
from wardlens.session import scratch_path

BYTES, WORDS, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def texts():
    rng = random.Random(1)
    odd = [t or "" for _, t in odd_rows() if t is None or len(t) < 100_000]
    odd += ["a  b\n\n c\t\n", " it's  we'll x  y", "<|endoftext|> a<|startoftext|>b<s> </s>", "日本語 テキスト　です 12345 ½", "'s 't don't", "a\x85b \x0b\x0c c\x1c\x1dz", "\x00 a", "ÀÉ ß ΑΣ Σ. İI", "<|STARTOFTEXT|>", "thethininginon" * 700, "   lead", "trail   ", "a ▁b▁ ▁▁c"]
    return odd + ["".join(rng.choice("abcdefthein  \n'.!1é日ÉS") for _ in range(rng.randint(0, 60))) for _ in range(1500)]


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(BYTES)
    encoder, column = encoding.Encoder(BYTES), texts()
    for low, _, data, starts in parts(pa.array(column), 4096):
        tokens, place, edge = encoder.slice(data, starts)
        for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True), low):
            own = [t for unit in place[a:b] for t in tokens[unit]]
            assert own == library.encode(column[k], add_special_tokens=False).ids, column[k]
            assert encoder.decoded(tuple(own)).decode(errors="replace") == library.decode(own, skip_special_tokens=False)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 5)
    monkeypatch.setattr("wardlens.llm.bpe.REMEMBERED", 5)
    test_encoder_equals_the_library()


def test_words_in_use_are_not_learned_again(monkeypatch):
    """What a slice uses outlives the turn before it; only words of two turns ago are forgotten."""
    monkeypatch.setattr(encoding, "REMEMBERED", 5)
    encoder, learned = encoding.Encoder(BYTES), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (learned.append(words), learn(words)))
    often = "one two three four five six seven"
    for text in (often, often, often + " eight, nine", often, "ten eleven twelve thirteen fourteen fifteen", "a b c d e f g", often):
        encoder.slice(*next(parts(pa.array([text])))[2:])
    assert learned[0] == {"one", " two", " three", " four", " five", " six", " seven"} == learned[6]
    assert [len(words) for words in learned[1:4]] == [0, 3, 0]
    assert len(encoder.older) < 20 and len(encoder.known) < 20


def test_the_walk_looks_at_tokens_that_end_there_only():
    """Each place asks for one remembered step, not for every length that tokens of its last letters have."""
    merges = encoding.Encoder(BYTES).merges
    state, looked, keys = "", 0, set()
    for letter in "thethininginon" * 50:
        keys.add(state + letter)
        state, found = merges._step(state + letter)
        assert all(merges.names[token] == state[len(state) - size :] for size, token in found)
        assert [size for size, _ in found] == [size for size in range(len(state), 1, -1) if state[-size:] in merges.ids]
        looked += len(found)
    assert len(keys) < 100 and looked < 14 * 50 * 4


def test_words_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    encoder, column = tokenfiles.WordEncoder(WORDS), texts()
    assert encoder.short_way
    for low, _, data, starts in parts(pa.array(column), 4096):
        ids, edge = encoder.slice(data, starts)
        for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True), low):
            assert ids[a:b].tolist() == library.encode(column[k], add_special_tokens=False).ids, column[k]


def test_units_met_before_are_not_encoded_again(monkeypatch):
    """A later slice only looks up what the task has met, also units that go through the library."""
    encoder, asked = tokenfiles.WordEncoder(WORDS), []
    for name in ("_unit", "_word"):
        own = getattr(encoder, name)
        monkeypatch.setattr(encoder, name, lambda text, own=own: (asked.append(text), own(text))[1])
    text = "One, two (one) 12 日本語 É×é one"
    first = encoder.slice(*next(parts(pa.array([text])))[2:])[0]
    assert len(asked) == len(set(asked)) and "日本語" in asked
    asked.clear()
    again = encoder.slice(*next(parts(pa.array(["ONE! 日本語", text])))[2:])[0]
    assert asked == ["!"]
    assert again[-len(first) :].tolist() == first.tolist()


def test_words_cut_as_a_slice_equal_the_library(monkeypatch):
    library, rng = Tokenizer.from_file(WORDS), random.Random(3)
    signs = "aaeststmdvrlLT''''  .,<|>/09 ÀÉßÿ×÷Øñ½日é\x00\x7f"
    column = ["", "<", "|endoftext|>", "'", "s", "<|ENDOFTEXT|> It'S L'Éte", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000))]
    expected = [library.encode(text, add_special_tokens=False).ids for text in column]
    for remembered, long in ((5, 4), (600_000, 256)):
        monkeypatch.setattr(tokenfiles, "REMEMBERED", remembered)
        monkeypatch.setattr(tokenfiles, "LONG", long)
        encoder = tokenfiles.WordEncoder(WORDS)
        for low, _, data, starts in parts(pa.array(column), 3000):
            ids, edge = encoder.slice(data, starts)
            for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True), low):
                assert ids[a:b].tolist() == expected[k], column[k]


@pytest.mark.parametrize("chunk", [4096, 50])
def test_counts_equal_the_library(spark, monkeypatch, chunk):
    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    monkeypatch.setattr(tokencount, "STATES", 2000 if chunk == 50 else 300_000)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter, column = tokencount.Counter(PIECES), [t.replace("▁", " ") for t in texts()]
    found = [n for _, _, data, starts in parts(pa.array(column), 4096) for n in counter.slice(data, starts).tolist()]
    assert found == [len(own) for own in library.encode(column)]


def test_counts_of_a_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([(t,) for t in [*texts()[:60], None]], "text string")
    for table in (docs, odd_docs(spark)):
        for text, n in table.select("text", tokencount.count_tokens(F.col("text"), PIECES)).collect():
            assert (n or 0) == len(library.encode(text or ""))
    assert empty_docs(spark).select(tokencount.count_tokens(F.col("text"), PIECES)).collect() == []


def test_digests_and_ids_of_a_table(spark):
    library = Tokenizer.from_file(BYTES)
    rows = odd_docs(spark).select("text", encoding.digests(F.col("text"), BYTES).alias("own"), encoding.encode(F.col("text"), BYTES).alias("ids")).collect()
    for text, own, ids in rows:
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert ids == expected and own["n_tokens"] == len(expected)
        assert own["ids_sha256"] == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert empty_docs(spark).select(encoding.digests(F.col("text"), BYTES)).collect() == []


def test_token_files(spark):
    library = Tokenizer.from_file(WORDS)
    folder = scratch_path(spark, "tokens")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        files = tokenfiles.write(odd_docs(spark), "doc_id", "text", WORDS, folder, end_id=2, length=16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    order = sorted(((k, t or "") for k, t in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected, start, stream = [], 0, []
    for key, text in order:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        stream += ids
    assert sorted(map(tuple, tokenfiles.read(spark, files).collect()), key=str) == sorted(expected, key=str)
    listed = spark.read.parquet(files.manifest).orderBy("bucket").collect()
    assert len(listed) > 1 and sum(r["ids"] for r in listed) == len(stream)
    at = 0
    for row in listed:
        with tokenfiles.opened(row["path"]) as file:
            reader = pa.ipc.open_file(file)
            assert reader.schema.field("ids").type == pa.list_(pa.uint16(), 16)
            table = reader.read_all()
        mask = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("mask").chunks])
        ids = np.concatenate([c.flatten().to_numpy() for c in table.column("ids").chunks])
        assert ids[mask].tolist() == stream[at : at + row["ids"]]
        some = slice(row["ids"] // 3, row["ids"] // 2)
        assert tokenfiles.ids_between(row["path"], 16, some.start, some.stop).tolist() == ids[some].tolist()
        at += row["ids"]


def test_no_rows_no_token_files(spark):
    files = tokenfiles.write(empty_docs(spark), "doc_id", "text", WORDS, scratch_path(spark, "tokens"), end_id=2)
    assert tokenfiles.read(spark, files).collect() == []


def test_a_task_drops_its_vocabulary(spark, tmp_path):
    """Without ``keep`` no task process holds the encoder after the task."""
    path = str(tmp_path / "own.json")
    shutil.copy(BYTES, path)
    docs = spark.createDataFrame([("one two three",)] * 16, "text string").repartition(16)
    assert docs.select(encoding.digests(F.col("text"), path, keep=False).alias("own")).where("own.n_tokens > 0").count() == 16

    def held(batches):
        from wardlens.llm import encoding as module  # that of the task process

        time.sleep(0.2)  # so that every process gets a task
        yield from (pa.record_batch([pa.array([path in module._ENCODERS] * batch.num_rows)], ["held"]) for batch in batches)

    assert spark.range(0, 64, 1, 64).mapInArrow(held, "held boolean").where("held").count() == 0
