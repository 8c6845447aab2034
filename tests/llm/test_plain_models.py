"""Learned operators and the pipeline against plain loops, given the models or the sample."""

import hashlib
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import odd_rows
from tests.llm.test_jaccard import brute as components
from tests.llm.test_tiling import brute as tiled
from wardlens.llm import langid, quality, queries, text, tiling

SF_DIR = "/root/testdata/sf0.001"
FULL = (1 << 64) - 1


def letter(byte):
    return byte >= 128 or chr(byte).isascii() and chr(byte).isalpha()


def plain_trigrams(string, bits):
    """Hashes of the bytes around each letter, in lower case; a blank for all that is none."""
    data = [b + 32 if 65 <= b <= 90 else b if letter(b) else 32 for b in string.encode()]
    padded = [32, *data, 32]
    codes = [(a << 16) | (b << 8) | c for a, b, c in zip(padded, padded[1:], padded[2:], strict=False) if b != 32]
    return [((code * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits) for code in codes]


def duel(names, margins):
    wins, total, chance = Counter(), Counter(), Counter()
    for one in names:
        for two in names:
            if (one, two) in margins:
                m = margins[one, two]
                wins[one if m >= 0 else two] += 1
                total[one] += m
                total[two] -= m
                sure = 1 / (1 + math.exp(-3 * m))
                chance[one] += sure
                chance[two] += 1 - sure
    best = min(names, key=lambda name: (-(wins[name] + 0.4 * math.tanh(total[name] / len(names))), name))
    return best, chance[best] / (len(names) - 1) if len(names) > 1 else 1.0


def plain_language(model, string):
    if string is None or not any(unicodedata.category(c)[0] == "L" for c in string):
        return "und", 0.0
    grams = plain_trigrams(string, langid.BITS)
    margins = {pair: sum(float(w[g]) for g in grams) / len(grams) + b for pair, (w, b) in model.pairs.items()}
    family, odds = duel(sorted(model.families), margins)
    lang, sure = duel(model.families[family], margins)
    return lang, odds * sure


def plain_known(held, lang, string):
    if lang == "und":
        return False
    bits, cut = held[lang]
    grams = plain_trigrams(string, langid.WIDE_BITS)
    return sum(int(bits[g // 8]) >> (7 - g % 8) & 1 for g in grams) / len(grams) >= cut


def mixed(value):
    value ^= value >> 30
    value = value * 0xBF58476D1CE4E5B9 & FULL
    value ^= value >> 27
    value = value * 0x94D049BB133111EB & FULL
    return value ^ value >> 31


def plain_features(string):
    """Places of the tokens and of the pairs of neighbours."""
    words = []
    for token in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (string or "").encode()):
        total, power = len(token), 1
        for byte in token:
            total = total + int(text._VALUES[byte]) * power & FULL
            power = power * text._BASE & FULL
        words.append(mixed(total))
    pairs = []
    for one, two in zip(words, words[1:], strict=False):
        value = ((2 * 0xD6E8FEB86659FD93 + one) * 0xD6E8FEB86659FD93 + two) & FULL
        pairs.append(int(quality.REPEAT) if one == two else mixed(value))
    return [value >> (64 - quality.BITS) for value in words + pairs]


def plain_quality(model, string):
    places = plain_features(string)
    dot = quality.MASS * sum(float(model.weights[p]) for p in places) / max(len(places), 1)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, dot + model.bias))))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def short_rows():
    return [t for _, t in odd_rows() if t is None or len(t) < 20_000]


def test_language_of_each_document(spark, docs):
    model, held = queries.language_model(docs), queries.language_vocabulary(docs)
    texts = [r["text"] for r in docs.select("text").collect()] + short_rows()
    given = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for row in given.select("k", langid.predict(model, F.col("text"), held).alias("p")).collect():
        lang, score = plain_language(model, texts[row["k"]])
        assert row["p"]["lang"] == lang and math.isclose(row["p"]["score"], score, abs_tol=1e-6)
        assert row["p"]["known"] == plain_known(held, lang, texts[row["k"]])


def test_quality_of_each_document(spark, docs):
    model = queries.quality_model(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    texts = [r["text"] for r in docs.select("text").collect()] + short_rows()
    given = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for row in given.select("k", quality.score(model, F.col("text")).alias("p")).collect():
        assert math.isclose(row["p"], plain_quality(model, texts[row["k"]]), abs_tol=1e-6)


def test_follow_the_regularised_leader(spark, docs):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    learn = docs.join(labels, "doc_id").select("doc_id", "text", "quality").where("quality in (0, 1)").limit(60)
    learn = spark.createDataFrame(learn.collect(), learn.schema)
    model = quality.fit(learn, "text", "quality", "doc_id")
    order = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(quality.SHARDS)).alias("shard"), F.xxhash64("doc_id", F.lit(2), "text").alias("turn")
    rows = sorted(learn.select(*order, "text", "quality").collect())
    bias, total, shards = 1 << quality.BITS, Counter(), {r["shard"] for r in rows}
    for shard in shards:
        z, n = Counter(), Counter()

        def weight(i, z=z, n=n):
            if abs(z[i]) <= quality.L1:
                return 0.0
            return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

        for _ in range(quality.EPOCHS):
            for row in (r for r in rows if r["shard"] == shard):
                places = Counter(plain_features(row["text"]))
                x = {i: float(np.float32(quality.MASS * c / places.total())) for i, c in places.items()} | {bias: 1.0}
                w = {i: weight(i) for i in x}
                dot = sum(w[i] * v for i, v in x.items())
                wrong = 1 / (1 + math.exp(-max(-30.0, min(30.0, dot)))) - row["quality"]
                for i, v in x.items():
                    g = wrong * v
                    z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                    n[i] += g * g
        for i in z:
            total[i] += weight(i) / len(shards)
    expected = np.zeros(bias + 1)
    for i, w in total.items():
        expected[i] = w
    assert np.any(expected) and np.allclose(expected[:-1], model.weights, atol=1e-5) and math.isclose(expected[-1], model.bias, abs_tol=1e-5)


def words(string):
    return re.findall(r"[^\W_]+", string.lower())


def test_pipeline(spark, docs):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect() if r["text"]]
    model, held = queries.language_model(docs), queries.language_vocabulary(docs)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(kept) == docs.count()
    kept = {k: t for k, t in kept.items() if plain_known(held, plain_language(model, t)[0], t)}
    scored = queries.quality_model(docs.where(F.col("doc_id").isin(list(kept))), labels)
    kept = {k: t for k, t in kept.items() if plain_quality(scored, t) >= queries.QUALITY_CUT}
    first = {k: least for k, _, least in components(list(kept.items()))}
    kept = {k: t for k, t in kept.items() if first[k] == k}

    def holds(string, item):
        # A tiling covers no more than the tokens in common.
        own = words(string)
        if 2 * (Counter(own) & Counter(item)).total() < len(item):
            return False
        return 2 * tiled(item, own, tiling.MIN_MATCH) >= len(item)

    kept = {k: t for k, t in kept.items() if not any(holds(t, item) for item in items)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for k, t in kept.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        expected[k] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in found} == expected
    assert 0 < len(expected) < docs.count() and len(found) == len(expected)
