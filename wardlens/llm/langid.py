"""Language of a text: its family first, then pairwise linear SVMs inside the family.

Features are relative frequencies of hashed byte trigrams centred on a letter, over
the whole text. The languages of the labelled rows are grouped by ``FAMILIES`` (one
that is not listed is a family of its own). Between each two families, and between
each two languages of a family, a squared-hinge linear SVM is trained in a Spark task
of its own, on about ``rows_per_lang`` rows of each language. A text goes to the
family, then to the language, that wins most of its pairs (ties: the larger sum of
margins, then the first by name). The score is the mean probability of the winner
against its opponents, family times language.

The score compares known languages only, so ``vocabulary`` tells other text apart: for
each language, the trigrams that ``HELD`` of its sampled rows or more hold, and a cut,
``KNOWN`` of the median share of such trigrams in a row when the row itself is left out.
A text whose share for its language is below the cut is in another language or script,
or letter garbage. A language of one row has cut 0, as nothing is known of its spread.

Null text, empty text and text without a letter: language ``und``, score 0. No
labelled row at all: every text is ``und``. One labelled language: always that one,
score 1. Repeated rows are scored alike; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from wardlens.llm.text import LOWER, WORDY, parts, returned, sums

# ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "en de nl sv da no is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk pl cs sk bg sr hr sl",
    "indic": "hi bn mr ne pa gu",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz",
    "uralic": "fi hu et",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
BITS = 12
#: Of the trigrams that tell known text from other.
WIDE_BITS = 18
HELD, KNOWN = 0.02, 0.7
UNKNOWN = "und"
_LETTER = WORDY.copy()
_LETTER[0x30:0x3A] = False


@dataclass(frozen=True)
class LanguageModel:
    """Languages by family; weights and bias of each pair, whose first name is the positive side."""

    families: dict[str, tuple[str, ...]]
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]]


def trigrams(data: np.ndarray, starts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams centred on the letters of the rows, and where each row's begin."""
    at = np.flatnonzero(_LETTER[data])
    low = np.where(_LETTER, LOWER, np.uint8(0x20))[data].astype(np.uint32)
    before = np.empty_like(low)
    before[1:] = low[:-1]
    after = np.empty_like(low)
    after[:-1] = low[1:]
    filled = starts[:-1][starts[1:] > starts[:-1]]
    before[filled] = 0x20
    after[starts[1:][starts[1:] > starts[:-1]] - 1] = 0x20
    code = (before[at] << np.uint32(16)) | (low[at] << np.uint32(8)) | after[at]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), np.searchsorted(at, starts)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, side, text) rows to (pair, side, feature numbers, frequencies)."""
    for batch in batches:
        for low, high, data, starts in parts(batch.column("text")):
            code, edge = trigrams(data, starts)
            at, value = [], []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                number, count = np.unique(code[a:b], return_counts=True)
                at.append(number.astype(np.int32))
                value.append((count / max(b - a, 1)).astype(np.float32))
            lists = pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))
            yield pa.record_batch(
                [batch.column("pair").slice(low, high - low), batch.column("side").slice(low, high - low), *lists],
                ["pair", "side", "at", "value"],
            )


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """Squared-hinge SVM of one pair: accelerated descent on the whole sample."""
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        x[k, at] = value
    y = rows["side"].to_numpy(np.float32)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
    x *= scale
    v = np.ones(x.shape[1], np.float32)
    for _ in range(10):  # the largest curvature sets the step
        v = x.T @ (weight * (x @ v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    ridge = 1e-4 * norm
    step = 1 / (2 * (norm + 1) + ridge)
    w = np.zeros(x.shape[1], np.float32)
    b = 0.0
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(120):
        slack = np.maximum(0, 1 - y * (x @ ahead + ahead_b)) * y * weight
        new = ahead + step * (2 * (x.T @ slack) - ridge * ahead)
        new_b = ahead_b + step * 2 * float(slack.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        ahead_b = new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return pd.DataFrame({"pair": [rows["pair"].iloc[0]], "weights": [(w * scale).astype("<f4").tobytes()], "bias": [float(b)]})


def _drawn(known: DataFrame, counts: dict[str, int], rows_per_lang: int) -> DataFrame:
    """About ``rows_per_lang`` rows of each language, drawn by key where the rows are read: the others go to no shuffle."""
    share = F.create_map(*(F.lit(part) for code, n in counts.items() for part in (code, rows_per_lang / n)))[F.col("lang")]
    return known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(1 << 30) < share)


def fit(docs: DataFrame, text: str, lang: str, key: str, rows_per_lang: int = 300) -> LanguageModel:
    """Learn from the rows whose language is known, on a sample of about ``rows_per_lang`` rows each."""
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null")
    counts = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    families: dict[str, tuple[str, ...]] = {}
    for code in sorted(counts):
        families.setdefault(FAMILY_OF.get(code, code), ())
        families[FAMILY_OF.get(code, code)] += (code,)
    duels: dict[str, list[tuple[str, float]]] = {code: [] for code in counts}
    for one, two in combinations(sorted(families), 2):
        for name, side in ((one, 1.0), (two, -1.0)):
            for code in families[name]:
                duels[code].append((f"{one}\t{two}", side))
    for codes in families.values():
        for one, two in combinations(codes, 2):
            duels[one].append((f"{one}\t{two}", 1.0))
            duels[two].append((f"{one}\t{two}", -1.0))
    if len(counts) < 2:
        return LanguageModel(families, {})
    spark = docs.sparkSession
    plan = spark.createDataFrame([(code, pair, side) for code, own in duels.items() for pair, side in own], "lang string, pair string, side float")
    sample = _drawn(known, counts, rows_per_lang).join(plan, "lang").select("pair", "side", "text")
    vectors = sample.mapInArrow(_vectors, "pair string, side float, at array<int>, value array<float>")
    trained = vectors.groupBy("pair").applyInPandas(_train, "pair string, weights binary, bias double").collect()
    pairs = {tuple(row["pair"].split("\t")): (np.frombuffer(row["weights"], "<f4"), row["bias"]) for row in trained}
    return LanguageModel(families, pairs)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, trigrams, how often each); rows without a letter are left out."""
    for batch in batches:
        for low, high, data, starts in parts(batch.column("text")):
            code, edge = trigrams(data, starts, WIDE_BITS)
            found = [np.unique(code[a:b], return_counts=True) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            at, many = [pa.array([own[k].astype(np.int32) for own in found], pa.list_(pa.int32())) for k in (0, 1)]
            rows = pa.record_batch([batch.column("lang").slice(low, high - low), at, many], ["lang", "at", "many"])
            yield rows.filter(pa.array(edge[1:] > edge[:-1]))


def _vocabulary(rows: pd.DataFrame) -> pd.DataFrame:
    """The trigrams of one language that enough rows hold, as bits, and its cut."""
    holders = np.zeros(1 << WIDE_BITS, np.int64)
    for at in rows["at"]:
        holders[at] += 1
    least = max(1, int(np.ceil(HELD * len(rows))))
    shares = [many[holders[at] > least].sum() / many.sum() for at, many in zip(rows["at"], rows["many"], strict=True)]
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "bits": [np.packbits(holders >= least).tobytes()], "cut": [KNOWN * float(np.median(shares))]})


def vocabulary(docs: DataFrame, text: str, lang: str, key: str, rows_per_lang: int = 300) -> dict[str, tuple[np.ndarray, float]]:
    """Bits of the trigrams of each language and its cut, on a sample of about ``rows_per_lang`` rows each."""
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null")
    counts = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    wide = _drawn(known, counts, rows_per_lang).select("lang", "text").mapInArrow(_wide, "lang string, at array<int>, many array<int>")
    found = wide.groupBy("lang").applyInPandas(_vocabulary, "lang string, bits binary, cut double").collect()
    return {row["lang"]: (np.frombuffer(row["bits"], np.uint8), row["cut"]) for row in found}


def _known(held: dict[str, tuple[np.ndarray, float]], data: np.ndarray, starts: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Whether each row's share of trigrams that its language holds reaches the cut; false without a letter."""
    code, edge = trigrams(data, starts, WIDE_BITS)
    size = edge[1:] - edge[:-1]
    out = np.zeros(len(size), bool)
    for name in {own for own in langs if own in held}:
        bits, cut = held[name]
        share = sums((bits[code >> 3] >> (7 - (code & 7)).astype(np.uint8)) & 1, edge) / np.maximum(size, 1)
        out |= (langs == name) & (size > 0) & (share >= cut)
    return out


def _winner(names: tuple[str, ...], margins: dict[tuple[str, str], np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the name that wins most pairs, and its mean probability against the others."""
    wins, total, chance = (np.zeros((len(names), rows)) for _ in range(3))
    for (i, one), (j, two) in combinations(enumerate(names), 2):
        margin = margins.get((one, two), np.zeros(rows))
        sure = 1 / (1 + np.exp(-np.clip(3 * margin, -40, 40)))
        wins[i] += margin >= 0
        wins[j] += margin < 0
        total[i] += margin
        total[j] -= margin
        chance[i] += sure
        chance[j] += 1 - sure
    best = np.argmax(wins + 0.4 * np.tanh(total / max(len(names), 1)), axis=0)
    odds = chance[best, np.arange(rows)] / max(len(names) - 1, 1) if len(names) > 1 else np.ones(rows)
    return best, odds


def predict(model: LanguageModel, text: Column, held: dict[str, tuple[np.ndarray, float]] | None = None) -> Column:
    """struct<lang string, score double> of a text column; given a vocabulary also known boolean, in the same pass."""
    families = tuple(sorted(model.families))
    weights = model.pairs

    checked = held is not None

    def found(column: pa.Array) -> pa.Array:
        langs, scores, sound = [], [], [np.zeros(0, bool)]
        for low, high, data, starts in parts(column):
            rows = high - low
            code, edge = trigrams(data, starts)
            size = np.maximum(edge[1:] - edge[:-1], 1)
            margins = {pair: sums(w[code], edge) / size + b for pair, (w, b) in weights.items()}
            best, odds = _winner(families, margins, rows) if families else (np.zeros(rows, int), np.zeros(rows))
            lang, score = np.full(rows, UNKNOWN, object), np.zeros(rows)
            for k, family in enumerate(families):
                codes = model.families[family]
                own, sure = _winner(codes, margins, rows)
                here = (best == k) & (edge[1:] > edge[:-1])
                lang[here] = np.array(codes, object)[own[here]]
                score[here] = (odds * sure)[here]
            langs.append(lang)
            scores.append(score)
            if checked:
                sound.append(_known(held, data, starts, lang))
        lang = pa.array(np.concatenate(langs) if langs else [], pa.string())
        fields = [lang, pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(sound))]
        names = ["lang", "score", "known"]
        return pa.StructArray.from_arrays(fields[: 2 + checked], names[: 2 + checked])

    @arrow_udf("struct<lang: string, score: double" + ", known: boolean" * checked + ">")
    def language(column: pa.Array) -> pa.Array:
        return returned(found, column)

    lettered = F.when(text.rlike("\\p{L}"), text)  # bytes beyond ASCII may be signs
    return language(lettered)
