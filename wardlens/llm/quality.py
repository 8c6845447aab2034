"""Quality of a text: logistic regression on hashed word n-grams, learned by FTRL.

Tokens are runs of letters and digits and runs of other signs; features are tokens and
pairs of neighbours (a repeated token is one feature, whatever the token), hashed to
``1 << BITS`` places, as relative frequencies over the whole text. The follow-the-regularised-leader updates (one row at a time, a rate for
each place, L1 and L2 penalties) run in ``SHARDS`` Spark tasks, each on its share of a
sample of about ``rows`` labelled rows; the model is the mean of their weights. A score
is a sparse dot product, put through the logistic function.

Null and empty text: no feature, so the score is that of the bias alone. No labelled
row: the score is 0.5 everywhere. Repeated rows are scored alike; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from wardlens.llm.text import BLANK, WORDY, gram_hashes, parts, range_hashes, returned, runs, sums

BITS = 18
SHARDS = 4
REPEAT = np.uint64(1) << np.uint64(63)
#: The frequencies of a row sum up to this.
MASS = 30.0
#: Rate, its damping, the two penalties, and how often the sample is gone through.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 3
_KIND = np.where(BLANK, 0, np.where(WORDY, 1, 2)).astype(np.uint8)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all tokens and token pairs of the rows, and where each row's begin in either."""
    begin, end, row = runs(_KIND[data], starts)
    word = range_hashes(data, begin, end)
    pair, at = gram_hashes(word, row, 2)
    pair[word[at] == word[at + 1]] = REPEAT
    number = np.arange(len(starts))
    shift = np.uint64(64 - BITS)
    place = np.concatenate([word >> shift, pair >> shift]).astype(np.int64)
    return place, np.searchsorted(row, number), len(word) + np.searchsorted(row[at], number)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, starts in parts(batch.column("text")):
            place, one, two = features(data, starts)
            at, value = [], []
            for a, b, c, d in zip(one[:-1], one[1:], two[:-1], two[1:], strict=True):
                number, count = np.unique(np.concatenate([place[a:b], place[c:d]]), return_counts=True)
                at.append(number.astype(np.int32))
                value.append((MASS * count / max(b - a + d - c, 1)).astype(np.float32))
            lists = pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))
            kept = [batch.column(name).slice(low, high - low) for name in ("shard", "turn", "y")]
            yield pa.record_batch([*kept, *lists], ["shard", "turn", "y", "at", "value"])


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """Follow the regularised leader over one shard, in the order of ``turn``."""
    rows = rows.sort_values("turn", kind="stable")
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last place is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        w = -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(own) > L1, w, 0.0)

    for _ in range(EPOCHS):
        for at, value, y in zip(rows["at"], rows["value"], rows["y"], strict=True):
            at, value = np.append(at, 1 << BITS), np.append(value, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - y) * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return pd.DataFrame({"weights": [weights(np.arange(len(z))).astype("<f4").tobytes()]})


def fit(rows: DataFrame, text: str, label: str, key: str, sample: int = 10_000) -> QualityModel:
    """Learn P(label = 1) from the rows whose label is 0 or 1, on a sample of about ``sample`` rows."""
    known = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("double").alias("y")).where("y in (0, 1)")
    count = known.count()
    if not count:
        return QualityModel(np.zeros(1 << BITS, np.float32), 0.0)
    draw = F.xxhash64("key")
    chosen = known.where(F.pmod(draw, F.lit(1 << 30)) / F.lit(1 << 30) < min(1.0, sample / count)).select(
        F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SHARDS)).alias("shard"), F.xxhash64("key", F.lit(2), "text").alias("turn"), "y", "text"
    )
    vectors = chosen.mapInArrow(_vectors, "shard long, turn long, y double, at array<int>, value array<float>")
    trained = vectors.groupBy("shard").applyInPandas(_train, "weights binary").collect()
    mean = np.mean([np.frombuffer(row["weights"], "<f4") for row in trained], axis=0) if trained else np.zeros((1 << BITS) + 1)
    return QualityModel(mean[:-1].astype(np.float32), float(mean[-1]))


def score(model: QualityModel, text: Column) -> Column:
    """P(label = 1) of a text column."""
    weights, bias = model.weights, model.bias

    def found(column: pa.Array) -> pa.Array:
        out = []
        for _, _, data, starts in parts(column):
            place, one, two = features(data, starts)
            value = weights[place].astype(np.float64)
            size = np.maximum(one[1:] - one[:-1] + two[1:] - two[:-1], 1)
            dot = MASS * (sums(value, one) + sums(value, two)) / size
            out.append(1 / (1 + np.exp(-np.clip(dot + bias, -30, 30))))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    @arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        return returned(found, column)

    return probability(text)
