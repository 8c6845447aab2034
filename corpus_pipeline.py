"""From documents to token ids: language, quality, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept; a stage's result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import encoding, jaccard, langid, quality, tiling
from wardlens.llm.queries import QUALITY_CUT, language_model, language_vocabulary, quality_model, table
from wardlens.session import scratch_path

#: Bytes of text in a batch that goes to a task process, where Spark's default is 64 MB.
BATCH_BYTES = "4m"


def _batched(spark: SparkSession) -> None:
    """Texts travel in small batches: tasks of all stages share the executors' memory with what is cached there."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known: not ``und``, and made of what its labelled rows hold.

    Null and empty texts and those without a letter are ``und`` and go. Equal texts fare alike.
    """
    _batched(spark)
    found = langid.predict(language_model(docs), F.col("text"), language_vocabulary(docs))
    kept = docs.withColumn("__language", found).where((F.col("__language.lang") != langid.UNKNOWN) & F.col("__language.known"))
    return kept.drop("__language")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score reaches the cut.

    Null counts as empty, and the empty text has a score like any other. Equal texts fare alike.
    """
    _batched(spark)
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, F.col("text")) >= QUALITY_CUT)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near duplicates the document with the smallest id, one text of it, once.

    Texts without words are in no group and stay, repeated rows of one id and text once. Of
    rows that differ in other columns only, any one stays.
    """
    _batched(spark)
    found = jaccard.grouped(docs, "doc_id", "text")
    chosen = found.where("first").select(F.col("key").alias("__key"), F.col("mark").alias("__mark")).distinct()
    same = docs["doc_id"].eqNullSafe(chosen["__key"]) & (F.xxhash64(docs["text"]) == chosen["__mark"])
    return docs.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null and empty texts hold none and stay; without benchmark rows all stay. Equal texts fare alike.
    """
    _batched(spark)
    items = tiling.blocks(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return docs.where(tiling.contamination(items, F.col("text"))["n_items"] == 0)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, and the digests of its tokens and of their decoded text.

    Null and empty texts have no token and the digests of the empty text. A row for each row.
    """
    _batched(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return docs.select("doc_id", encoding.digests(F.col("text"), path, keep=False).alias("own")).select("doc_id", "own.*")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]
#: Learned models, tree search and merges have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "corpus")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
