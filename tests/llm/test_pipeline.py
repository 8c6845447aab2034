import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import LONG
from wardlens.llm import queries
from wardlens.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "benchmark")


def test_each_stage_keeps_columns_and_the_last_encodes(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, kept, SF_DIR).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == columns and 0 < kept.count() <= before
        before = kept.count()
    found = corpus_pipeline.run(spark, SF_DIR).select("doc_id").collect()
    assert sorted(found) == sorted(kept.select("doc_id").collect())


def test_odd_rows_through_all_stages(spark):
    """Odd rows beside enough labelled rows to learn from."""
    folder = scratch_path(spark, "odd")
    given = {name: spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in TABLES}
    item = given["benchmark"].first()["text"]
    plain = given["documents"].where("lang = 'en'").join(given["labels"].where("quality = 1"), "doc_id").first()["text"]
    odd = [(None, None), (9001, ""), (9002, "..."), (9003, plain + " extra"), (9004, plain + " extra"), (9004, plain + " extra"), (9005, f"{plain[:200]} {item}"), (9006, LONG)]
    extra = spark.createDataFrame([(k, t, None, None, None) for k, t in odd], given["documents"].schema)
    given["documents"].union(extra).write.parquet(f"{folder}/documents.parquet")
    for name in TABLES[1:]:
        given[name].write.parquet(f"{folder}/{name}.parquet")
    found = [r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()]
    assert None not in found and not {9001, 9002, 9004, 9005} & set(found)
    assert len(found) == len(set(found))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).collect() == []


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_held_out_folds_follow_the_contract(spark):
    docs = spark.createDataFrame([(k,) for k in range(50)], "doc_id long")
    for k, one, two in docs.select("doc_id", queries.fold(4), queries.fold(5)).collect():
        assert one == zlib.crc32(str(k).encode()) % 4 and two == zlib.crc32(str(k).encode()) % 5


def test_other_languages_and_garbage_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(2)
    other = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)),
    ]
    extra = spark.createDataFrame([(90_000 + k, t, None, None, None) for k, t in enumerate(other)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.union(extra), SF_DIR)
    assert kept.columns == docs.columns
    assert kept.where("doc_id >= 90000").collect() == []
    held = docs.where(queries.fold(4) == 2).where("text rlike '\\\\p{L}'")
    assert held.join(kept, "doc_id", "left_semi").groupBy("lang").count().count() == 4
    assert held.join(kept, "doc_id", "left_semi").count() >= 0.99 * held.count()


def test_a_language_without_labelled_rows_goes(spark):
    """Spanish rows that nobody labelled, beside three languages."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    kept = corpus_pipeline.language_id(spark, hidden, SF_DIR).groupBy(F.col("lang").isNull().alias("other")).count()
    found = {r["other"]: r["count"] for r in kept.collect()}
    assert found.get(True, 0) <= 0.05 * docs.where("lang = 'es'").count()
    assert found[False] >= 0.97 * docs.where("lang != 'es'").count()


def test_one_document_of_each_group_stays(spark):
    """One id with texts of two groups, near-duplicates without an id, one set in two spellings."""
    words = [[f"{name}{k}" for k in range(60)] for name in "abcd"]
    one, two, three, four = (" ".join(own) for own in words)
    rows = [(5, one), (5, two + " end"), (3, two), (8, one + " end"), (None, three), (None, three + " end"), (6, four), (6, four.upper()), (6, four)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.ngram_jaccard(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"].lower().removesuffix(" end")) for r in kept.collect()]
    assert sorted(found, key=str) == sorted([(5, one), (3, two), (None, three), (6, four)], key=str)
