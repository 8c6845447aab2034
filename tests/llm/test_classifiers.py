import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty_docs, odd_docs
from wardlens.llm import langid, quality, queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_languages_of_held_out_documents(spark):
    found = queries.op1_language_id(spark, SF_DIR)
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and found.count() == truth.count()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_texts(spark, docs):
    model = langid.fit(docs.limit(400), "text", "lang", "doc_id", rows_per_lang=40)
    assert set(model.families) == {"germanic", "romance"}
    found = odd_docs(spark).select("text", langid.predict(model, F.col("text")).alias("p")).collect()
    for row in found:
        if row["text"] is None or not any(c.isalpha() for c in row["text"]):
            assert tuple(row["p"]) == ("und", 0.0)
        else:
            assert row["p"]["lang"] in {"de", "en", "es", "fr"} and 0 <= row["p"]["score"] <= 1
    assert empty_docs(spark).select(langid.predict(model, F.col("text")).alias("p")).collect() == []


def test_the_sample_is_drawn_before_any_join(spark, docs, monkeypatch):
    """A join that decides which rows are sampled shuffles all texts."""
    taken = []
    draw = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda rows, *rest: taken.append(rows) or draw(rows, *rest))
    langid.vocabulary(docs, "text", "lang", "doc_id", rows_per_lang=5)
    langid.fit(docs, "text", "lang", "doc_id", rows_per_lang=5)
    assert len(taken) == 2
    for rows in taken:
        lines = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert any("Filter" in line and "xxhash64" in line for line in lines)
        assert not any("Join" in line and "xxhash64" in line for line in lines)


def test_one_language_or_none(spark):
    text = spark.createDataFrame([("one",), ("...",), (None,)], "text string")
    for langs, expected in ((["xx", "xx"], ["xx", "und", "und"]), ([None, None], ["und", "und", "und"])):
        learn = spark.createDataFrame([(k, "some words", lang) for k, lang in enumerate(langs)], "k long, text string, lang string")
        model = langid.fit(learn, "text", "lang", "k")
        assert [r[0] for r in text.select(langid.predict(model, F.col("text")).getField("lang")).collect()] == expected


def test_quality_of_held_out_documents(spark):
    found = queries.op7_quality(spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert found.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_of_odd_texts(spark):
    learn = spark.createDataFrame([(k, "good plain words here" if k % 2 else "%%% !! | %%%", k % 2) for k in range(60)], "k long, text string, y int")
    model = quality.fit(learn, "text", "y", "k")
    rows = odd_docs(spark).select("text", quality.score(model, F.col("text")).alias("p")).collect()
    assert all(0 <= r["p"] <= 1 for r in rows)
    assert len({r["p"] for r in rows if not (r["text"] or "").strip()}) == 1
    good, bad = (spark.createDataFrame([(t,)], "text string").select(quality.score(model, F.col("text"))).first()[0] for t in ("plain words", "%%% | !!"))
    assert good > 0.5 > bad
    assert empty_docs(spark).select(quality.score(model, F.col("text"))).collect() == []


def test_quality_without_labels(spark):
    learn = spark.createDataFrame([], "k long, text string, y int")
    model = quality.fit(learn, "text", "y", "k")
    assert odd_docs(spark).select(quality.score(model, F.col("text"))).distinct().collect()[0][0] == 0.5
