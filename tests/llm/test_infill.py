import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty_docs, odd_docs, odd_rows
from wardlens.llm import infill


def expected(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    p, m = sorted(x % (len(text) + 1) for x in h[:2])
    if not text or any(mark in text for mark in infill.MARKS) or h[2] % 100 >= 90:
        return (key, len(text), "plain", None, None, text, text)
    before, middle, after = text[:p], text[p:m], text[m:]
    if h[3] % 100 < 20:
        return (key, len(text), "spm", p, m - p, f"<S>{after}<P>{before}<M>{middle}", text)
    return (key, len(text), "psm", p, m - p, f"<P>{before}<S>{after}<M>{middle}", text)


def found(docs):
    made = docs.select("doc_id", infill.fill_in_middle(F.col("text"), infill.draws(F.col("doc_id"))).alias("own")).select("doc_id", "own.*")
    return sorted(map(tuple, made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()), key=str)


def test_odd_rows(spark):
    assert found(odd_docs(spark).repartition(3)) == sorted((expected(*row) for row in odd_rows()), key=str)
    assert found(empty_docs(spark)) == []


def test_random_texts(spark):
    """Half marks, whole marks, and letters of one to four bytes."""
    rng = random.Random(3)
    pieces = ["<", "P>", "<S", ">", "M", "a", "é", "日", "🙂", " ", "<P", "S>", "<M>x", "\n"]
    rows = [(k, "".join(rng.choice(pieces[:12] if k % 4 else pieces) for _ in range(rng.randint(0, 40)))) for k in range(3000)]
    own = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert own == sorted((expected(*row) for row in rows), key=str)
    assert {row[2] for row in own} == {"plain", "psm", "spm"}


def test_output_without_its_marks_is_refused(spark):
    for output in ("no marks", "<P>a<S>b", "<P>a<S>b<M>c<M>d"):
        broken = spark.createDataFrame([(output, "psm")], "output string, form string")
        with pytest.raises(Exception, match="three marks"):
            broken.select(infill.restored(F.col("output"), F.col("form"))).collect()
