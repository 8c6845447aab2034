import hashlib
from collections import Counter, defaultdict
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from tests.llm.helpers import empty_docs, odd_docs, odd_rows
from wardlens.llm import exactdup

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def expected(rows, digest=lambda t: hashlib.sha256(t.encode()).hexdigest()):
    groups = defaultdict(list)
    for key, text in rows:
        groups[(text or "").translate(LOWER)].append(key)
    out = []
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        for key, copies in Counter(keys).items():
            out += [(key, keep, len(keys), key == keep and not n, digest(text)) for n in range(copies)]
    return sorted(out, key=str)


def found(docs, **options):
    return sorted(map(tuple, exactdup.members(docs, "doc_id", "text", **options).collect()), key=str)


def test_odd_rows(spark):
    assert found(odd_docs(spark).repartition(5)) == expected(odd_rows())
    assert found(empty_docs(spark)) == []


def test_only_ascii_letters_are_lowered(spark):
    rows = [(1, "ÄB"), (2, "äb"), (3, "Äb"), (4, "İ"), (5, "i̇"), (6, "K"), (7, "k"), (8, "K")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_a_digest_never_stands_for_a_comparison(spark):
    """With digests that many texts share, groups are still those of equal texts."""
    rows = [(k, f"Text {k % 37}"[: 4 + k % 5]) for k in range(400)] + [(None, "text"), (None, "TEXT"), (3, "Tex")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    weak = found(docs, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1))
    assert weak == expected(rows, lambda t: hashlib.sha256(t.encode()).hexdigest()[:1])


def test_hot_groups_and_repeated_rows(spark):
    """A third of all rows is one text, and one row is repeated more often than a piece holds."""
    rows = spark.range(0, 9000, 1, 6).select(F.when(F.col("id") % 3 == 0, "Same").otherwise(F.concat(F.lit("t"), F.col("id") % 4000)).alias("text"), F.col("id").alias("doc_id"))
    rows = rows.union(spark.range(0, 9001, 1, 6).select(F.lit("SAME").alias("text"), F.lit(8999).alias("doc_id")))
    own = [(r["doc_id"], r["text"]) for r in rows.collect()]
    assert found(rows) == expected(own)
