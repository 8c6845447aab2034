import hashlib

from tests.llm.helpers import empty_docs, odd_docs, odd_rows
from wardlens.llm import lzprint


def brute_phrases(text):
    """LZ78, one phrase after the other; the rest that is known counts as a phrase."""
    known, at = set(), 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in known:
            size += 1
        known.add(text[at : at + size])
        at += size
    return known


def test_phrases_across_the_middle():
    for text in ("", "a", "aaaaaaaaaa", "abcabcabcabdabc", "the cat the cat the hat"):
        for cut in range(len(text) + 1):
            known = set()
            head, begun = lzprint.phrases(text[:cut], known)
            tail, left = lzprint.phrases(text[cut:], known, begun)
            assert {*head, *tail, *([left] if left else [])} == brute_phrases(text)


def expected(rows):
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for place, (key, text) in enumerate(order):
        after = order[(place + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        marks = lzprint.minima([sorted(brute_phrases(t)) for t in (text, edited, after)])
        out.append(
            (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), lzprint.spelt(marks[0]), lzprint.spelt(marks[1]), float((marks[0] == marks[1]).mean()), float((marks[0] == marks[2]).mean()))
        )
    return sorted(out, key=str)


def test_same_as_brute_force(spark):
    docs = odd_docs(spark).repartition(4)
    found = sorted(map(tuple, lzprint.fingerprints(docs, "doc_id", "text").collect()), key=str)
    assert found == expected(odd_rows())
    same = {}
    for row, text in zip(expected(odd_rows()), (None,) * len(found), strict=True):
        same.setdefault(row[3], text)
    assert "" in same  # the empty text


def test_over_many_buckets(spark):
    rows = [(k * 7 % 1009, f"text {k} " + "abc "[k % 4] * (k % 50)) for k in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = sorted(map(tuple, lzprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert found == expected(rows)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    row = lzprint.fingerprints(one, "doc_id", "text").first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and row["near_next"] == 1.0
    assert lzprint.fingerprints(empty_docs(spark), "doc_id", "text").collect() == []
