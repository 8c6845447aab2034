import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import empty_docs, odd_docs
from wardlens.llm import tiling
from wardlens.llm.text import unicode_words


def brute(item: list[str], text: list[str], least: int) -> int:
    """Greedy string tiling as it is defined: marked tokens of the item."""
    marked_item, marked_text, covered = set(), set(), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for d in range(len(text)):
                k = 0
                while i + k < len(item) and d + k < len(text) and item[i + k] == text[d + k] and i + k not in marked_item and d + k not in marked_text:
                    k += 1
                if k > best[0]:
                    best = (k, i, d)
        k, i, d = best
        if k < least:
            return covered
        marked_item |= set(range(i, i + k))
        marked_text |= set(range(d, d + k))
        covered += k


def covered(spark, items, texts, threshold=0.01):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    own = tiling.contamination(tiling.blocks(benchmark, "item_id", "text"), F.col("text"), threshold)
    return {r["k"]: r["own"] for r in rows.select("k", own.alias("own")).collect()}


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    item = [rng.choice("abcdefghij") for _ in range(30)]
    texts = []
    for _ in range(60):
        pieces = [item[a : a + rng.randint(2, 12)] for a in (rng.randrange(30) for _ in range(4))]
        texts.append([w for piece in pieces for w in [*piece, rng.choice("abxyz")]])
    found = covered(spark, [(1, " ".join(item))], [" ".join(t) for t in texts])
    for k, text in enumerate(texts):
        expected = brute(item, text, tiling.MIN_MATCH)
        assert found[k]["coverage"] == expected / 30 and (found[k]["n_items"] == 1) == (expected > 0), text


def test_reordered_passage_is_caught_and_others_are_not(spark):
    passage = "The red fox ran home. A small bird sang loudly. Nobody saw the old man."
    reordered = "nobody SAW the old man!  words between, A small bird sang loudly; and the red fox ran home"
    found = covered(spark, [(4, passage), (9, passage), (2, "a b c"), (5, None)], [reordered, "the red fox and a small bird", passage * 3, "", None], 0.5)
    assert found[0]["item_id"] == 4 and found[0]["n_items"] == 2 and found[0]["n_tiles"] == 3 and found[0]["coverage"] == 1.0
    assert [found[k]["n_items"] for k in (1, 3, 4)] == [0, 0, 0] and found[1]["item_id"] is None
    assert found[2]["coverage"] == 1.0


def test_blocks_of_items_give_one_result(spark, monkeypatch):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", str(rng.randrange(40))]) for _ in range(12))) for k in range(40)]
    texts = [f"x {items[k][1]} y {items[-k][1]}" for k in range(20)]
    whole = covered(spark, items, texts, 0.5)
    monkeypatch.setattr(tiling, "BLOCK_TOKENS", 100)
    assert len(tiling.blocks(spark.createDataFrame(items, "i long, t string"), "i", "t")) == 5
    assert covered(spark, items, texts, 0.5) == whole


def test_odd_texts_and_empty_tables(spark):
    benchmark = spark.createDataFrame([(7, "a b c d e f g h")], "item_id long, text string")
    items = tiling.blocks(benchmark, "item_id", "text")
    rows = odd_docs(spark).select("doc_id", "text", tiling.contamination(items, F.col("text")).alias("own")).collect()
    for row in rows:
        assert row["own"]["n_items"] == int((row["text"] or "").lower() == "a b c d e f g h")
    assert empty_docs(spark).select(tiling.contamination(items, F.col("text"))).collect() == []
    none = tiling.blocks(benchmark.limit(0), "item_id", "text")
    assert {r[0]["n_items"] for r in odd_docs(spark).select(tiling.contamination(none, F.col("text"))).collect()} == {0}


def test_scripts_without_blanks_and_unicode_signs(spark):
    chinese, japanese, thai = "人人生而自由,在尊严和权利上一律平等。", "すべての人間は、生まれながらにして自由である。", "มนุษย์ทั้งหลายเกิดมามีอิสระ"
    quoted = 'He said "don\'t go" - and then the old man left'
    items = [(1, chinese), (2, japanese), (3, thai), (4, quoted)]
    texts = [f"前文{chinese}后文", f"むかし{japanese.replace('、', '')}おわり", f"ก่อน{thai}หลัง", "x he said\u00a0\u201cdon\u2019t go\u201d\u2014and then\u00a0the old man left\u2026", "在一律人自由而"]
    found = covered(spark, items, texts, 0.9)
    assert [(found[k]["item_id"], found[k]["coverage"]) for k in range(4)] == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]
    assert found[4]["n_items"] == 0


def test_tokens_of_mixed_scripts():
    for text, expected in (
        ("Füße, été\u2014naïve\u00a0x", ["Füße", "été", "naïve", "x"]),
        ("日本2024年ab", ["日", "本", "2024", "年", "ab"]),
        ("हिन्दी में", ["हिन्दी", "में"]),
        ("한국어 말", ["한국어", "말"]),
        ("☺\ufe0f! 🙂", []),
        ("", []),
    ):
        data = np.frombuffer(text.encode(), np.uint8)
        begin, end, row = unicode_words(data, np.array([0, 0, len(data)]))
        assert [data[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)] == expected and set(row) <= {1}


def test_short_items_match_as_a_whole(spark):
    items = [(1, "Blue whale"), (2, "yes"), (3, "one two three"), (4, "..."), (5, "a b c d e f g h")]
    found = covered(spark, items, ["the blue, WHALE sang; a blue whale", "blue and whale", "yes yes yes one two three", "yesterday one two", "...", "x one two threes"], 0.5)
    own = [tuple(found[k][name] for name in ("item_id", "n_items", "coverage", "n_tiles")) for k in range(6)]
    none = (None, 0, 0.0, 0)
    assert own == [(1, 1, 1.0, 1), none, (2, 2, 1.0, 1), none, none, none]


def test_items_without_an_id_count(spark, monkeypatch):
    texts = ["x the old red fox ran home", "a small bird sang", "here nobody saw the old man there", "no item"]
    items = [(None, "the old red fox ran home"), (None, "a small bird sang"), (7, "a small bird sang"), (None, None), (0, "nobody saw the old man"), (None, "the small fox")]
    expected = [(None, 1, 1.0), (7, 2, 1.0), (0, 1, 1.0), (None, 0, 0.0)]
    for tokens_of_block in (tiling.BLOCK_TOKENS, 4):
        monkeypatch.setattr(tiling, "BLOCK_TOKENS", tokens_of_block)
        found = covered(spark, items, texts, 0.5)
        assert [(found[k]["item_id"], found[k]["n_items"], found[k]["coverage"]) for k in range(4)] == expected


def test_blocks_count_real_tokens(spark, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK_TOKENS", 100)
    lines = [(k, "\n".join(f"w{k}x{j}" for j in range(20))) for k in range(20)]
    signs = [(k, "... " * 200) for k in range(20)]
    han = [(k, chr(0x4E00 + k) * 20) for k in range(20)]
    assert [len(tiling.blocks(spark.createDataFrame(rows, "i long, t string"), "i", "t")) for rows in (lines, signs, han)] == [4, 0, 4]
