import random
import re
from collections import Counter, defaultdict
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pytest

from tests.llm.helpers import empty_docs, odd_docs, odd_rows
from wardlens.llm import collocation
from wardlens.llm.fmindex import Index

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def expected(rows, least, most=2000):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    count[lang or "und"][tuple(words[k : k + size])] += 1
    out = []
    for lang, f in count.items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = set()
        for q, more in own.items():
            for size in range(2, len(q)):
                held |= {q[k : k + size] for k in range(len(q) - size + 1) if 100 * more >= 80 * f[q[k : k + size]]}
        kept = []
        for p, a in own.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if p not in held:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def made(n, seed=5):
    """Texts over a few words with set phrases, pieces, odd blanks and languages of different sizes."""
    rng = random.Random(seed)
    words = ["a", "B", "é", "日本", "Cc", "d\x1ce", "ø"] + [f"w{k}" for k in range(30)]
    phrases = ["new york city hall", "San  Francisco", "of the", "x y z", "one two\tthree four five"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(phrases) if rng.random() < 0.3 else rng.choice(words)
            text += rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", " - ", "!? "])
        rows.append((rng.choice(["en", "en", "en", "en", "fr", None, "und"]), rng.choice([text, text, text, None]) if not rng.randrange(9) else text))
    return rows


def found(docs, **options):
    return sorted(map(tuple, collocation.collocations(docs, "text", "lang", **options).collect()))


@pytest.mark.parametrize("shard", [2_000_000, 700])
def test_same_as_brute_force(spark, shard):
    rows = made(400)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    own = found(docs, least=6, shard_words=shard)
    assert own == expected(rows, 6) and len(own) > 100


def test_ties_copies_and_a_short_list(spark):
    rows = [("en", "b a. a b, c d! e f")] * 40 + [("fr", "p q r s t " * 3)] * 7
    docs = spark.createDataFrame(rows, "lang string, text string")
    for most in (3, 2000):
        assert found(docs, least=5, most=most) == expected(rows, 5, most)


def test_odd_rows(spark):
    """A text of half a million characters without a stop is one piece; clashing columns aren't read."""
    rows = [(None if k == 1 else "en", t) for k, t in odd_rows()]
    docs = odd_docs(spark).drop("lang").selectExpr("*", "case when doc_id = 1 then null else 'en' end as lang", "1 as w0", "'x' as word", "2 as count")
    assert found(docs, least=2, shard_words=5000) == expected(rows, 2)
    assert found(empty_docs(spark)) == []


def test_frequent_phrases_of_many_small_shards(spark):
    """A phrase that stands once in each shard is counted over all."""
    rows = [("en", f"common words here u{k} v{k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(docs, least=30, shard_words=5) == expected(rows, 30)


def test_phrases_meet_packed():
    """What shards send is a row for each bucket, a few bytes a phrase; sums and holders are exact, beyond 32 bits too."""
    rng = np.random.default_rng(3)
    shards = [np.unique(rng.integers(1, 3000, (4000, 4)), axis=0) for _ in range(3)]
    count, sent = Counter(), []
    for k, words in enumerate(shards):
        one, two = collocation._packed(words, np.arange(3000))
        own = np.where(np.arange(len(one)) % 3, 1, 1 << 33)
        count.update(dict(zip(zip(one.tolist(), two.tolist(), strict=True), own.tolist(), strict=True)))
        sent.append(collocation._dealt(k, one, two, own, 5))
    table = collocation.pa.concat_tables(sent)
    assert len(table) == 15 and table.nbytes < 12 * sum(map(len, shards))
    found, back = {}, 0
    for bucket in range(5):
        part = table.filter(collocation.pa.array([b == bucket for b in table["bucket"].to_pylist()]))
        for row in collocation._often(part, 30, True).to_pylist():
            one, two, n = collocation._unpack(row["size"], row["data"]).tolist()
            back += row["index"] is not None and len(one)
            found |= dict(zip(zip(one, two, strict=True), n, strict=True)) if row["index"] is None else {}
    assert found == {p: n for p, n in count.items() if n >= 30}
    assert back >= len(found)


def test_index_counts_every_phrase():
    """Grown to the right, to the left or found as pairs: intervals hold what the sequence holds."""
    rng = np.random.default_rng(4)
    tokens = np.concatenate([[0], rng.integers(0, 5, 600) * rng.integers(0, 2, 600), [0]])
    index = Index(*Index.transforms(tokens, 5), 5)
    level = index.single()
    for size in range(1, 5):
        plain = Counter(tuple(map(int, tokens[k : k + size])) for k in range(len(tokens) - size + 1) if tokens[k : k + size].all())
        assert {tuple(map(int, w)): int(n) for w, n in zip(level.words, level.count, strict=True)} == plain
        level = index.grown(level, right=bool(size % 2)) if size < 4 else level
    one, two = np.divmod(np.arange(6, 25), 5)
    pairs = index.pairs(one, np.maximum(two, 1))
    plain = Counter(zip(tokens[:-1].tolist(), tokens[1:].tolist(), strict=True))
    assert pairs.count.tolist() == [plain[int(a), int(b)] for a, b in pairs.words]
