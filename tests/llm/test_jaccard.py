import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import empty_docs, odd_docs
from wardlens.llm import jaccard
from wardlens.llm.components import components


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    """(key, size, smallest key of the component) of each row."""
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)].append(key)
    return sorted(((key, len(sets[k]), min(least[find(k)], default=None) if sets[k] else key) for k, (key, _) in enumerate(rows)), key=str)


def joined(df, **sizes):
    return sorted(map(tuple, jaccard.join(df, "doc_id", "text", **sizes).collect()), key=str)


def corpus(seed):
    """Unrelated texts that share passages, near copies near the threshold, chains and copies."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(base)
    texts += [passage + [rng.choice(words) for _ in range(20)] for _ in range(25)]
    texts += [texts[0]] * 5
    rows = [(k * 3 % 401, " ".join(t) if k % 4 else " ".join(t).upper()) for k, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize(("seed", "leaf", "near"), [(1, 16, True), (2, 1, True), (3, 4, False), (4, 2, False)])
def test_same_as_brute_force(spark, monkeypatch, seed, leaf, near):
    """Also with blocks that all go through trees and tiles, and without the near-copy step."""
    if not near:
        monkeypatch.setattr(jaccard, "_near_pairs", lambda classes: classes.select(jaccard.F.col("sig").alias("a"), jaccard.F.col("sig").alias("b")).limit(0))
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs, leaf=leaf, tile=8 if leaf <= 2 else 1024) == brute(rows)


def test_tree_pairs_are_all_that_the_bound_leaves():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(1 << 40, rng.integers(5, 700), replace=False).astype(np.uint64)) for _ in range(60)]
    for k in range(40):
        own = sets[k].copy()
        own[: len(own) // rng.integers(7, 30)] = rng.integers(1 << 41, 1 << 42, len(own) // 7 + 1)[: len(own) // 30 + 1][0]
        sets.append(np.unique(own))
    points, sizes = [jaccard.point(own) for own in sets], np.array([len(own) for own in sets])
    part = rng.integers(0, 5, len(sets))
    found = {tuple(sorted(p)) for p in jaccard.tree_pairs(points, sizes, part).tolist()}
    for a in range(len(sets)):
        for b in range(a):
            linked = 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
            if linked and part[a] != part[b]:
                assert (b, a) in found
            if part[a] == part[b]:
                assert (b, a) not in found


@pytest.mark.parametrize("sizes", [[], [1], [2], [5], [1, 5], [5, 1], [2, 9, 2], [9, 9], [3, 1, 4, 12]])
@pytest.mark.parametrize("rows", [1, 3, 100])
def test_routes_over_batches(sizes, rows):
    """Blocks of any size, cut into batches anywhere: pairs up to the leaf size, members beyond."""
    import pyarrow as pa

    keys = [k for k, n in enumerate(sizes) for _ in range(n)]
    signs = [s for n in sizes for s in range(n)]
    batches = [
        pa.record_batch([pa.array(keys[a : a + rows], pa.int64()), pa.array(signs[a : a + rows], pa.int64())], ["key", "sig"])
        for a in range(0, len(keys), rows)
    ]
    found = [tuple(r.values()) for batch in jaccard._routes(iter(batches), 4) for r in batch.to_pylist()]
    members = {(k, s, None) for k, n in enumerate(sizes) if n > 4 for s in range(n)}
    pairs = {(None, a, b) for n in sizes if 1 < n <= 4 for b in range(n) for a in range(b)}
    assert set(found) == members | pairs


def test_odd_texts_and_empty_table(spark):
    from tests.llm.helpers import odd_rows

    assert joined(odd_docs(spark)) == brute(odd_rows())
    assert joined(empty_docs(spark)) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chains_and_stars(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    links += [(5, 5), (None, 3)]
    near = defaultdict(set)
    for a, b in links:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    expected, seen = {}, set()
    for node in sorted(near):
        todo = [node]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                expected[k] = node
                todo += near[k]
    found = components(spark.createDataFrame(rng.sample(links, len(links)), "x long, y long")).collect()
    assert len(found) == len(expected) and {r[0]: r[1] for r in found} == expected
