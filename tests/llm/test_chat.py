import hashlib

import pytest

from checks import compare
from wardlens.llm import chat, queries
from wardlens.session import scratch_path

ROWS = "conv_id long, turn long, role string, text string, node string, tree string, start long"


def rows():
    said = [(1, [("user", "hi"), ("assistant", "a"), ("user", "b")]), (2, [("user", "hi"), ("assistant", "a"), ("user", "c"), ("assistant", "d")]), (3, [("user", "hi"), ("assistant", "z")]), (4, [("user", "hi")]), (5, [("user", "hi"), ("assistant", "a"), ("user", "b")]), (None, [("user", "hi"), ("assistant", "é\\</s>")]), (6, [(None, None), ("assistant", ""), ("a\nb\\", "<s>[INST]\\[/INST]</s>\n")]), (7, [("assistant", "long " * 50_000)]), (8, [("user", f"turn {k}") for k in range(300)])]
    out = [(c, k, r, t, "n", "t", 0) for c, turns in said for k, (r, t) in enumerate(turns)]
    return out + [(9, None, "user", "no place"), (9, 0, "user", "same"), (9, 0, "user", "same")][:0] + [(9, 0, "user", "same", "n", "t", 0)] * 2


def expected():
    out = {}
    for conv, turn, role, text, *_ in sorted(rows(), key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        own = out.setdefault(conv, [])
        own.append((role or "", text or ""))
    result = []
    for conv, turns in out.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(chat.formatted(r, t)[0]) for r, t in turns)
        result.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(result, key=str)


@pytest.mark.parametrize("text", ["", "\\", "</s>", "\\</s>", "a\\\\b<s>[INST] <<SYS>>", "<", "[INST"])
def test_escapes_are_reversible(text):
    assert chat.plain(chat.escaped(text)) == text
    segment, begin, end = chat.formatted(text, text)
    found = chat._TURN.fullmatch(segment)
    assert chat.plain(found[1]) == text and chat.plain(segment[begin:end]) == text


def test_round_trip(spark):
    folder = scratch_path(spark, "chat")
    chat.write(spark.createDataFrame(rows(), ROWS), "conv_id", "turn", "role", "text", folder)
    assert sorted(map(tuple, chat.read(spark, folder).collect()), key=str) == expected()


def test_shared_turns_are_emitted_once_and_attend_to_ancestors_only(spark):
    folder = scratch_path(spark, "chat")
    chat.write(spark.createDataFrame(rows(), ROWS), "conv_id", "turn", "role", "text", folder)
    nodes = spark.read.parquet(f"{folder}/segments").collect()
    assert len(nodes) == len({r["node"] for r in nodes})
    trees = {}
    for row in nodes:
        trees.setdefault(row["tree"], []).append(row)
    for own in trees.values():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(len(x["segment"]) for x in own[:k]) for k in range(len(own))]  # no gap, no overlap
        ends = {r["start"] + r["n"] for r in own}
        for row in own:
            seen = sum(i["end"] - i["start"] for i in row["attends"])
            assert seen == row["position"] and all(i["start"] in {r["start"] for r in own} and i["end"] in ends for i in row["attends"])
    shared = next(own for own in trees.values() if len(own) > 4 and own[0]["segment"] == "<s>user\nhi</s>")
    text = "".join(r["segment"] for r in shared)
    for row in shared:  # what a node attends to, then the node: a beginning of some conversation
        path = "".join(text[i["start"] : i["end"]] for i in row["attends"]) + row["segment"]
        assert any("".join(chat.formatted(r or "", t or "")[0] for c2, _, r, t, *_ in rows() if c2 == c).startswith(path) for c in (1, 2, 3, 4, 5, None))


def test_no_conversation(spark):
    folder = scratch_path(spark, "chat")
    chat.write(spark.createDataFrame([], ROWS), "conv_id", "turn", "role", "text", folder)
    assert chat.read(spark, folder).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_same_as_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert compare.differences(queries.QUERIES[name](spark, sf_dir), compare.connect(sf_dir), queries.SQL[name]) is None
