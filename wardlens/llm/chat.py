"""Chat formatting over prefix trees.

A turn is formatted as ``<s>`` role, line break, text ``</s>``; a backslash escapes
control strings and backslashes inside texts, and line breaks inside roles, and is taken
away again on reading. Tokens are the code points of the formatted text.

Conversations that begin with the same turns share them: a node stands for a sequence of
turns from the first on, named by a hash that grows turn by turn, and is emitted once.
The nodes of a tree (conversations with the same first turn) are laid out depth-first:
siblings in order of their names, each before its subtree. A node carries the place of
its tokens in the tree, their position ids (the place in any conversation that runs
through it), the range of its tokens under the loss mask, and the intervals of its
ancestors, neighbouring ones merged: its tokens attend to these and to earlier tokens of
the node.

No task holds a conversation or a tree. Turns stream by conversation through running
hashes and sums; a node's subtree is summed over the conversations through it, each
node counted in the smallest of them; siblings are numbered in 256 pieces a parent.

Null role or text counts as empty. Rows of a conversation go by turn, then role, then
text (nulls first), and repeated rows are turns of their own. A null id is a
conversation too. Conversations with equal turns share all nodes and keep a row each. No
row: no output. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_MARKS = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*)</s>", re.DOTALL)
LEARNED = "assistant"
ROWS = 2000


def escaped(text: str) -> str:
    return _MARKS.sub(lambda found: "\\" + found[0], text)


def plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and the range of its text in it."""
    head = f"<s>{escaped(role)}".replace("\n", "\\\n") + "\n"
    body = escaped(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _packed(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_START = object()
_TURNS = pa.schema([("conv", pa.int64()), ("k", pa.int64()), ("node", pa.string()), ("parent", pa.string()), ("tree", pa.string()), ("segment", pa.string()), ("n", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])
_NODES = pa.schema([("conv", pa.int64()), ("k", pa.int64()), ("tree", pa.string()), ("node", pa.string()), ("own", pa.bool_()), ("start", pa.int64()), ("position", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
TURNS = "conv long, k long, node string, parent string, tree string, segment string, n long, loss_from long, loss_to long"
NODES = "conv long, k long, tree string, node string, own boolean, start long, position long, attends array<struct<start: long, end: long>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to nodes, by a running hash."""

    def walk() -> Iterator[dict]:
        conv, k, node, tree = _START, 0, None, None
        for row in _rows(batches):
            if conv is _START or row["conv"] != conv:
                conv, k, node, tree = row["conv"], 0, None, None
            segment, begin, end = formatted(row["role"], row["text"])
            name = hashlib.blake2b(f"{node}{segment}".encode(), digest_size=16).hexdigest()
            tree = tree or name
            learned = row["role"] == LEARNED
            yield {"conv": conv, "k": k, "node": name, "parent": node, "tree": tree, "segment": segment, "n": len(segment), "loss_from": begin if learned else 0, "loss_to": end if learned else 0}
            node, k = name, k + 1

    return _packed(walk(), _TURNS)


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, k, tree, node, n, before, own) to places, positions and ancestor intervals."""

    def walk() -> Iterator[dict]:
        conv, start, position = _START, 0, 0
        attends: list[tuple[int, int]] = []
        for row in _rows(batches):
            if conv is _START or row["conv"] != conv:
                conv, start, position, attends = row["conv"], 0, 0, []
            start += row["before"]
            shown = [{"start": a, "end": b} for a, b in attends] if row["own"] else None
            yield {"conv": conv, "k": row["k"], "tree": row["tree"], "node": row["node"], "own": row["own"], "start": start, "position": position, "attends": shown}
            end = start + row["n"]
            if attends and attends[-1][1] == start:
                attends[-1] = (attends[-1][0], end)
            else:
                attends.append((start, end))
            start, position = end, position + row["n"]

    return _packed(walk(), _NODES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, position, segment, loss range) to a row for each conversation."""

    def walk() -> Iterator[dict]:
        conv, out, whole, loss = _START, {}, hashlib.sha256(), hashlib.sha256()

        def closed() -> dict:
            return out | {"turns_sha256": whole.hexdigest(), "loss_sha256": loss.hexdigest()}

        for row in _rows(batches):
            if conv is _START or row["conv"] != conv:
                if conv is not _START:
                    yield closed()
                conv, whole, loss = row["conv"], hashlib.sha256(), hashlib.sha256()
                out = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
            segment = row["segment"]
            found = _TURN.fullmatch(segment)
            if found is None or row["position"] != out["formatted_chars"]:
                raise ValueError(f"conversation {conv}: broken at place {out['formatted_chars']}")
            whole.update(f"{plain(found[1])}\n{plain(found[2])}\n".encode())
            learned = plain(segment[row["loss_from"] : row["loss_to"]])
            loss.update(learned.encode())
            out["n_turns"] += 1
            out["loss_chars"] += len(learned)
            out["formatted_chars"] += len(segment)
        if conv is not _START:
            yield closed()

    return _packed(walk(), _READ)


def write(conversations: DataFrame, conv: str, turn: str, role: str, text: str, folder: str) -> None:
    """Format all conversations into ``folder``.

    ``segments``: tree, start, n, position, loss_from, loss_to, attends and segment of each
    node, in depth-first order. ``conversations``: the id, tree and the nodes' starts.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    ordered.mapInArrow(_turns, TURNS).write.parquet(f"{folder}/turns")
    turns = spark.read.parquet(f"{folder}/turns")
    parts = ("parent", "tree", "n", "loss_from", "loss_to", "segment")
    nodes = turns.groupBy("node").agg(F.min("conv").alias("owner"), *(F.any_value(name).alias(name) for name in parts))
    nodes.write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")

    path = turns.select("conv", "k", "node", "n").join(nodes.select("node", "owner"), "node")
    path = path.select("conv", "k", "node", "n", F.col("conv").eqNullSafe(F.col("owner")).alias("own"))
    below = Window.partitionBy("conv").orderBy(F.desc("k"))
    owned = path.select("node", F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).over(below).alias("owned"))
    subtrees = owned.groupBy("node").agg(F.sum("owned").alias("size"))

    siblings = nodes.where("parent is not null").select("node", "parent", F.substring("node", 1, 2).alias("piece")).join(subtrees, "node")
    inside = F.sum("size").over(Window.partitionBy("parent", "piece").orderBy("node")) - F.col("size")
    pieces = siblings.groupBy("parent", "piece").agg(F.sum("size").alias("total"))
    ahead = F.sum("total").over(Window.partitionBy("parent").orderBy("piece")) - F.col("total")
    placed = siblings.select("node", "parent", "piece", inside.alias("inside")).join(pieces.select("parent", "piece", ahead.alias("ahead")), ["parent", "piece"])
    before = placed.select("node", (F.col("inside") + F.col("ahead")).alias("before"))

    known = path.join(before, "node", "left").join(nodes.select("node", "tree"), "node").withColumn("before", F.coalesce("before", F.lit(0)))
    walked = known.repartition("conv").sortWithinPartitions("conv", "k").select("conv", "k", "tree", "node", "n", "before", "own")
    walked.mapInArrow(_layout, NODES).write.parquet(f"{folder}/layout")
    layout = spark.read.parquet(f"{folder}/layout")
    emitted = layout.where("own").select("node", "start", "position", "attends").join(nodes.drop("owner", "parent"), "node")
    emitted.orderBy("tree", "start").write.parquet(f"{folder}/segments")
    layout.select("conv", "k", "tree", "start").write.parquet(f"{folder}/conversations")


def read(spark, folder: str) -> DataFrame:
    """``READ`` of each conversation, from the written segments."""
    segments = spark.read.parquet(f"{folder}/segments").select("tree", "start", "position", "segment", "loss_from", "loss_to")
    places = spark.read.parquet(f"{folder}/conversations")
    met = places.join(segments, ["tree", "start"]).repartition("conv").sortWithinPartitions("conv", "k")
    return met.select("conv", "position", "segment", "loss_from", "loss_to").mapInArrow(_read, READ)
