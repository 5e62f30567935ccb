"""Chat formatting as a prefix tree: turns that conversations share from their start on are written once.

A node is a turn after a given history. The nodes of a tree (a common first turn) stand depth-first in one stream of
code points; each carries its place in the stream, its position ids (how much stands before it on its own path), and the
intervals of the stream that its ancestors fill, which is all that it may attend to besides itself. A run of
nodes without a branch is contiguous, so there is an interval for each branch on the way, not for each turn.

Template: ``<s>role\\ntext</s>``. Control strings inside roles and texts are escaped by a backslash and a letter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.common import with_running_base
from chunkloom.session import written

# Strings that chat templates use to steer, and what stands for their first character in a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LETTERS = {"<": "l", "[": "b", "\\": "e", "\n": "n"}
BACK = {v: k for k, v in LETTERS.items()}
ESCAPED = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
LEARNED = ("assistant",)


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + LETTERS[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends in it."""
    head = "<s>" + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + "</s>", len(head), len(head) + len(body)


def parse_turn(piece: str) -> tuple[str, str]:
    head, _, body = piece.removeprefix("<s>").removesuffix("</s>").partition("\n")
    return unescape(head), unescape(body)


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation in one partition and in order; workers stream through them, holding one turn at a time."""
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def _streamed(df: DataFrame, step, schema: str) -> DataFrame:
    """``step(row, state)`` returns output rows; ``state`` is a new dict for each conversation."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        types = None
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, 2000):
                for row in batch.slice(start, 2000).to_pylist():
                    if state is None or row["conv"] != conv:
                        conv, state = row["conv"], {}
                    out += step(row, state)
                if out:
                    types = types or _arrow(schema)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []

    return df.mapInArrow(run, schema)


def _arrow(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


def formatted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of ``turns`` (conv_id, turn, role, text; other columns are left alone).

    nodes: tree_id, node_id, parent_id, offset, n_chars, piece, position, loss_begin, loss_end (inside the piece; null where nothing is
    learned), ancestors (intervals of the tree's stream). members: conv_id, depth, node_id.
    Null roles and texts count as empty; rows without a conv_id are one conversation; turns that share a number follow
    role and text.
    """
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"), F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def grow(row, state):
        parent = state.get("key")
        head, body = row["role"].encode(), row["text"].encode()
        key = hashlib.blake2b((parent or "").encode() + len(head).to_bytes(8) + head + body, digest_size=16).hexdigest()
        state.update(key=key, root=state.get("root", key), depth=state.get("depth", -1) + 1, position=state.get("position", 0) + state.get("chars", 0))
        piece, begin, end = format_turn(row["role"], row["text"])
        state["chars"] = len(piece)
        learned = row["role"] in LEARNED
        return [(row["conv"], row["conv_id"], state["depth"], key, parent, state["root"], state["position"], len(piece), piece, begin if learned else None, end if learned else None)]

    grown = _streamed(
        _dealt(rows, "turn", "role", "text"), grow,
        "conv string, conv_id long, depth long, key string, parent string, root string, position long, chars long, piece string, loss_begin long, loss_end long",
    )
    grown = written(grown, "turns")
    # One row per node; a first turn that a third of all conversations share is summed up where its rows lie.
    same = ("parent", "root", "depth", "position", "chars", "piece", "loss_begin", "loss_end")
    nodes = grown.groupBy("key").agg(F.min("conv").alias("stands_in"), *[F.first(c).alias(c) for c in same])
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
    nodes = written(nodes.join(children, "parent", "left").withColumn("head", (F.coalesce("children", F.lit(2)) > 1).cast("int")), "nodes")

    def walk(row, state):
        if row["head"]:
            state["path"] = state.get("path", "") + row["key"]
        return [(row["key"], state["path"], row["depth"], row["chars"], row["root"])] if row["stands_in"] == row["conv"] else []

    steps = grown.select("conv", "depth", "key")
    paths = _streamed(
        _dealt(steps.join(nodes.select("key", "head", "stands_in", "chars", "root"), "key"), "depth"), walk, "key string, path string, depth long, chars long, root string"
    )
    ordered = paths.repartitionByRange("path", "depth").sortWithinPartitions("path", "depth")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts = []
            for chars in batch.column("chars").to_pylist():
                starts.append(before)
                before += chars
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("root"), batch.column("chars"), pa.array([part] * batch.num_rows, pa.int64()), pa.array(starts, pa.int64())], ["key", "root", "chars", "part", "part_start"]
            )

    placed = written(ordered.mapInArrow(place, "key string, root string, chars long, part long, part_start long"), "places")
    bases = with_running_base(placed, "part", "chars", "base")
    placed = placed.join(F.broadcast(bases), "part").select("key", "root", (F.col("part_start") + F.col("base")).alias("at"))  # a row of 16 bytes per partition
    trees = placed.groupBy("root").agg(F.min("at").alias("tree_at"))
    offsets = written(placed.join(trees, "root").select("key", (F.col("at") - F.col("tree_at")).alias("offset")).join(nodes.select("key", "stands_in", "chars"), "key"), "offsets")

    def gather(row, state):
        spans = state.setdefault("spans", [])
        out = [(row["key"], row["offset"], [list(s) for s in spans])] if row["stands_in"] == row["conv"] else []
        if spans and spans[-1][1] == row["offset"]:
            spans[-1][1] += row["chars"]
        else:
            spans.append([row["offset"], row["offset"] + row["chars"]])
        return out

    seen = _streamed(_dealt(steps.join(offsets, "key"), "depth"), gather, "key string, offset long, ancestors array<array<long>>")
    tree = nodes.join(seen, "key").select(
        F.col("root").alias("tree_id"), F.col("key").alias("node_id"), F.col("parent").alias("parent_id"), "offset", F.col("chars").alias("n_chars"), "piece", "position", "loss_begin", "loss_end", "ancestors"
    )
    return tree, grown.select("conv_id", "depth", F.col("key").alias("node_id"))


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the tree alone, a row per conversation."""
    rows = members.join(nodes.select("node_id", "piece", "loss_begin", "loss_end"), "node_id")
    rows = rows.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"), "conv_id", "depth", "piece", "loss_begin", "loss_end")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, done = None, None, []

        def made(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def ended(s):
            return (s["id"], s["turns"], s["all"].hexdigest(), s["loss"], s["learned"].hexdigest(), s["chars"])

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                for row in batch.slice(start, 2000).to_pylist():
                    if now is None or row["conv"] != conv:
                        if now is not None:
                            done.append(ended(now))
                        conv, now = row["conv"], {"id": row["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss": 0, "learned": hashlib.sha256(), "chars": 0}
                    role, text = parse_turn(row["piece"])
                    now["turns"] += 1
                    now["all"].update(f"{role}\n{text}\n".encode())
                    now["chars"] += len(row["piece"])
                    if row["loss_begin"] is not None:
                        learned = unescape(row["piece"][row["loss_begin"] : row["loss_end"]])
                        now["loss"] += len(learned)
                        now["learned"].update(learned.encode())
                if len(done) >= 2000:
                    yield made(done)
                    done = []
        if now is not None:
            done.append(ended(now))
        if done:
            yield made(done)

    return _dealt(rows, "depth").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
