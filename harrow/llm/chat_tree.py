"""Conversations as one prefix tree, every shared turn written once.

A node is a turn together with all turns before it; its id is a 128-bit hash
chained along the conversation. Conversations are sorted by the ids of their
turns, and a node belongs to the first conversation that has it, so the nodes in
order of (conversation, turn) are the tree depth first. They are written as one
stream of characters. Every node has its place in the stream, the position id
of its first character (the length of what comes before it in a conversation),
and the stream intervals of its ancestors, which are all that it may attend to
besides itself; intervals that touch are one.

Template: each turn is ``<s>``, the role's mark, the text, ``</s>``. The mark is
``[INST]`` for user, ``[/INST]`` for assistant, ``[ROLE]name[/ROLE]`` for any
other. In texts and names a backslash is doubled, and a control string gets a
backslash after its first character, so none can occur there, and removing each
backslash, or one of two, gives the text back. Under the loss mask are the
texts of the assistant.

Conversations are walked through in sorted order, a turn at a time; nothing
grows with the number of conversations that share a turn.

Defined results: a NULL text or role is empty; turns of a conversation come by
(turn, role, text), NULL first, repeated rows being repeated turns; the rows
with a NULL id are one conversation with that id; other columns are not read;
an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import arrow_map, kept

# Characters of the stream in a row of its table.
CHUNK = 1024
MARK = re.compile(r"<s>(\[/?INST\]|\[ROLE\](.*?)\[/ROLE\])", re.DOTALL)
INTERVALS = "array<struct<start:long,end:long>>"


# --- template -----------------------------------------------------------

def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(doubled, r"<(/?s>)", r"<\\$1"), r"\[(/?(?:INST|ROLE)\])", r"[\\$1")


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def role_mark(role: Column) -> Column:
    return F.when(role == "user", "[INST]").when(role == "assistant", "[/INST]").otherwise(
        F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]")))


def parsed(formatted: str, mask: str) -> tuple[list[tuple[str, str]], str]:
    """(role, text) of every turn of a formatted conversation, and the text under the loss."""
    turns, learned, at = [], [], 0
    for piece in formatted.split("</s>")[:-1]:
        mark = MARK.match(piece)
        role = {"[INST]": "user", "[/INST]": "assistant"}.get(mark[1], unescaped(mark[2] or ""))
        turns.append((role, unescaped(piece[mark.end():])))
        end = at + len(piece) + len("</s>")
        first = mask.find("1", at, end)
        if first >= 0:
            learned.append(unescaped(formatted[first: mask.rfind("1", at, end) + 1]))
        at = end
    return turns, "".join(learned)


# --- tree ---------------------------------------------------------------

@dataclass
class ChatTree:
    """``nodes``: node, parent, depth, offset, length, position, loss_start, loss_end (within
    the node), ancestors. ``stream``: chunk, text, mask (``1`` under the loss). ``conversations``:
    conv_id, n_turns, intervals of the stream that make up the conversation, in order."""

    nodes: DataFrame
    stream: DataFrame
    conversations: DataFrame


def _walk(turns: DataFrame) -> DataFrame:
    """Chain the ids of the turns of each conversation; rows come sorted by key and order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, depth, node, position = None, 0, b"", 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("depth", "parent", "node", "position")}
            for key, piece, size in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if key != current:
                    current, depth, node, position = key, 0, b"", 0
                parent, node = node, hashlib.blake2b(node + piece.encode(), digest_size=16).digest()
                for name, value in (("depth", depth), ("parent", parent), ("node", node), ("position", position)):
                    out[name].append(value)
                depth, position = depth + 1, position + size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out["depth"], pa.int32()), pa.array(out["parent"], pa.binary()), pa.array(out["node"], pa.binary()),
                 pa.array(out["position"], pa.int64())], [*batch.schema.names, "depth", "parent", "node", "position"])

    columns = ["key", "conv_id", "piece", "length", "loss_start", "loss_end"]
    return arrow_map(
        turns.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select(*columns), walk,
        "key string, conv_id long, piece string, length int, loss_start int, loss_end int, depth int, parent binary, node binary, position long")


def _placed(nodes: DataFrame) -> DataFrame:
    """Add ``offset``: the lengths of all nodes before, by (rank, depth)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = batch.column("length").to_numpy().astype(np.int64)
            ends = total + np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(ends - lengths)], [*batch.schema.names, "part", "local"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    local = kept(arrow_map(nodes.repartitionByRange("rank", "depth").sortWithinPartitions("rank", "depth"), place, f"{schema}, part int, local long"), "tree-nodes")
    # A row for each partition meets in one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = local.groupBy("part").agg(F.sum("length").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return local.join(bases, "part").withColumn("offset", F.col("base") + F.col("local")).drop("part", "local", "base")


def _intervals(paths: DataFrame) -> DataFrame:
    """(key, node, intervals): of each conversation (node NULL) and of the ancestors of its own nodes."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, []
        for batch in batches:
            rows: list[tuple] = []
            for key, node, mine, start, end in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "mine", "offset", "end")), strict=True):
                if key != current:
                    if current is not None:
                        rows.append((current, None, [dict(start=a, end=b) for a, b in own]))
                    current, own = key, []
                if mine:
                    rows.append((key, node, [dict(start=a, end=b) for a, b in own]))
                if own and own[-1][1] == start:
                    own[-1] = (own[-1][0], end)
                else:
                    own.append((start, end))
            yield _interval_rows(rows)
        if current is not None:
            yield _interval_rows([(current, None, [dict(start=a, end=b) for a, b in own])])

    ordered = paths.repartition("key").sortWithinPartitions("key", "depth").select("key", "node", "mine", "offset", "end")
    return arrow_map(ordered, merge, f"key string, node binary, intervals {INTERVALS}")


def _interval_rows(rows: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], kind)],
        ["key", "node", "intervals"])


def build(conversations: DataFrame, chunk: int = CHUNK) -> ChatTree:
    """The tree of a table (conv_id, turn, role, text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    made = rows.withColumn("mark", role_mark(F.col("role"))).withColumn("inner", escaped(F.col("text"))).withColumn(
        "piece", F.concat(F.lit("<s>"), "mark", "inner", F.lit("</s>")))
    start = F.length("mark") + 3
    made = made.withColumn("length", F.length("piece")).withColumn("loss_start", F.when(F.col("role") == "assistant", start)).withColumn(
        "loss_end", F.when(F.col("role") == "assistant", start + F.length("inner")))
    turns = kept(_walk(made), "chat-turns")

    path = F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"])
    ordered = turns.groupBy("key").agg(F.max("conv_id").alias("conv_id"), F.count("*").alias("n_turns"), path.alias("path")).repartitionByRange(
        "path", "key").sortWithinPartitions("path", "key")
    ranks = kept(ordered.select("key", "conv_id", "n_turns", F.monotonically_increasing_id().alias("rank")), "chat-ranks")

    ranked = turns.join(ranks.select("key", "rank"), "key")
    same = ["parent", "depth", "position", "length", "loss_start", "loss_end", "piece"]
    merged = ranked.groupBy("node").agg(F.min("rank").alias("rank"), *[F.any_value(c).alias(c) for c in same])
    placed = kept(_placed(merged), "chat-nodes")

    # A node is wide where many conversations share it, and so is one side of this join only.
    spots = placed.select("node", "offset", (F.col("offset") + F.col("length")).alias("end"), F.col("rank").alias("owner"))
    paths = ranked.select("key", "rank", "depth", "node").join(spots, "node").withColumn("mine", F.col("rank") == F.col("owner"))
    found = kept(_intervals(paths), "chat-intervals")
    ancestors = found.where("node is not null").select("node", F.col("intervals").alias("ancestors"))
    nodes = placed.join(ancestors, "node").select(
        "node", "parent", "depth", "offset", "length", "position", "loss_start", "loss_end", "ancestors")
    whole = ranks.join(found.where("node is null").select("key", "intervals"), "key").select("conv_id", "n_turns", "intervals")
    return ChatTree(nodes, kept(_stream(placed, chunk), "chat-stream"), whole)


def _stream(placed: DataFrame, chunk: int) -> DataFrame:
    """(chunk, text, mask): the pieces of all nodes end to end, ``chunk`` characters a row."""
    zeros = lambda n: F.repeat(F.lit("0"), n)
    masked = placed.select("offset", "piece", "length", F.when(F.col("loss_start").isNull(), zeros(F.col("length"))).otherwise(F.concat(
        zeros(F.col("loss_start")), F.repeat(F.lit("1"), F.col("loss_end") - F.col("loss_start")), zeros(F.col("length") - F.col("loss_end")))).alias("marks"))
    last = F.expr(f"(offset + length - 1) div {chunk}")
    parts = masked.withColumn("chunk", F.explode(F.sequence(F.expr(f"offset div {chunk}"), last)))
    begin = F.greatest(F.lit(0), F.col("chunk") * chunk - F.col("offset")).cast("int")
    size = (F.least(F.col("offset") + F.col("length"), (F.col("chunk") + 1) * chunk) - F.col("offset") - begin).cast("int")
    parts = parts.select("chunk", "offset", F.substring("piece", begin + 1, size).alias("text"), F.substring("marks", begin + 1, size).alias("mask"))
    rows = F.array_sort(F.collect_list(F.struct("offset", "text", "mask")))
    return parts.groupBy("chunk").agg(rows.alias("rows")).select(
        "chunk", F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text"),
        F.array_join(F.transform("rows", lambda r: r["mask"]), "").alias("mask"))


def read_conversations(tree: ChatTree, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, formatted, turns, learned) of every conversation, from the stream by its intervals.

    ``turns`` are (role, text), ``learned`` is the text under the loss mask, unescaped.
    """
    wanted = tree.conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "conv_id", F.posexplode("intervals").alias("number", "i"))
    parts = wanted.select(
        "key", "conv_id", "i.start", "i.end", "number",
        F.explode(F.sequence(F.expr(f"i.start div {chunk}"), F.expr(f"(i.end - 1) div {chunk}"))).alias("chunk"))
    begin = F.greatest(F.lit(0), F.col("start") - F.col("chunk") * chunk).cast("int")
    size = (F.least(F.col("end") - F.col("chunk") * chunk, F.lit(chunk)) - begin).cast("int")
    read = parts.join(tree.stream, "chunk").select(
        "key", "conv_id", "number", "chunk", F.substring("text", begin + 1, size).alias("text"), F.substring("mask", begin + 1, size).alias("mask"))
    rows = F.array_sort(F.collect_list(F.struct("number", "chunk", "text", "mask")))
    whole = read.groupBy("key").agg(F.max("conv_id").alias("conv_id"), rows.alias("rows")).select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("formatted"),
        F.array_join(F.transform("rows", lambda r: r["mask"]), "").alias("mask"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            found = [parsed(*x) for x in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True)]
            turns = [[dict(role=r, text=t) for r, t in x] for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("formatted"), pa.array(turns, kind), pa.array([x for _, x in found], pa.string())],
                ["conv_id", "formatted", "turns", "learned"])

    return arrow_map(whole, parse, "conv_id long, formatted string, turns array<struct<role:string,text:string>>, learned string")
