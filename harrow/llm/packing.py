"""Best-fit packing of token sequences, over all pieces at once.

A document longer than a sequence is cut into pieces of full length; the first
piece takes the rest. Best fit, longest first, asks only how many pieces there
are of each length: pieces of one length are alike, and so are bins that are
equally full. So tasks number their pieces by length, one row for each length
goes to the driver, at most as many as a sequence has tokens, and comes back as
runs: pieces of a length, by number, that go to bins in a row. Every piece then
finds its run. No piece and no bin is left out of this, whatever their number.

Defined results: a NULL or empty text is the end id alone; a NULL id stays
NULL; repeated rows are packed each; other columns are not read; an empty table
gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import STEP_BYTES, arrow_map, kept, steps
from harrow.llm.encoding import shared_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: bin of each item, place in it, and how full each bin is."""
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    with_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    fills: list[int] = []
    for i, size in zip(order.tolist(), np.asarray(sizes)[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = with_room[room]
            b = own.pop()
            if not own:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = b, capacity - room
        fills[b] += size
        room -= size
        if room:
            with_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins, places, np.array(fills, np.int64)


RUNS = "length long, first long, last long, to_bin long, per_bin long, room long"


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """What ``best_fit`` does to ``counts[length]`` pieces of each length, as runs (``RUNS``).

    The pieces ``first`` to ``last`` of a length go to bins from ``to_bin`` on,
    ``per_bin`` to each, into bins with this room.
    """
    runs = []
    with_room: dict[int, list[tuple[int, int]]] = {}  # bins in a row with the same room: the first, how many
    rooms = 0  # bit r: some bin has room r
    bins = 0

    def add(room: int, first_bin: int, many: int) -> None:
        nonlocal rooms
        if room and many:
            with_room.setdefault(room, []).append((first_bin, many))
            rooms |= 1 << room

    for size in sorted(counts, reverse=True):
        done, n = 0, counts[size]
        while done < n:
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                first_bin, many = with_room[room].pop()
                if not with_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, first_bin, many = capacity, bins, -(-(n - done) // (capacity // size))
                bins += many
            # A bin that has taken a piece is the tightest for the next one, until none fits.
            per_bin = room // size
            whole, rest = min(many, (n - done) // per_bin), 0
            if whole < many:
                rest = n - done - whole * per_bin
            took = whole * per_bin + rest
            runs.append((size, done, done + took - 1, first_bin, per_bin, room))
            done += took
            add(room, first_bin + whole + (rest > 0), many - whole - (rest > 0))
            add(room - per_bin * size, first_bin, whole)
            if rest:
                add(room - rest * size, first_bin + whole, 1)
    return runs


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of these lengths: document, number, start, length."""
    n = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = lengths - (n - 1) * capacity
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


def numbered_pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool, doc_id: str, text: str, step_bytes: int,
) -> DataFrame:
    """Pieces of every document, those of one length numbered within their task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), shared_encoder(vocabulary)
        before = np.zeros(capacity + 1, np.int64)
        for step in steps(batches, "text", step_bytes):
            ids, at = encoder.encode(step.column("text"))
            n = len(at) - 1
            full = np.full(len(ids) + n, end_id, "<u4")
            inside = np.ones(len(full), bool)
            inside[at[1:] + np.arange(n)] = False
            full[inside] = ids
            first = at[:-1] + np.arange(n)
            doc, piece, start, length = cut(np.diff(at) + 1, capacity)
            begins = first[doc] + start
            view = memoryview(full).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a: 4 * (a + k)]) for a, k in zip(begins.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
            many = np.bincount(length, minlength=capacity + 1)
            order = np.argsort(length, kind="stable")
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(length)) - (np.cumsum(many) - many)[length[order]]
            number += before[length]
            before += many
            arrays = {
                "doc_id": step.column("doc_id").combine_chunks().take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                "length": pa.array(length), "ids_crc32": pa.array(crc), "part": pa.array(np.full(len(doc), part, np.int32)), "number": pa.array(number),
            }
            if with_ids:
                arrays["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begins, len(full)).astype(np.int32)), pa.array(full.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(arrays)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return arrow_map(rows, pack, PIECES + (", ids array<int>" if with_ids else ""))


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, fan_in: int = 8, slack: int = 8,
    forward: int = 256, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text", step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece.

    ``with_ids`` adds the token ids; ``sequences`` puts them together. ``fan_in``,
    ``slack`` and ``forward`` bounded a packing in rounds; they change nothing now.
    """
    pieces = kept(numbered_pieces(docs, vocabulary, capacity, end_id, with_ids, doc_id, text, step_bytes), "pieces")
    # A row for each length in each task, with the pieces of that length in the tasks before.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = kept(pieces.groupBy("part", "length").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))), "piece-counts")
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("count")).collect()}  # a row for each length
    runs = docs.sparkSession.createDataFrame(best_fit_runs(counts, capacity), RUNS)
    placed = pieces.join(by_part.select("part", "length", "before"), ["part", "length"]).withColumn("number", F.col("number") + F.col("before"))
    within = (F.col("p.length") == F.col("r.length")) & F.col("p.number").between(F.col("r.first"), F.col("r.last"))
    in_run = F.col("p.number") - F.col("r.first")
    return placed.alias("p").join(F.broadcast(runs).alias("r"), within).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32",
        (F.col("r.to_bin") + F.expr("(p.number - r.first) div r.per_bin")).alias("sequence_id"),
        (F.lit(capacity) - F.col("r.room") + in_run % F.col("r.per_bin") * F.col("p.length")).alias("offset"), *["p.ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, starts): the ids of each sequence and where its pieces begin.

    ``packed`` comes from ``pack_documents(with_ids=True)``; a sequence has at
    most as many pieces as it has tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["offset"]).alias("starts"),
    )
