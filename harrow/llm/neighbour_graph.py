"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Every distinct vector is a node. A node's first neighbours come from a few random
trees: signs of random projections, read as a number, put alike vectors next to
each other, and the ordered rows are cut into blocks of fixed size. Then rounds of
NN-descent follow. A node's list holds the nodes it points to and the nearest of
those that point to it; all pairs of a list with a fresh member are neighbours of
neighbours, and each end of a pair learns of the other if it is nearer than the
worst of its own neighbours. The rounds are joins: lists with the vectors of their
members, then what was learned with the nodes.

A search starts at the node of the query's own vector, where there is one, and at
the nearest of a bounded sample. In each round the nodes of the beam that were not
opened yet are joined with their neighbours, nodes seen before are left out, and
the others are measured and enter the beam. It ends when all beams are opened.
Graph and beam use vectors of one byte for each component; the scores of the
result are computed from the original vectors.

Bounds: ``K`` neighbours and ``REVERSE`` backward ones for each node (the list of
the method, its only limit), a beam of ``BEAM`` nodes for each query, a sample of
``SAMPLE`` nodes for starts and the middle of the projections. Every node is in
the graph. Copies of one vector are one node, so they neither fill the lists nor
meet each other; the nearest k + 1 ids of each node come back at the end. Recall
against brute force is measured in the tests.

Defined results: rows with a NULL id, and vectors that are NULL, empty, zero or hold
a NULL or non-finite component, take no part; a query meets all rows with another
id and as many components; repeated rows are candidates each; of an id with several
vectors the smallest is the query; equal distances go to the smaller id; other
columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import arrow_map, forget, kept, ragged

K = 32
REVERSE = 32
TREES = 6
BLOCK = 512
BITS = 24
LEARNED = 4
ROUNDS = 4
# The rounds end when so small a part of all neighbours is new.
STILL = 0.001
BEAM = 224
STARTS = 4
SAMPLE = 1024

STATE = "node long, size int, code binary, scale double, ids array<long>, away array<double>, fresh array<boolean>"
LISTS = "node long, ids array<long>, away array<double>"


# --- arrays ---------------------------------------------------------------

def _lists(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Arrow lists of consecutive values; ``starts`` has one more entry than there are lists."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each list); NULL lists are empty."""
    lengths = np.array(column.value_lengths().fill_null(0))
    return np.array(column.flatten()), lengths.astype(np.int64)


def _codes(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """The bytes of some rows as a matrix of signed numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.int8)
    return data[offsets[:-1][rows][:, None] + np.arange(size)]


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that hold whole groups; groups are of bounded size."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        both = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        values = both.column(key).to_numpy()
        last = int(np.searchsorted(values, values[-1]))
        if last:
            yield both.slice(0, last)
        held = pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(last, both.num_rows))) for c in both.columns], schema=both.schema)
    if held is not None and held.num_rows:
        yield held


def _nearest(node: np.ndarray, ids: np.ndarray, away: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest ids of every node, each id once, known ones before fresh ones; sorted by node and distance."""
    order = np.lexsort((fresh, ids, node))
    node, ids, away, fresh = node[order], ids[order], away[order], fresh[order]
    once = np.ones(len(node), bool)
    once[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
    node, ids, away, fresh = node[once], ids[once], away[once], fresh[once]
    order = np.lexsort((ids, away, node))
    node, ids, away, fresh = node[order], ids[order], away[order], fresh[order]
    begin = np.searchsorted(node, node)
    near = np.arange(len(node)) - begin < k
    return node[near], ids[near], away[near], fresh[near]


def _learned(node: np.ndarray, ids: np.ndarray, away: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, ids, away) of what nodes learned, in batches."""
    node, ids, away, _ = _nearest(node, ids, away, np.zeros(len(node), bool), k)
    names, starts = np.unique(node, return_index=True)
    starts = np.append(starts, len(node))
    for a in range(0, len(names), 8192):
        b = min(len(names), a + 8192)
        some, at = slice(starts[a], starts[b]), starts[a: b + 1] - starts[a]
        yield pa.RecordBatch.from_arrays([pa.array(names[a:b]), _lists(at, ids[some]), _lists(at, away[some])], ["node", "ids", "away"])


def _squares(vectors: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of each matrix."""
    own = np.einsum("...i,...i->...", vectors, vectors)
    return np.maximum(own[..., :, None] + own[..., None, :] - 2 * (vectors @ np.swapaxes(vectors, -1, -2)), 0)


# --- the graph -------------------------------------------------------------

@dataclass
class Graph:
    """``nodes``: (node, size, vector, code, scale); ``links``: (node, near)."""

    nodes: DataFrame
    links: DataFrame
    sample: dict[int, tuple[np.ndarray, np.ndarray]]  # for each number of components: node ids and vectors


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.col(vec_id).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    # One zero, as -0.0 equals 0.0.
    return vectors.where(whole).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: x + 0.0).alias("vector"))


def _coded(nodes: DataFrame) -> DataFrame:
    """Adds code, a byte for each component, and the scale that a byte stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths = _flat(batch.column("vector"))
            starts = np.cumsum(lengths) - lengths
            scale = np.maximum.reduceat(np.abs(flat), starts) / 127 if len(flat) else np.zeros(0)
            scale = np.maximum(scale, np.finfo(np.float64).tiny)
            code = np.rint(flat / np.repeat(scale, lengths)).astype(np.int8)
            offsets = np.append(starts, len(flat)).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("size"), batch.column("vector"), coded, pa.array(scale)], ["node", "size", "vector", "code", "scale"])

    return arrow_map(nodes, run, "node long, size int, vector array<double>, code binary, scale double")


def _projections(size: int, trees: int) -> np.ndarray:
    return np.random.default_rng(size).normal(size=(size, trees * BITS)).astype(np.float32)


def _tree_places(nodes: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], trees: int) -> DataFrame:
    """(tree, size, place, node, code, scale): where each node stands in each tree's order."""
    middles = nodes.sparkSession.sparkContext.broadcast({
        size: np.median(_unit(own) @ _projections(size, trees), axis=0) for size, (_, own) in sample.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                unit = _unit(_codes(batch.column("code"), rows, size))
                above = unit @ _projections(int(size), trees) > middles.value.get(int(size), 0)
                places = above.reshape(len(rows), trees, BITS) @ weights
                own = batch.take(pa.array(rows))
                for tree in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), tree, np.int32)), own.column("size"), pa.array(places[:, tree]), own.column("node"), own.column("code"),
                         own.column("scale")], ["tree", "size", "place", "node", "code", "scale"])

    return arrow_map(nodes.select("node", "size", "code", "scale"), run, "tree int, size int, place long, node long, code binary, scale double")


def _unit(vectors: np.ndarray) -> np.ndarray:
    own = vectors.astype(np.float32) if vectors.dtype == np.int8 else (vectors / np.abs(vectors).max(axis=1, keepdims=True)).astype(np.float32)
    return own / np.linalg.norm(own, axis=1, keepdims=True)


def _near_in_blocks(places: DataFrame, k: int, block: int) -> DataFrame:
    """The k nearest of each node in its block of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def near(some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            tree, sizes = some.column("tree").to_numpy(), some.column("size").to_numpy()
            cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (sizes[1:] != sizes[:-1])) + 1
            for part in np.split(np.arange(len(tree)), cuts):
                if len(part) < 2:
                    continue
                scale = some.column("scale").to_numpy()[part]
                top = scale.max()
                own = _codes(some.column("code"), part, int(sizes[part[0]])).astype(np.float32) * (scale / top)[:, None].astype(np.float32)
                squares = _squares(own)
                np.fill_diagonal(squares, np.inf)
                most = min(k, len(part) - 1)
                at = np.argpartition(squares, most - 1, axis=1)[:, :most]
                nodes = some.column("node").to_numpy()[part]
                yield from _learned(
                    np.repeat(nodes, most), nodes[at].reshape(-1), np.sqrt(np.take_along_axis(squares, at, 1).astype(np.float64)).reshape(-1) * top, k)

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * block:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                while rows.num_rows >= 2 * block:
                    yield from near(rows.slice(0, block))
                    rows = rows.slice(block)
                held, size = [rows], rows.num_rows
        if size:
            yield from near(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    ordered = places.repartitionByRange("tree", "size", "place").sortWithinPartitions("tree", "size", "place", "node")
    return arrow_map(ordered, run, LISTS)


def _merged(state: DataFrame, learned: DataFrame, k: int) -> DataFrame:
    """The state after its nodes took what they learned; what is new is fresh."""
    nothing = {"size": "int", "code": "binary", "scale": "double", "fresh": "array<boolean>"}
    rows = state.unionByName(learned.select("node", "ids", "away", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is known so far of the node that the last batch ended with: its row, ids, distances, fresh marks.
        held: tuple[pa.RecordBatch | None, np.ndarray, np.ndarray, np.ndarray, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            row_node = batch.column("node").to_numpy()
            ids, lengths = _flat(batch.column("ids"))
            away, _ = _flat(batch.column("away"))
            is_state = np.array(batch.column("code").is_valid())
            node, fresh = np.repeat(row_node, lengths), np.repeat(~is_state, lengths)
            rows_at = np.flatnonzero(is_state)
            owners = batch.take(pa.array(rows_at))
            if held is not None:
                node, ids = np.concatenate((np.full(len(held[1]), held[4]), node)), np.concatenate((held[1], ids))
                away, fresh = np.concatenate((held[2], away)), np.concatenate((held[3], fresh))
                if held[0] is not None:
                    owners = pa.Table.from_batches([held[0], owners]).combine_chunks().to_batches()[0] if owners.num_rows else held[0]
            node, ids, away, fresh = _nearest(node, ids, away, fresh, k)
            last = int(row_node[-1])
            done = node != last
            names = owners.column("node").to_numpy()
            ended = np.flatnonzero(names != last)
            yield from _state_rows(owners.take(pa.array(ended)), node[done], ids[done], away[done], fresh[done])
            own = np.flatnonzero(names == last)
            held = (owners.take(pa.array(own)) if len(own) else None, ids[~done], away[~done], fresh[~done], last)
        if held is not None and held[0] is not None:
            yield from _state_rows(held[0], np.full(len(held[1]), held[4]), *held[1:4])

    return arrow_map(rows.repartition("node").sortWithinPartitions("node"), run, STATE)


def _state_rows(owners: pa.RecordBatch, node: np.ndarray, ids: np.ndarray, away: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of STATE for the nodes of ``owners`` (sorted), whose neighbours are sorted by node."""
    names = owners.column("node").to_numpy()
    if len(names):
        a, b = np.searchsorted(node, names), np.searchsorted(node, names, side="right")
        at, starts = ragged(a, b - a), np.append(0, np.cumsum(b - a))
        yield pa.RecordBatch.from_arrays(
            [*[owners.column(c) for c in ("node", "size", "code", "scale")], _lists(starts, ids[at]), _lists(starts, away[at]), _lists(starts, fresh[at])],
            ["node", "size", "code", "scale", "ids", "away", "fresh"])


def _members(state: DataFrame, reverse: int) -> DataFrame:
    """(node, other, fresh): whom each node points to, and the nearest ``reverse`` that point to it."""
    edges = state.select(F.col("node").alias("a"), F.explode(F.arrays_zip("ids", "away", "fresh")).alias("e")).select(
        "a", F.col("e.ids").alias("b"), F.col("e.away").alias("away"), F.col("e.fresh").alias("fresh"))
    order = Window.partitionBy("b").orderBy("away", "a")
    back = edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= reverse)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "fresh").unionByName(
        back.select(F.col("b").alias("node"), F.col("a").alias("other"), "fresh"))


def _local_join(state: DataFrame, k: int, reverse: int, most: int) -> DataFrame:
    """What the members of each node's list learn from each other: (node, ids, away)."""
    worst = F.when(F.size("ids") >= k, F.element_at("away", -1)).otherwise(float("inf"))
    vectors = state.select(F.col("node").alias("other"), "size", "code", "scale", worst.alias("worst"))
    lists = _members(state, reverse).join(vectors, "other").repartition("node").sortWithinPartitions("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, "node"):
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                yield from joined(batch, np.flatnonzero(sizes == size), int(size))

    def joined(batch: pa.RecordBatch, rows: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        of = batch.column("node").to_numpy()[rows]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        lengths = np.diff(np.append(starts, len(of)))
        other, fresh = batch.column("other").to_numpy()[rows], np.array(batch.column("fresh"))[rows].astype(bool)
        scale, worst = batch.column("scale").to_numpy()[rows], batch.column("worst").to_numpy()[rows]
        found: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(starts), 256):
            width = int(lengths[a: a + 256].max())
            place = np.arange(width)
            inside = place < lengths[a: a + 256, None]
            at = np.where(inside, starts[a: a + 256, None] + place, 0)
            top = scale[at].max()
            vectors = _codes(batch.column("code"), rows[at.reshape(-1)], size).astype(np.float32) * (scale[at.reshape(-1)] / top)[:, None].astype(np.float32)
            squares = _squares(vectors.reshape(*at.shape, size))
            ids = other[at]
            wanted = inside[:, :, None] & inside[:, None, :] & (ids[:, :, None] != ids[:, None, :]) & (fresh[at][:, :, None] | fresh[at][:, None, :])
            squares[~wanted] = np.inf
            n = min(most, width)
            best = np.argpartition(squares, n - 1, axis=2)[:, :, :n] if n < width else np.broadcast_to(place, squares.shape)
            away = np.sqrt(np.take_along_axis(squares, best, 2).astype(np.float64)) * top
            near = away < worst[at][:, :, None]
            g, i, j = np.nonzero(near)
            found.append((ids[g, i], ids[g, best[g, i, j]], away[g, i, j]))
        if found:
            yield from _learned(*[np.concatenate(x) for x in zip(*found, strict=True)], k)

    return arrow_map(lists, run, LISTS)


def _sample(nodes: DataFrame, rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """At most ``rows`` nodes, chosen by a hash, by number of components."""
    taken = nodes.select("node", "size", "vector").orderBy(F.xxhash64("vector"), "node").limit(rows).collect()
    return {
        size: (np.array([r[0] for r in taken if r[1] == size]), np.array([r[2] for r in taken if r[1] == size], np.float64))
        for size in {r[1] for r in taken}
    }


def build(
    vectors: DataFrame, k: int = K, reverse: int = REVERSE, trees: int = TREES, block: int = BLOCK, rounds: int = ROUNDS,
) -> Graph:
    """The neighbour graph of distinct vectors (a column ``vector`` of doubles)."""
    distinct = kept(vectors.groupBy("vector").agg(F.size(F.first("vector")).alias("size")), "distinct")
    numbered = distinct.select(F.monotonically_increasing_id().alias("node"), "size", "vector")
    nodes = kept(_coded(numbered), "nodes")
    forget(distinct)
    sample = _sample(nodes, SAMPLE)
    nothing = {"ids": "array<long>", "away": "array<double>", "fresh": "array<boolean>"}
    state = nodes.select("node", "size", "code", "scale", *[F.array().cast(t).alias(c) for c, t in nothing.items()])
    state = kept(_merged(state, _near_in_blocks(_tree_places(nodes, sample, trees), k, block), k), "graph")
    for _ in range(rounds):
        after = kept(_merged(state, _local_join(state, k, reverse, LEARNED), k), "graph")
        forget(state)
        state = after
        new, every = state.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("ids"))).first()
        if not every or new <= STILL * every:
            break
    links = kept(_members(state, reverse).groupBy("node").agg(F.collect_set("other").alias("near")), "links")
    forget(state)
    return Graph(nodes, links, sample)


# --- search ----------------------------------------------------------------

BEAMS = "query long, size int, code binary, scale double, seen array<long>, ids array<long>, away array<double>, opened array<boolean>"


def _started(queries: DataFrame, graph: Graph, starts: int) -> DataFrame:
    """(query, near): the own node, if any, and the nearest nodes of the sample."""
    shared = graph.nodes.sparkSession.sparkContext.broadcast(graph.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own = batch.column("size").to_numpy(), batch.column("node")
            queries_of, nodes_of = [np.array(batch.column("query"))[np.array(own.is_valid())]], [np.array(own.drop_null())]
            for size in np.unique(sizes):
                ids, vectors = shared.value.get(int(size), (np.zeros(0, np.int64), np.zeros((0, int(size)))))
                rows = np.flatnonzero(sizes == size)
                n = min(starts, len(ids))
                if not n:
                    continue
                mine = _codes(batch.column("code"), rows, int(size)) * batch.column("scale").to_numpy()[rows][:, None]
                top = max(np.abs(mine).max(), np.abs(vectors).max())
                mine, others = mine / top, vectors / top
                squares = (others * others).sum(axis=1) - 2 * (mine @ others.T)
                queries_of.append(np.repeat(batch.column("query").to_numpy()[rows], n))
                nodes_of.append(ids[np.argsort(squares, axis=1, kind="stable")[:, :n]].reshape(-1))
            query, node = np.concatenate(queries_of).astype(np.int64), np.concatenate(nodes_of).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(query), _lists(np.arange(len(node) + 1), node)], ["query", "near"])

    return arrow_map(queries, run, "query long, near array<long>")


def _row(beam: pa.Table, **changed: np.ndarray) -> pa.Table:
    """The beam's one row with some of its lists replaced."""
    names = [f.split()[0] for f in BEAMS.split(", ")]
    return pa.table({c: _lists(np.array([0, len(changed[c])]), changed[c]) if c in changed else beam.column(c)
                     for c in [*names, *[c for c in changed if c not in names]]})


def _list(beam: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.array(beam.column(column)[0].values, kind)


def _unseen(beams: DataFrame, near: DataFrame) -> DataFrame:
    """The beams, all of ``near`` noted as seen, with the list ``met`` of what is seen for the first time."""

    def run(beam: pa.Table, others: pa.Table) -> pa.Table:
        seen = _list(beam, "seen", np.int64)
        met = np.setdiff1d(np.array(others.column("near").combine_chunks().flatten(), np.int64), seen)
        return _row(beam, seen=np.union1d(seen, met), met=met)

    return beams.groupBy("query").cogroup(near.select(F.col("query").alias("asker"), "near").groupBy("asker")).applyInArrow(run, f"{BEAMS}, met array<long>")


def _measured(beams: DataFrame, met: DataFrame, width: int) -> DataFrame:
    """The beams after the nodes of ``met`` (query, other, code, scale) were measured; what was in a beam before is opened."""

    def run(beam: pa.Table, others: pa.Table) -> pa.Table:
        ids, away = _list(beam, "ids", np.int64), _list(beam, "away", np.float64)
        opened = np.arange(len(ids) + others.num_rows) < len(ids)
        if others.num_rows:
            mine = np.frombuffer(beam.column("code")[0].as_py(), np.int8) * beam.column("scale")[0].as_py()
            own = _codes(others.column("code").combine_chunks(), np.arange(others.num_rows), len(mine)) * others.column("scale").to_numpy()[:, None]
            top = max(np.abs(own).max(), np.abs(mine).max())
            ids = np.concatenate((ids, others.column("other").to_numpy()))
            away = np.concatenate((away, np.sqrt((((own - mine) / top) ** 2).sum(axis=1)) * top))
        best = np.lexsort((ids, away))[:width]
        return _row(beam, ids=ids[best], away=away[best], opened=opened[best])

    return beams.groupBy("query").cogroup(met.select(F.col("query").alias("asker"), "other", "code", "scale").groupBy("asker")).applyInArrow(run, BEAMS)


def search(graph: Graph, queries: DataFrame, width: int = BEAM, starts: int = STARTS, most_rounds: int = 64) -> DataFrame:
    """(query, node, score): the nearest nodes found for each query, at most ``width``.

    ``queries`` has (query, node, size, vector, code, scale), one row for each
    query; node is NULL for a vector that is not in the graph. Scores are exact.
    """
    beams = queries.select("query", "size", "code", "scale", *[
        F.array().cast(t).alias(c) for c, t in (("seen", "array<long>"), ("ids", "array<long>"), ("away", "array<double>"), ("opened", "array<boolean>"))])
    near = _started(queries.select("query", "node", "size", "code", "scale"), graph, starts)
    beams = kept(beams, "beams")
    vectors = graph.nodes.select(F.col("node").alias("other"), "code", "scale")
    for _ in range(most_rounds):
        noted = kept(_unseen(beams, near), "seen")
        met = noted.select("query", F.explode("met").alias("other")).join(vectors, "other")
        after = kept(_measured(noted.drop("met"), met, width), "beams")
        forget(beams)
        forget(noted)
        beams = after
        closed = F.filter(F.arrays_zip("ids", "opened"), lambda x: ~x["opened"])
        front = beams.select("query", F.explode(F.transform(closed, lambda x: x["ids"])).alias("node"))
        if front.isEmpty():
            break
        near = front.join(graph.links, "node").select("query", "near")
    found = beams.select("query", F.explode("ids").alias("node"))
    steps = F.zip_with("vector", "asked", lambda x, y: x - y)
    return found.join(graph.nodes.select("node", "vector"), "node").join(
        queries.select("query", F.col("vector").alias("asked")), "query").select("query", "node", _length(steps).alias("score"))


def _length(steps: Column) -> Column:
    """Euclidean length; of components whose squares leave the range of a double, by the largest of them."""
    def summed(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)

    squares, top = summed(steps), F.array_max(F.transform(steps, F.abs))
    scaled = top * F.sqrt(summed(F.transform(steps, lambda x: x / top)))
    return F.when(squares.between(1e-280, 1e300), F.sqrt(squares)).when(top == 0, 0.0).otherwise(scaled)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", width: int = BEAM, **graph_options: int,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for every query; ``is_query`` tells them by the id."""
    rows = usable(vectors, vec_id, vector)
    graph = build(rows, **graph_options)
    # Rows by node; a node's copies come back as its smallest ids.
    placed = kept(rows.join(graph.nodes.select("node", "vector"), "vector").groupBy("node", "vec_id").agg(F.count("*").alias("copies")), "placed")
    # A query's own id takes one place of its result, or several where an id has several vectors.
    own = placed.where(is_query).groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    by_id = Window.partitionBy("node").orderBy("vec_id")
    members = placed.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + own).drop("place")
    asked = placed.where(is_query).join(graph.nodes.select("node", "vector"), "node").groupBy("vec_id").agg(
        F.min_by("node", "vector").alias("node")).select(F.col("vec_id").alias("query_id"), "node")
    asked = kept(asked, "asked")
    queries = graph.nodes.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("query"), "*")
    found = search(graph, kept(queries, "queries"), width)
    nodes_first = Window.partitionBy("query").orderBy("score")
    found = found.withColumn("place", F.rank().over(nodes_first)).where(F.col("place") <= k + own).drop("place")
    of_node = Window.partitionBy("query").orderBy("score", "vec_id")
    candidates = found.join(members, "node").withColumn("place", F.row_number().over(of_node)).where(F.col("place") <= k + own)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id", "copy")
    return (
        asked.join(candidates.select(F.col("query").alias("node"), "vec_id", "score", "copies"), "node").where("vec_id <> query_id")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
