"""Exact top-k by inner product with dual cover trees.

Queries and data are indexed together: a bounded sample gives pivots, every row
belongs to the cell of its nearest pivot, and a cell is cut into nodes of
bounded size. Within a node a cover tree is built by farthest-first traversal:
the centres of a level are at least its covering radius apart, every vector is
within the radius of a centre, and a node's own centre is its first child's.

For two nodes with centres q, r and radii s, t no inner product exceeds
q.r + s|r| + t|q| + st. A first round searches each query group in the nodes of
its own cell, which gives its worst kth score; a second round searches the
other nodes that may still beat it, with that score to begin from. Within a pair of nodes the two trees are
descended together with the same bound. Scores are integers and exact.

A cell, however many equal vectors it holds, is cut by a hash of the row, so a
task holds one node of data and one group of queries. Pairs are made of nodes
and groups, never of rows.

Defined results: rows with a NULL id, a NULL vector, or a NULL or non-finite
component take no part; a query meets all rows with another id and with as many
components as its own; repeated rows are candidates each, and repeated queries are one; ties go to the
smaller id; other columns are not read; an empty table gives no row.
Components and scores beyond 64 bits are cut to the largest 64-bit integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import arrow_map, kept

SAMPLE = 4096
MAX_PIVOTS = 256
NODE_ROWS = 4096
LEAF = 48
CHILDREN = 16
SHRINK = 0.75
LARGEST = (1 << 63) - 1


# --- trees --------------------------------------------------------------

@dataclass
class Node:
    """A set of vectors around one of them."""

    rows: np.ndarray
    centre: np.ndarray
    norm: float
    radius: float
    children: list[Node] = field(default_factory=list)


def farthest_first(points: np.ndarray, most: int, radius: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (the first point first), each point's centre and distance; stops at ``radius``."""
    centres, of = [0], np.zeros(len(points), np.int64)
    away = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(centres) < most:
        far = int(np.argmax(away))
        if away[far] <= radius:
            break
        new = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        closer = new < away
        of[closer] = len(centres)
        away = np.where(closer, new, away)
        centres.append(far)
    return np.array(centres), of, away


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, centre: int = 0) -> Node:
    """Tree over the rows of ``points`` (float64); ``centre`` is the place of the root's in ``rows``."""
    rows = np.arange(len(points)) if rows is None else rows
    if centre:
        rows = np.concatenate(([rows[centre]], np.delete(rows, centre)))
    own = points[rows]
    away = np.sqrt(((own - own[0]) ** 2).sum(axis=1))
    # A little more than computed, for the rounding.
    node = Node(rows, own[0], float(np.linalg.norm(own[0])) * (1 + 1e-12), float(away.max()) * (1 + 1e-9))
    if len(rows) > LEAF and node.radius > 0:
        centres, of, _ = farthest_first(own, CHILDREN, node.radius * SHRINK ** 2)
        for k, c in enumerate(centres):
            members = np.flatnonzero(of == k)
            node.children.append(cover_tree(points, rows[members], int(np.searchsorted(members, c))))
    return node


@dataclass
class Vectors:
    """Integer vectors with their ids."""

    ids: np.ndarray
    exact: np.ndarray  # float64 if every score is below 2**53, else Python integers
    points: np.ndarray  # float64

    @classmethod
    def of(cls, ids: np.ndarray, ints: np.ndarray, bound: float) -> Vectors:
        points = ints.astype(np.float64)
        return cls(ids, points if bound < 2.0 ** 53 else ints.astype(object), points)


def search(queries: Vectors, data: Vectors, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, data number, score) of the k best of every query, other ids only.

    ``least``: scores below it are not wanted, where better ones are known.
    """
    best: list[list[tuple]] = [[] for _ in queries.ids]  # (-score, id, number), in order
    worst = np.full(len(queries.ids), -np.inf) if least is None else least.copy()

    def bound(q: Node, r: Node) -> float:
        top = float(q.centre @ r.centre) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
        return top + 1e-9 * (q.norm + q.radius) * (r.norm + r.radius) + 1e-6

    def leaves(q: Node, r: Node) -> None:
        scores = queries.exact[q.rows] @ data.exact[r.rows].T
        ids = data.ids[r.rows]
        may = (scores >= worst[q.rows][:, None]) & (ids[None, :] != queries.ids[q.rows][:, None])
        for i in np.flatnonzero(may.any(axis=1)):
            row, at = q.rows[i], np.flatnonzero(may[i])
            if len(at) > k and scores.dtype != object:
                at = at[np.lexsort((ids[at], -scores[i, at]))[:k]]
            own = best[row] + [(-int(scores[i, j]), int(ids[j]), int(r.rows[j])) for j in at]
            own.sort()
            best[row] = own[:k]
            if len(own) >= k:
                worst[row] = max(worst[row], float(-best[row][-1][0]))

    def descend(q: Node, r: Node) -> None:
        if bound(q, r) < worst[q.rows].min():
            return
        if not q.children and not r.children:
            leaves(q, r)
        elif r.children and (not q.children or r.radius >= q.radius):
            for child in sorted(r.children, key=lambda c: -bound(q, c)):
                descend(q, child)
        else:
            for child in q.children:
                descend(child, r)

    if len(queries.ids) and len(data.ids):
        descend(cover_tree(queries.points), cover_tree(data.points))
    flat = [(i, j, -s) for i, own in enumerate(best) for s, _, j in own]
    q, d, s = zip(*flat, strict=True) if flat else ((), (), ())
    return np.array(q, np.int64), np.array(d, np.int64), np.array([min(LARGEST, max(-LARGEST - 1, x)) for x in s], np.int64)


# --- tables -------------------------------------------------------------

def _matrix(column: pd.Series, size: int) -> np.ndarray:
    """Rows of little-endian integers."""
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), size).astype(np.int64)


def _bound(*matrices: np.ndarray) -> float:
    """More than any score between the rows."""
    sizes = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in matrices]
    return math.prod(sizes) * max(1, matrices[0].shape[1])


def _assigned(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, packed, size, query, cell, away): integers as bytes, nearest pivot of that size and the distance to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            flat = batch.column("ints").flatten().to_numpy().astype("<i8")
            starts = np.cumsum(sizes) - sizes
            view = memoryview(np.ascontiguousarray(flat)).cast("B") if len(flat) else b""
            packed = [bytes(view[8 * a: 8 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            cell, away = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes):
                centres = shared.value.get(int(size))
                if centres is None:
                    centres = np.zeros((1, int(size)))
                at = np.flatnonzero(sizes == size)
                for some in np.array_split(at, -(-len(at) // 1024)):
                    own = flat[(starts[some][:, None] + np.arange(size)).reshape(-1)].reshape(len(some), int(size)).astype(np.float64)
                    squares = np.stack([((own - c) ** 2).sum(axis=1) for c in centres], axis=1)
                    cell[some] = squares.argmin(axis=1)
                    away[some] = np.sqrt(squares.min(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(packed, pa.binary()), batch.column("size"), batch.column("query"), pa.array(cell), pa.array(away)],
                ["vec_id", "packed", "size", "query", "cell", "away"])

    return arrow_map(vectors, assign, "vec_id long, packed binary, size int, query boolean, cell int, away double")


def _pivots(vectors: DataFrame, rows: int, node_rows: int) -> dict[int, np.ndarray]:
    """Pivots for each number of components, from at most SAMPLE rows chosen by a hash."""
    n = min(MAX_PIVOTS, max(1, rows // node_rows))
    sample = vectors.select("size", "ints").orderBy(F.xxhash64("vec_id", "ints"), "vec_id").limit(SAMPLE).collect()
    found = {}
    for size in {r[0] for r in sample}:
        own = [r[1] for r in sample if r[0] == size]
        own = np.array(own, np.float64).reshape(len(own), size)
        found[size] = own[farthest_first(own, n)[0]]
    return found


RESULT = "query_id long, vec_id long, score long"


def _searched(pairs: DataFrame, data: DataFrame, queries: DataFrame, k: int, blocks: int) -> DataFrame:
    """The k best of every query of each pair (qnode, dnode) within that pair.

    Query groups come in ``blocks`` blocks, so a node's rows are sent once for each block.
    """
    block = F.pmod(F.xxhash64("qnode"), F.lit(blocks)).cast("int")
    left = data.select("dnode", "vec_id", "packed").join(pairs.select("dnode", block.alias("block")).distinct(), "dnode")
    right = queries.select("qnode", F.col("vec_id").alias("q_id"), F.col("packed").alias("q_packed"), F.col("size").alias("q_size"), "kth").join(
        pairs.select("qnode", F.col("dnode").alias("q_dnode"), block.alias("q_block")), "qnode")

    def both(data_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(data_rows) or not len(query_rows):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in RESULT.split(", ")})
        size = int(query_rows["q_size"].iloc[0])
        d, q = _matrix(data_rows["packed"], size), _matrix(query_rows["q_packed"], size)
        bound = _bound(d, q)
        own = Vectors.of(query_rows["q_id"].to_numpy(), q, bound)
        others = Vectors.of(data_rows["vec_id"].to_numpy(), d, bound)
        i, j, score = search(own, others, k, query_rows["kth"].to_numpy(np.float64, na_value=-np.inf))
        return pd.DataFrame({"query_id": own.ids[i], "vec_id": others.ids[j], "score": score})

    return left.groupBy("block", "dnode").cogroup(right.groupBy("q_block", "q_dnode")).applyInPandas(both, RESULT)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; Spark keeps them per task before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding",
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of every query.

    ``is_query`` tells the queries by the id. Components become floor(scale * x).
    """
    v = F.col(vector).cast("array<double>")
    whole = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(whole).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)).alias("ints"), F.size(v).alias("size"), is_query.alias("query"))
    n_rows = rows.count()
    pivots = _pivots(rows, n_rows, node_rows)
    assigned = kept(_assigned(rows, pivots), "cells")
    # Cells are cut into nodes of about node_rows rows, by a hash.
    sizes = assigned.groupBy("size", "cell").agg(
        F.count("*").alias("n"), F.count_if("query").alias("n_queries"))
    cut = assigned.join(F.broadcast(sizes), ["size", "cell"])  # MAX_PIVOTS rows for each number of components

    def node(total: str) -> Column:
        parts = F.ceil(F.col(total) / node_rows)
        return F.concat_ws("/", "size", "cell", F.pmod(F.xxhash64("vec_id", "packed"), F.greatest(parts, F.lit(1))))

    placed = kept(cut.select("vec_id", "packed", "size", "cell", "away", "query", node("n").alias("dnode"), node("n_queries").alias("qnode")), "vectors")
    queries = placed.where("query").dropDuplicates(["vec_id", "packed"]).withColumn("kth", F.lit(None).cast("double"))
    blocks = max(1, -(-placed.where("query").count() // node_rows))
    ball = [F.max("away").alias("radius")]
    nodes = placed.groupBy("size", "cell", "dnode").agg(*ball)
    groups = queries.groupBy("size", "cell", "qnode").agg(*ball)
    home = kept(groups.join(nodes, ["size", "cell"]).select("qnode", "dnode"), "pairs")
    first = kept(_best(_searched(home, placed, queries, k, blocks), k), "first-round")

    # A little less than the score, for the rounding of large ones.
    score = F.col("score").cast("double")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (score - 1e-15 * F.abs(score)).alias("kth"))
    known = queries.drop("kth").join(kth, "vec_id", "left")
    worst = known.groupBy("qnode").agg(F.min(F.coalesce(F.col("kth"), F.lit(float("-inf")))).alias("worst"))
    far = _far_pairs(groups.join(worst, "qnode"), nodes, pivots)
    second = _searched(kept(far, "pairs"), placed, known, k, blocks)
    return _best(first.select("query_id", "vec_id", "score").unionByName(second), k)


def _far_pairs(groups: DataFrame, nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Pairs of different cells whose bound reaches the worst kth score of the query group.

    One row for each group and node is looked at: the stated queries, in
    blocks, against all rows, in blocks. The pivots' products are MAX_PIVOTS
    squared rows for each number of components.
    """
    products = [
        (size, i, j, float(a @ b), float(np.linalg.norm(a)), float(np.linalg.norm(b)))
        for size, centres in pivots.items() for i, a in enumerate(centres) for j, b in enumerate(centres) if i != j
    ]
    known = groups.sparkSession.createDataFrame(products, "size int, qcell int, dcell int, product double, qnorm double, dnorm double")
    q = groups.select("qnode", "size", F.col("cell").alias("qcell"), F.col("radius").alias("qradius"), "worst")
    d = nodes.select("dnode", "size", F.col("cell").alias("dcell"), F.col("radius").alias("dradius"))
    top = F.expr("product + qradius * dnorm + dradius * qnorm + qradius * dradius + 1e-9 * (qnorm + qradius) * (dnorm + dradius) + 1e-6")
    return q.join(known, ["size", "qcell"]).join(d, ["size", "dcell"]).where(top >= F.col("worst")).select("qnode", "dnode")
