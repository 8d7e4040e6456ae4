"""Greedy search on the neighbour graph against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from harrow.llm import neighbour_graph as G
from pyspark.sql import functions as F

ROWS = "vec_id long, embedding array<double>, label string, node string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", "clash", "clash") for i, v in rows], ROWS)


def brute(rows, k=10, is_query=lambda i: i % 10 == 0):
    good = [(i, tuple(map(float, v))) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in good if is_query(i)}):
        own = min(v for i, v in good if i == q)
        away = sorted((math.dist(own, v), i) for i, v in good if i != q and len(v) == len(own))
        out += [(q, r, i, d) for r, (d, i) in enumerate(away[:k], 1)]
    return out


def found(df, **more):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in G.nearest(df, F.col("vec_id") % 10 == 0, **more).collect())


def assert_same(got, wanted):
    assert [r[:3] for r in got] == [r[:3] for r in wanted]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in wanted], rel=1e-12, abs=1e-300)


def test_awkward_vectors(spark):
    rows = [(0, [1, 0]), (10, [1, 0]), (3, [1, 0]), (3, [1, 0]), (3, [0, 2]), (20, [-0.0, 3]), (21, [0.0, 3]), (30, [5, 5, 5]), (31, [5, 5, 6]), (40, None),
            (50, []), (60, [0, 0]), (70, [None, 1]), (80, [float("nan"), 1]), (90, [float("inf"), 1]), (None, [1, 1]), (100, [7, 7, 7, 7]),
            (20, [1, 1]), (5, [1e-300, 0]), (6, [1e300, 1e300]), (7, [1.0, 1e-9])]
    assert_same(found(frame(spark, rows)), brute(rows))
    assert_same(found(frame(spark, rows), k=1), brute(rows, k=1))
    assert_same(found(frame(spark, rows), k=3), brute(rows, k=3))


def test_empty_table(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, [1.0]), (2, [2.0])])) == []


def test_copies_and_equal_distances(spark):
    ring = [(i, [round(math.cos(i % 12 * math.pi / 6), 6), round(math.sin(i % 12 * math.pi / 6), 6)]) for i in range(300)]
    rows = ring + [(1000 + i, [9.0, 9.0]) for i in range(600)]
    assert_same(found(frame(spark, rows)), brute(rows))


def recall(got, wanted):
    pairs = {r[:1] + r[2:3] for r in wanted}
    return len(pairs & {r[:1] + r[2:3] for r in got}) / len(pairs)


def test_recall_without_structure(spark):
    """Independent components are the hardest case: no vector is near another."""
    values = np.random.default_rng(5).normal(size=(4000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    wanted = [r for r in brute(rows, is_query=lambda i: i % 10 == 0 and i < 1000)]
    got = [r for r in found(frame(spark, rows), block=128) if r[0] < 1000]
    assert recall(got, wanted) >= 0.95
    exact = {(r[0], r[2]): r[3] for r in wanted}
    assert all(exact[(q, i)] == pytest.approx(d, rel=1e-12) for q, _, i, d in got if (q, i) in exact)


def test_descent_improves_the_trees(spark):
    values = np.random.default_rng(6).normal(size=(3000, 24))
    vectors = frame(spark, [(i, v.tolist()) for i, v in enumerate(values)])
    squares = ((values[:, None] - values[None]) ** 2).sum(axis=2)
    np.fill_diagonal(squares, np.inf)
    true = {tuple(values[i]): {tuple(values[j]) for j in np.argsort(squares[i])[:8]} for i in range(300)}

    def share(rounds):
        graph = G.build(G.usable(vectors, "vec_id", "embedding"), k=8, reverse=0, trees=2, block=64, rounds=rounds)
        vector = {r.node: tuple(r.vector) for r in graph.nodes.collect()}
        links = {vector[r.node]: {vector[x] for x in r.near} for r in graph.links.collect()}
        assert all(len(x) <= 8 for x in links.values())
        return sum(len(true[v] & links[v]) for v in true) / (8 * len(true))

    before, after = share(0), share(3)
    assert after > 1.5 * before


def test_queries_from_outside_the_graph(spark):
    values = np.random.default_rng(7).normal(size=(2000, 8))
    graph = G.build(G.usable(frame(spark, [(i, v.tolist()) for i, v in enumerate(values)]), "vec_id", "embedding"), block=128)
    asked = np.random.default_rng(8).normal(size=(40, 8))
    rows = spark.createDataFrame([(i, 8, v.tolist()) for i, v in enumerate(asked)], "node long, size int, vector array<double>")
    queries = G._coded(rows).select(F.col("node").alias("query"), F.lit(None).cast("long").alias("node"), "size", "vector", "code", "scale")
    near = {}
    for r in G.search(graph, queries).collect():
        near.setdefault(r.query, []).append(r.score)
    for i, v in enumerate(asked):
        wanted = np.sort(np.sqrt(((values - v) ** 2).sum(axis=1)))[:10]
        assert np.isclose(sorted(near[i])[:10], wanted).mean() >= 0.9
