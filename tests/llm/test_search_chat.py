"""Top-k search and the chat tree against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from data import FOLDER, rows
from pyspark.sql import functions as F

from harrow.llm import chat_tree, cover_tree


def ranked(vectors, is_query, k):
    ints = [(i, [math.floor(1024 * float(np.float64(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in dict.fromkeys(i for i, _ in ints if is_query(i)):
        own = [v for i, v in ints if i == q]
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for w in own[:1] for i, v in ints if i != q and len(v) == len(w))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("node_rows", [16, 4096])
def test_top_k(spark, node_rows):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((5, 8)) * 3
    vectors = [(i, [float(x) for x in np.float32(centres[i % 5] + 0.1 * rng.standard_normal(8))]) for i in range(400)]
    vectors += [(500 + i, vectors[7][1]) for i in range(90)]  # one vector many times
    vectors += [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8), (910, [2.0, 1.0]),
                (920, [1.0, 1.0]), (930, []), (940, []), (77, vectors[77][1]), (950, [1e30] * 8), (960, [-1e30] * 8)]
    vectors = [v for v in vectors if v[0] not in (950, 960)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)
    got = cover_tree.top_k(df, F.col("vec_id") % 10 == 0, k=7, node_rows=node_rows)
    assert rows(got) == ranked(vectors, lambda i: i % 10 == 0, 7)
    assert rows(cover_tree.top_k(df.limit(0), F.col("vec_id") % 10 == 0)) == []


def test_scores_beyond_double_precision(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rng.integers(-2**19, 2**19, 6)]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert rows(cover_tree.top_k(df, F.col("vec_id") < 5, k=4, node_rows=20)) == ranked(vectors, lambda i: i < 5, 4)


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.standard_normal((700, 4)), np.zeros((60, 4)), 50 + rng.standard_normal((90, 4))])
    seen = []

    def walk(node):
        away = np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1))
        assert away.max() <= node.radius and np.array_equal(points[node.rows[0]], node.centre)
        if not node.children:
            seen.extend(node.rows)
            return
        assert np.array_equal(node.children[0].centre, node.centre)
        centres = np.stack([c.centre for c in node.children])
        gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
        assert gaps.min() >= max(c.radius for c in node.children) * (1 - 1e-6)
        for c in node.children:
            walk(c)

    walk(cover_tree.cover_tree(points))
    assert sorted(seen) == list(range(len(points)))


BOTH = "</s>[INST] ok [/INST]"
CHATS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello \\ </s> <s>"), (1, 3, "user", "more\n"),
    (2, 0, "system", "Be kind."), (2, 1, "user", "Hi"), (2, 2, "assistant", "Hello there"), (3, 0, "system", "Be kind."), (3, 1, "user", "Bye"),
    (4, 0, "system", "Be kind."), (4, 1, "user", "Hi"), (4, 2, "assistant", "Hello \\ </s> <s>"), (4, 3, "user", "more\n"), (4, 4, "assistant", "long " * 900),
    (5, 0, "tool[/ROLE]", BOTH), (5, 1, None, None), (5, 2, "assistant", None), (5, 2, "assistant", "é\U0001f600"), (5, 2, "assistant", "é\U0001f600"),
    (None, 0, "user", "no id"), (None, None, "assistant", "first"), (-1, 0, "user", BOTH), (-1, 1, "assistant", BOTH), (6, 0, "assistant", "\\"), (7, 0, "user", "<\\/s>[\\INST]"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def told(chats):
    """(role, text) of each conversation in order."""
    out = {}
    for c, turn, role, text in chats:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in out.items()}


@pytest.mark.parametrize("chunk", [7, 1024])
def test_conversations_come_back(spark, chunk):
    df = spark.createDataFrame(CHATS, SCHEMA).withColumn("node", F.lit("clash")).repartition(3)
    tree = chat_tree.build(df, chunk)
    read = {r.conv_id: r for r in chat_tree.read_conversations(tree, chunk).collect()}
    want = told(CHATS)
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in read.items()} == want
    assert {c: r.learned for c, r in read.items()} == {c: "".join(t for r, t in x if r == "assistant") for c, x in want.items()}
    for c, r in read.items():
        assert r.formatted.count("</s>") == r.formatted.count("<s>") == len(want[c])


def test_shared_turns_are_written_once_depth_first(spark):
    tree = chat_tree.build(spark.createDataFrame(CHATS, SCHEMA))
    nodes = sorted(tree.nodes.collect(), key=lambda n: n.offset)
    prefixes = {tuple(x[: k + 1]) for x in told(CHATS).values() for k in range(len(x))}
    assert len(nodes) == len(prefixes)
    by_id = {n.node: n for n in nodes}
    at, stack = 0, []
    for n in nodes:
        assert n.offset == at
        at += n.length
        while stack and stack[-1].node != n.parent:
            stack.pop()
        assert bool(stack) == (n.depth > 0)  # depth first: the parent is still open
        assert n.position == sum(x.length for x in stack)
        covered = [p for i in n.ancestors for p in range(i.start, i.end)]
        assert covered == [p for x in stack for p in range(x.offset, x.offset + x.length)]
        assert all(a.end < b.start for a, b in zip(n.ancestors, n.ancestors[1:]))
        stack.append(by_id[n.node])
    assert sum(len(r.text) for r in tree.stream.collect()) == at


def test_empty_conversations(spark):
    tree = chat_tree.build(spark.createDataFrame([], SCHEMA))
    assert rows(tree.nodes) == rows(tree.stream) == rows(tree.conversations) == rows(chat_tree.read_conversations(tree)) == []


def test_digests(spark):
    from harrow.llm import queries

    own = {r.conv_id: r for r in queries.op3_chat_tree(spark, FOLDER).collect()}[-1]
    assert own.turns_sha256 == hashlib.sha256(f"user\n{BOTH}\nassistant\n{BOTH}\n".encode()).hexdigest()
    assert own.loss_sha256 == hashlib.sha256(BOTH.encode()).hexdigest() and own.loss_chars == len(BOTH)
