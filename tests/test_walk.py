"""Board walks against a loop that follows one link after the other."""

from __future__ import annotations

import random

import pytest
from harrow.operators import state
from harrow.operators.walk import board_walk, follow, single_links, walk_checkpoints

PAGES = "page_id long, url string, fetched boolean, next_url string"
TARGETS = "site string, board string, url string"


def points(spark, rows=()):
    full = [(*r[:2], r[2], None, None, r[3], {}, None, None, None, None, None) for r in rows]
    return spark.createDataFrame(full, state.CHECKPOINTS)


def plain(targets, pages, checkpoints, start_page=None, max_pages=None):
    """Pages and end of every board, one step at a time."""
    links = {}
    for _, url, fetched, nxt in sorted(pages, key=lambda p: (not p[2], p[0])):
        links.setdefault(url, (fetched, nxt))
    stored = {(s, b): (page, status) for s, b, page, status in checkpoints}
    walked, ends = [], []
    for site, board, url in targets:
        point = stored.get((site, board)) if start_page is None else None
        if point and point[1] == "completed":
            continue
        first = point[0] if point else start_page or 1
        last = None if max_pages is None else max_pages if point else first + max_pages - 1
        seen, n, end = {}, 0, None
        while end is None:
            n += 1
            seen[url] = n
            fetched, nxt = links.get(url, (False, None))
            walked.append((site, board, n, url, fetched, "skip" if n < first else "crawl"))
            if not fetched:
                end = ("fetch_failed", None, "error", n)
            elif nxt is None:
                end = ("no_next_page", None, "completed", n + 1)
            elif last is not None and n >= last:
                end = ("max_pages", None, "completed", n + 1)
            elif nxt in seen:
                end = ("cycle", seen[nxt], "completed", n + 1)
            url = nxt
        ends.append((site, board, "resume" if point else "start", first, n, *end))
    return sorted(walked), sorted(ends, key=repr)


def walked(spark, targets, pages, checkpoints=(), **how):
    out = board_walk(
        spark.createDataFrame(targets, TARGETS), spark.createDataFrame(pages, PAGES), points(spark, checkpoints), **how)
    return sorted(tuple(r) for r in out["pages"].collect()), sorted((tuple(r) for r in out["ends"].collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_links_as_followed_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = [f"u{i}" for i in range(60)]
    pages = [(i, u, rng.random() > 0.1, rng.choice([None, "gone", *names])) for i, u in enumerate(names)]
    pages += [(100 + i, rng.choice(names), True, rng.choice(names)) for i in range(10)]
    targets = [(f"s{i % 3}", f"b{i}", rng.choice([*names, "gone"])) for i in range(25)]
    stored = [("s0", "b0", 3, "running"), ("s1", "b1", 1, "error"), ("s2", "b2", 2, "completed"), ("s0", "b3", 90, "running"), ("x", "b4", 2, "running")]
    for how in ({}, {"max_pages": 4}, {"start_page": 3}, {"start_page": 2, "max_pages": 3}, {"max_pages": 1}):
        assert walked(spark, targets, pages, stored, **how) == plain(targets, pages, stored, **how)


def test_long_chain_and_long_cycle(spark):
    n = 10_000
    order = list(range(n))
    random.Random(4).shuffle(order)
    chain = [(i, f"c{i}", True, f"c{i + 1}" if i < n - 1 else None) for i in order]
    ring = [(n + i, f"r{i}", True, f"r{(i + 1) % 3000}") for i in range(3000)]
    pages, ends = walked(spark, [("s", "chain", "c0"), ("s", "ring", "r1000")], chain + ring)
    assert [(p[1], p[2], p[3]) for p in pages] == [("chain", i + 1, f"c{i}") for i in range(n)] + [("ring", i + 1, f"r{(1000 + i) % 3000}") for i in range(3000)]
    assert [e[1:2] + e[4:7] for e in ends] == [("chain", n, "no_next_page", None), ("ring", 3000, "cycle", 1)]


def test_boards_may_share_pages_and_empty_input(spark):
    pages = [(1, "a", True, "c"), (2, "b", True, "c"), (3, "c", True, "d"), (4, "d", True, None), (5, None, True, "a"), (6, "e", None, "a")]
    pages = [(i, u, bool(f), x) for i, u, f, x in pages]
    targets = [("s", "one", "a"), ("s", "two", "b"), ("s", "none", None), ("s", "own", "d")]
    got, ends = walked(spark, targets[:2] + targets[3:], pages)
    assert (got, ends) == plain(targets[:2] + targets[3:], [p for p in pages if p[1]], [])
    assert walked(spark, [], pages) == ([], [])
    assert walked(spark, targets[:1], []) == ([("s", "one", 1, "a", False, "crawl")], [("s", "one", "start", 1, 1, "fetch_failed", None, "error", 1)])


def test_many_pages_with_one_next_page(spark):
    """A hub that nearly all pages link to is one key of every round's join."""
    pages = [(i, f"p{i}", True, "hub") for i in range(5000)] + [(9999, "hub", True, "end"), (10_000, "end", True, None)]
    links = single_links(spark.createDataFrame(pages, PAGES))
    starts = spark.createDataFrame([(i, f"p{i}") for i in range(5000)], "board long, url string")
    reached = follow(starts, links, ["board"])
    assert reached.groupBy("page").count().orderBy("page").collect() == [(1, 5000), (2, 5000), (3, 5000)]


def test_checkpoints_of_a_walk(spark):
    pages = spark.createDataFrame([(1, "a", True, "b"), (2, "b", True, "c"), (3, "c", True, "gone"), (4, "z", True, None)], PAGES)
    targets = spark.createDataFrame([("s", "one", "a"), ("s", "two", "z")], TARGETS)
    listed = spark.createDataFrame(
        [("s", "one", 2, 1, "t2", "/2"), ("s", "one", 2, 2, "t3", "/3")], "site string, board string, page long, pos int, thread_id string, thread_url string")
    walk = board_walk(targets, pages, points(spark, [("s", "one", 2, "running")]))
    rows = {r.board: r for r in walk_checkpoints(walk, listed).collect()}
    one, two = rows["one"], rows["two"]
    assert (one.current_page, one.last_thread_id, one.last_thread_url, one.status, one.last_error) == (4, "t3", "/3", "error", "fetch_failed")
    assert one.stats == {"pages": 2, "listed": 2}
    assert (two.current_page, two.last_thread_id, two.status, two.stats) == (2, None, "completed", {"pages": 1, "listed": 0})
