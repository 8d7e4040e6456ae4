"""Nearest outer elements against all pairs."""

from __future__ import annotations

import random
import time

from harrow.operators import dom
from harrow.operators.dom import step
from harrow.operators.extract import one

OUTER = [[step("div")], [step("ul")]]


def parsed(spark, pages):
    return dom.parse_pages(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def test_random_nesting(spark):
    rng = random.Random(5)
    pages = ["".join(rng.choice(["<div>", "</div>", "<ul>", "</ul>", "<a href=x>", "</a>", "<p>", "<b>t</b>"]) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, ""]
    df = parsed(spark, pages)
    for inner in (one("a"), [[step("div")]], [[step("a")], [step("ul")]]):
        pairs = {}
        for r in dom.inside_pairs(df, OUTER, inner, "page_id").collect():
            pairs.setdefault((r.page_id, r.inner_lo), []).append(r.outer_lo)
        rows = dom.nearest_outer(df, OUTER, inner, "page_id").collect()
        elements = {(r.page_id, n.lo) for r in df.collect() for n in (r.nodes or []) if n.attrs is not None and n.tag in {s[0]["tag"] for s in inner}}
        assert {(r.page_id, r.inner_lo) for r in rows} == elements and len(rows) == len(elements)
        for r in rows:
            around = pairs.get((r.page_id, r.inner_lo), [])
            assert r.depth == len(around) and r.outer_lo == (max(around) if around else None)


def test_all_outer_elements_by_their_chain(spark):
    row = dom.enclosing(parsed(spark, ["<div><ul><div><a href=1></a></div></ul><a></a></div><a></a>"]), OUTER, one("a"), "page_id").first()
    assert [(o.tag, o.around, o.depth) for o in row.outers] == [("div", None, 0), ("ul", 0, 1), ("div", 1, 2)]
    assert [(i.around, i.depth) for i in row.inners] == [(2, 3), (0, 1), (None, 0)]
    none = dom.enclosing(parsed(spark, [None]), OUTER, one("a"), "page_id").first()
    assert none.outers is None and none.inners is None


def test_deep_nesting_is_linear(spark):
    def seconds(n):
        df = parsed(spark, ["<div>" * n + "<a></a>" * n + "</div>" * n]).cache()
        df.count()
        start = time.perf_counter()
        rows = dom.enclosing(df, [[step("div")]], one("a"), "page_id").selectExpr("size(outers) o", "inners[0].depth d").first()
        assert tuple(rows) == (n, n)
        return time.perf_counter() - start

    seconds(200)
    assert seconds(16_000) < 12 * max(0.5, seconds(4_000))
