import pytest
from pyspark.sql import functions as F

from harrow.operators import dom
from harrow.operators import profile as P
from harrow.operators.dom import find_first, step
from harrow.plans.crawl import detect_rules


def parsed(spark, *htmls):
    rows = [(i, f"https://s{i}.com/x", h) for i, h in enumerate(htmls)]
    return dom.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))


def candidate(spark, html, fn):
    return tuple(parsed(spark, html).select(fn(F.col("nodes")).alias("c")).collect()[0]["c"])


@pytest.mark.parametrize("html, want", [
    ("Powered by Discuz! X", "discuz"), ("phpBB Group", "phpbb"), ("vBulletin 4", "vbulletin"), ("<p>x</p>", "custom"),
    ("phpbb and DISCUZ", "discuz"),
])
def test_forum_type(spark, html, want):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(P.forum_type(F.col("h"))).collect()[0][0] == want


def lists(system):
    return lambda nodes: P.list_candidate(nodes, F.lit(system))


def test_known_list_rules(spark):
    html = "<table>" + "".join(f'<tbody id="{i}"></tbody>' for i in ("stickthread_44", "normalthread_810", "normalthread_811")) + "</table>"
    assert candidate(spark, html, lists("discuz")) == ("tbody[id^='normalthread'], tbody[id^='stickthread']", 3 / 20)
    assert candidate(spark, '<li class="row a"></li>' * 3, lists("phpbb")) == ("li.row", 3 / 20)
    assert candidate(spark, "<p></p>", lists("discuz")) == ("", 0.0)


def test_list_by_word(spark):
    items = '<div class="ThreadItem big">some text</div>' * 12
    assert candidate(spark, items, lists("custom")) == ("div.ThreadItem", 0.9)
    by_id = "".join(f'<tr id="topic-{i}">t</tr>' for i in range(6))
    assert candidate(spark, by_id, lists("custom")) == ("tr[id^='topic-']", 0.7)
    uneven = '<div class="topic">x</div>' + f'<div class="topic">{"y" * 500}</div>' * 9
    assert candidate(spark, uneven, lists("custom")) == ("div.topic", 0.5)
    assert candidate(spark, '<div class="thread"></div>' * 4, lists("custom")) == ("", 0.0)


def test_list_by_repetition(spark):
    html = '<p class="a b">x</p>' * 6 + '<p class="c">x</p>' * 15 + '<i class="d">x</i>' * 60
    assert candidate(spark, html, lists("custom")) == ("p.c", 0.75)


def test_page_patterns(spark):
    html = '<i class="z"></i>' * 6 + '<b class="y"></b>' * 6 + '<b class="y x"></b>' * 7 + "<u class='w'></u>" * 4
    got = parsed(spark, html).select(P.page_patterns(F.col("nodes")).alias("p")).collect()[0]["p"]
    assert [tuple(r) for r in got] == [("b", ["y", "x"], 7), ("i", ["z"], 6), ("b", ["y"], 6)]
    many = "".join(f'<i class="c{k}"></i>' * 5 for k in range(14))
    got = parsed(spark, many).select(P.page_patterns(F.col("nodes")).alias("p")).collect()[0]["p"]
    assert [r.classes[0] for r in got] == [f"c{k}" for k in range(10)]
    by_unit = P.top_patterns(P.pattern_counts(parsed(spark, many), "page_id"), "page_id").orderBy("place").collect()
    assert [r.classes[0] for r in by_unit] == [f"c{k}" for k in range(10)]


def links(selector):
    return lambda nodes: P.link_candidate(nodes, F.lit(selector))


@pytest.mark.parametrize("html, selector, want", [
    ('<li class="row"><a href="/user/1">u</a><a class="s xst" href="/thread-1">t</a></li>', "li.row", ("a.s.xst", 0.9)),
    ('<li class="row"><a href="/thread-1">t</a></li>', "li.row", (".row a", 0.9)),
    ('<li><a class="x" href="/a">long text</a><a class="y" href="/b">short</a></li>', "li", ("a.x", 0.6)),
    ('<li><a class="x" href="/a">same</a><a class="y" href="/b">size</a></li>', "li", ("a.x", 0.6)),
    ("<li><a>none</a></li>", "li", ("a", 0.3)),
    ("<p></p>", "li", ("", 0.0)),
    ('<div class="top"><p><a href="/topic/1">x</a></p></div>', "", ("a", 0.9)),
    ('<html class="k"><p><a href="/topic/1">x</a></p></html>', "", (".k a", 0.9)),
])
def test_link_candidate(spark, html, selector, want):
    assert candidate(spark, html, links(selector)) == want


@pytest.mark.parametrize("html, want", [
    ('<div class="content"><img class="post-image" src="1.jpg"><img class="post-image" src="2.jpg"></div>', ("div.content img", 0.4)),
    ('<img class="a b" src="1.jpg">' * 9 + '<img class="b" src="2">', ("img.b", 1.0)),
    ('<img class="avatar-x" src="avatar.png">', ("img[src]", 0.5)),
    ('<img src="photo">', ("img", 0.3)),
    ('<img file="x">', ("img[file]", 0.2)),
    ("<p></p>", ("img", 0.3)),
])
def test_image_candidate(spark, html, want):
    assert candidate(spark, html, P.image_candidate) == want


@pytest.mark.parametrize("html, want", [
    ('<a href="?page=2" class="next">下一页</a>', ("a.next", 0.9)),
    ('<a href="?p=1">1</a><a href="?p=2">Next page</a>', ("a", 0.9)),
    ('<a rel="next" href="?p=2">2</a>', ("a[rel='next']", 0.8)),
    ('<li class="next"><a href="?p=2">2</a></li>', ("li.next a", 0.8)),
    ("<a>next</a>", ("", 0.0)),
])
def test_next_candidate(spark, html, want):
    assert candidate(spark, html, P.next_candidate) == want


@pytest.mark.parametrize("img, want", [
    ('<img src="photo.jpg" width="500" height="300">', True), ('<img src="Avatar.jpg">', False),
    ('<img src="icon.jpg" width="50">', False), ('<img src="x.jpg" width="50" height="50">', False),
    ('<img src="x.jpg" width="auto" height="50">', True), ('<img src="x.jpg" height="50">', False),
    ('<img width="500">', True), ('<img src="x.jpg" width="500" height="tall">', True),
])
def test_content_image(spark, img, want):
    df = parsed(spark, img)
    assert df.select(P.is_content_image(find_first(F.col("nodes"), [[step("img")]]))).collect()[0][0] is want


def test_best_candidate_keeps_first(spark):
    c = F.array(P.candidate("a", 0.5), F.lit(None).cast(P.CANDIDATE), P.candidate("b", 0.7), P.candidate("c", 0.7))
    assert spark.range(1).select(P.best_candidate(c, P.candidate("", 0.0)).alias("c")).collect()[0]["c"].selector == "b"


GOOD = "Discuz" + "".join(
    f'<tbody id="normalthread_{i}"><tr><td><a class="xst" href="thread-{i}">t</a></td></tr></tbody>' for i in range(20)
) + '<div class="message">' + '<img src="a.jpg">' * 5 + '</div><a class="nxt" href="?2">下一页</a>'


def test_whole_profile(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.com/1", GOOD), (2, "https://a.com/2", GOOD), (3, "https://a.com/3", "<p>x</p>"), (4, "https://b.com/", "<p></p>")],
        "page_id long, url string, html string",
    )
    typed = pages.withColumn("site", F.regexp_extract("url", "//([^/]+)", 1)).withColumn("forum_type", P.forum_type(F.col("html")))
    profiles = P.page_profiles(dom.parse_pages(typed), "site", "page_id")
    first = profiles.where("page_id = 1").collect()[0]
    assert (first.status, first.forum_type, first.thread_link.selector) == ("success", "discuz", "a.xst")
    assert first.overall == pytest.approx((1 + 0.9 + 1 + 0.9) / 4)
    sites = {r.site: r for r in P.site_profiles(profiles).collect()}
    assert (sites["a.com"].forum_type, sites["a.com"].n_pages, sites["a.com"].status) == ("discuz", 3, "success")
    assert (sites["b.com"].forum_type, sites["b.com"].status) == ("custom", "uncertain")
    rules = {r.site: r for r in detect_rules(pages).collect()}
    assert rules["a.com"].name == "Auto-discuz" and rules["a.com"].next_page_selector == "a.nxt"


def test_common_image_class(spark):
    df = parsed(spark, '<img class="x y" src="a"><img class="y" src="b"><img class="z" src="logo">')
    assert df.select(P.common_image_class(F.col("nodes"))).collect()[0][0] == "y"
    assert [tuple(r) for r in P.image_class_counts(df, "url").collect()] == [("https://s0.com/x", "y", 2)]
