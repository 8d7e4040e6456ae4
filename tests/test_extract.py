import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harrow.functions.selectors import selector_steps
from harrow.operators import dom
from harrow.operators import extract as E
from harrow.operators.dom import step

DISCUZ_LIST = "tbody[id^='normalthread'], tbody[id^='stickthread']"
DISCUZ_LINK = "a.s.xst, a.xst"
DISCUZ_IMAGES = "img.zoom,img[file],img[aid],div.pattl img,div.pcb img"


def parsed(spark, *htmls, url="https://bbs.example.com/"):
    rows = [(i, url, h) for i, h in enumerate(htmls)]
    return dom.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))


def by(text):
    return selector_steps(F.lit(text))


def one_value(df, column):
    return df.select(column.alias("v")).collect()[0]["v"]


LIST = """<table><tbody id="normalthread_6012"><tr><td><a href="/forum.php?mod=viewthread&tid=6012" class="xst"> Harbour <b>crane</b> sold </a></td></tr></tbody>
<tbody id="normalthread_90"><tr><td><i>pinned</i></td></tr></tbody>
<tbody id="stickthread_35"><tr><td><a href="forum.php?mod=viewthread&tid=35" class="xst">Tide tables, week 30</a></td></tr></tbody>
<tbody id="normalthread_91"><tr><td><a class="xst">anchor without address</a></td></tr></tbody></table>"""


def test_thread_list(spark):
    df = parsed(spark, LIST, "<html><body></body></html>", None)
    rows = E.thread_list(df, by(DISCUZ_LIST), by(DISCUZ_LINK), "page_id").orderBy("pos").collect()
    assert [(r.page_id, r.thread_id, r.title, r.thread_url) for r in rows] == [
        (0, "6012", "Harbourcranesold", "https://bbs.example.com/forum.php?mod=viewthread&tid=6012"),
        (0, "35", "Tide tables, week 30", "https://bbs.example.com/forum.php?mod=viewthread&tid=35"),
    ]


def test_fixed_and_column_rules_agree(spark):
    fixed = [[step("tbody", attrs=[("id", "^=", "normalthread")])], [step("tbody", attrs=[("id", "^=", "stickthread")])]]
    link = [[step("a", ["s", "xst"])], [step("a", "xst")]]
    df = parsed(spark, LIST)
    a = E.thread_list(df, fixed, link, "page_id").collect()
    b = E.thread_list(df, by(DISCUZ_LIST), by(DISCUZ_LINK), "page_id").collect()
    assert a == b and len(a) == 2


DETAIL = """<em class="replies">no. 8</em><span class="views">read 70,411 times</span><div class="author"> Okke V. </div>
<span class="post-time">3 March, 17:05</span><div class="post-content">Low water<!-- w --><br><p> until noon </p><script>tide(4);</script></div>
<div class="pcb"><img src="/grin"><img src="https://bbs.example.com/quay.jpg"/><img file="https://bbs.example.com/mast.png"/>
<img src="https://bbs.example.com/quay.jpg"><img data-src="/attachment/881"></div>"""


def test_thread_detail(spark):
    df = parsed(spark, DETAIL, url="https://bbs.example.com/forum.php?mod=viewthread&tid=6012")
    r = E.thread_detail(df, by(DISCUZ_IMAGES), "page_id").collect()[0]
    assert r.thread_id == "6012"
    assert r.images == ["https://bbs.example.com/quay.jpg", "https://bbs.example.com/attachment/881"] and r.image_count == 2
    assert r.metadata.asDict() == {"author": "Okke V.", "post_time": "3 March, 17:05", "views": 70411, "replies": 8}
    assert r.content == "Low water\nuntil noon"


def test_missing_metadata(spark):
    r = E.thread_detail(parsed(spark, "<p>x</p>", None), by(DISCUZ_IMAGES), "page_id").collect()
    assert len(r) == 1 and r[0].metadata.author is None and r[0].metadata.views is None and r[0].content == ""


def test_first_in_document_order_wins(spark):
    df = parsed(spark, '<i class="my-author-x">a</i><i class="author">b</i>')
    assert one_value(df, E.thread_metadata(F.col("nodes")))["author"] == "a"


def test_next_page(spark):
    html = '<div class="pg"><a href="forum.php?mod=forumdisplay&fid=7&page=15" class="nxt">onward</a></div>'
    df = parsed(spark, html, url="https://bbs.example.com/forum.php?fid=7")
    rule = by("a.nxt, div.pg a.nxt")
    assert one_value(df, E.next_page(F.col("nodes"), F.col("url"), rule)) == "https://bbs.example.com/forum.php?mod=forumdisplay&fid=7&page=15"
    assert one_value(parsed(spark, "<a>x</a>"), E.next_page(F.col("nodes"), F.col("url"), rule)) is None
    no_href = '<a class="nxt">1</a><a class="nxt" href="/2">2</a>'
    assert one_value(parsed(spark, no_href), E.next_page(F.col("nodes"), F.col("url"), rule)) is None


def test_descendant_rules(spark):
    html = '<div class="a"><p><b class="x">1</b></p></div><b class="x">2</b><div class="c"><div class="a"><b class="x">3</b></div></div>'
    df = parsed(spark, html)
    texts = lambda es: F.transform(es, lambda e: dom.text_of(F.col("nodes"), e))
    for rule, want in {
        "div.a b.x": ["1", "3"], ".c .a b": ["3"], "b.x, div.a b": ["1", "2", "3"], "[class^='x']": ["1", "2", "3"],
        "#none, .c b": ["3"], "": [],
    }.items():
        assert one_value(df, texts(dom.find_all_by(F.col("nodes"), by(rule)))) == want, rule
    fixed = dom.find_all(F.col("nodes"), [[step(cls="c"), step(cls="a"), step("b")], [step("p"), step("b")]])
    assert one_value(df, texts(fixed)) == ["1", "3"]


NEWS = """<div class="article"><span class="author">R. Tamm</span><h3 class="title"><a href="/news/5581">Ferry back in service</a></h3>
<div class="body">After nine days</div><span class="date">May 2024</span></div>
<div class="article"><h3 class="title">Storm damage</h3><a href="/roof.JPG">picture</a><a href="legend">map</a><a href="item/707">more</a></div>
<div class="article"><h3 class="title">Only a picture</h3><a href="/pier.png">see</a></div>
<div class="article"><span class="author">nobody</span><a href="/news/33">see</a></div>"""


def test_article_list(spark):
    df = parsed(spark, NEWS, url="https://news.com/")
    rows = E.article_list(df, "page_id", site_base=F.lit("https://news.com")).collect()
    assert [(r.article_id, r.title, r.author, r.date, r.summary, r.article_url) for r in rows[:1]] == [
        ("5581", "Ferry back in service", "R. Tamm", "May 2024", "After nine days", "https://news.com/news/5581")
    ]
    assert [(r.title, r.author, r.date, r.summary, r.article_url) for r in rows[1:]] == [
        ("Storm damage", "未知作者", None, "", "https://news.com/item/707")
    ]


def test_article_link_without_digits(spark):
    html = '<div class="article"><b class="title">T</b><a href="/a.png">x</a><a href="about">n</a></div>'
    rows = E.article_list(parsed(spark, html), "page_id", site_base=F.lit("https://n.com")).collect()
    assert [r.article_url for r in rows] == ["https://n.com/about"]


@pytest.mark.parametrize("html, want", [
    ('<a class="more" data-action="switch_page">x</a>', True),
    ("<span>查看更多</span>", True),
    ("<!-- Load MORE -->", True),
    ('<i data-action="reload">x</i>', True),
    ("<p>正文内容</p>", False),
])
def test_load_more(spark, html, want):
    assert one_value(parsed(spark, html), E.has_load_more(F.col("nodes"))) is want


@pytest.mark.parametrize("html, want", [('<a data-page="3">', 3), ("<a>", None), ('<a data-page="x"><b data-page="2">', None)])
def test_next_page_number(spark, html, want):
    assert one_value(parsed(spark, html), E.next_page_number(F.col("nodes"))) == want


def test_article_detail(spark):
    html = """<body><div class="content">wide</div><div class="article"><div class="body">Text <b>more</b>
    <a href="/img/1.jpg">i</a><a href="/img/1.jpg">again</a><a href="/x">n</a><img src="z.png"></div></div></body>"""
    r = E.article_detail(parsed(spark, html, url="https://n.com/news/5"), "page_id").collect()[0]
    assert (r.article_id, r.content, r.images) == ("5", "Textmoreiagainn", ["https://n.com/img/1.jpg"])


def test_article_detail_falls_back(spark):
    html = '<body>Only body<img src="buoy-64x48.jpg"><img data-src="l.jpg" src="s.jpg"></body>'
    r = E.article_detail(parsed(spark, html, "<p>none</p>", url="https://n.com/a/b"), "page_id").orderBy("page_id").collect()
    assert r[0].content == "Only body" and r[0].images == ["https://n.com/a/buoy.jpg", "https://n.com/a/l.jpg"]
    assert r[1].content == "" and r[1].images == []


@pytest.mark.parametrize("img, want", [
    ('<img srcset="dawn.jpg 240w, dusk.jpg 1100w" src="noon.jpg">', "dusk.jpg"),
    ('<img srcset="a.jpg 800w, b.jpg 800w">', "a.jpg"),
    ('<img srcset="a.jpg 2x, b.jpg" src="c.jpg">', "c.jpg"),
    ('<img srcset="a.jpg 0w" data-src="later.jpg">', "later.jpg"),
    ('<img data-src="later.jpg" src="noon.jpg">', "later.jpg"),
    ('<img src="buoy-64x48.jpg">', "buoy.jpg"),
    ("<img>", None),
])
def test_news_image(spark, img, want):
    df = parsed(spark, img)
    assert one_value(df, E.news_image_candidate(dom.find_first(F.col("nodes"), E.one("img")))) == want


@pytest.mark.parametrize("img, want", [
    ('<img src="a" data-src="b">', "a"), ('<img src="" data-src="b">', "b"),
    ('<img data-original="c" file="d">', "c"), ('<img file="d">', None),
])
def test_forum_image(spark, img, want):
    df = parsed(spark, img)
    assert one_value(df, E.forum_image_candidate(dom.find_first(F.col("nodes"), E.one("img")))) == want


def test_image_urls(spark):
    urls = F.array(F.lit("https://a.com/net.jpg"), F.lit("/oars/9.png"), F.lit("https://a.com/net.jpg"), F.lit(None))
    got = one_value(parsed(spark, "x"), E.distinct_urls(F.lit("https://base.com/"), urls))
    assert got == ["https://a.com/net.jpg", "https://base.com/oars/9.png"]


def test_tree(spark):
    """Unclosed and stray tags, void elements, raw text, character references."""
    html = "<div><p>a<p>b &amp; c</div></b><br/>x<script>if (a</b>) '</p>';</script><i/>y"
    rows = dom.elements(parsed(spark, html), "page_id").orderBy("lo").collect()
    assert [(r.tag, r.depth, r.hi, r.text) for r in rows] == [
        ("div", 0, 4, None), ("p", 1, 4, None), ("#text", 2, 2, "a"), ("p", 2, 4, None), ("#text", 3, 4, "b & c"),
        ("br", 0, 5, None), ("#text", 0, 6, "x"), ("script", 0, 8, None), ("#raw", 1, 8, "if (a</b>) '</p>';"),
        ("i", 0, 9, None), ("#text", 0, 10, "y"),
    ]


def test_implied_ends(spark):
    html = "<ul><li>a<li><p>b<li>c<ul><li>d</ul></ul><table><tr><td>1<td>2<tr><td>3</table>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    depth = {r.text: r.depth for r in dom.elements(dom.parse_pages(pages, implied_ends=True), "page_id").where("text IS NOT NULL").collect()}
    assert depth == {"a": 2, "b": 3, "c": 2, "d": 4, "1": 3, "2": 3, "3": 3}
    nested = {r.text: r.depth for r in dom.elements(dom.parse_pages(pages), "page_id").where("text IS NOT NULL").collect()}
    assert nested["b"] == 4 and nested["c"] == 5


def test_texts_apart(spark):
    html = "<p>a<ruby>b<rt>c<i>d</i></rt></ruby><template>e</template><style>f</style><![CDATA[g]]></p>"
    df = parsed(spark, html)
    assert one_value(df, E.first_text(F.col("nodes"), E.one("p"), separator="|")).startswith("a|b")
    assert one_value(df, E.first_text(F.col("nodes"), E.one("template"))) == "e"
    assert one_value(df, E.first_text(F.col("nodes"), E.one("i"))) == ""


def test_serialised_length(spark):
    html = '<div class="a b" id=x><br>t &lt; u<!--c--></div>'
    rows = dom.elements(parsed(spark, html), "page_id").orderBy("lo").collect()
    assert rows[0].length == len('<div class="a b" id="x"><br/>t &lt; u<!--c--></div>')
    assert rows[0].classes == ["a", "b"] and rows[0].attrs["id"] == "x"


def test_hostile_pages(spark):
    """Neither deep nesting nor broken markup stops or slows a task; other pages are not touched."""
    deep = "<b>" * 30000 + "x" + "</i>" * 30000
    rows = dom.parse_pages(
        spark.createDataFrame(
            [(1, "<p>a"), (2, "<![odd[ x"), (3, deep), (4, "<p>b</p><"), (5, "")], "page_id int, html string"
        ).coalesce(1)
    ).selectExpr("page_id", "size(nodes) n", "get(nodes, 0).tag tag").orderBy("page_id").collect()
    assert [(r.n, r.tag) for r in rows if r.page_id in (1, 3)] == [(2, "p"), (30001, "b")]
    assert rows[3].tag == "p" and rows[4].n == 0


def test_inside_pairs(spark):
    html = "<ul><li><a>1</a><a>2</a></li></ul><a>3</a><ul><li><ul><li><a>4</a></li></ul></li></ul>"
    pairs = dom.inside_pairs(parsed(spark, html), E.one("ul"), E.one("a"), "page_id")
    assert pairs.count() == 4


def test_slices():
    sizes = [3, 3, 0, 9, 1, 1]
    pages = pa.array([None if n == 0 else "x" * (n << 20) for n in sizes])
    assert list(dom._slices(pages)) == [(0, 1), (1, 2), (3, 1), (4, 2)]
    assert list(dom._slices(pages.slice(0, 0))) == []
    assert list(dom._slices(pa.array([None, None], pa.string()))) == [(0, 2)]


def test_many_pages_over_small_batches(spark):
    """Positions restart on every page, whatever the Arrow batches look like."""
    pages = spark.range(2000).selectExpr(
        "id page_id", "'http://a/' url", "CASE WHEN id % 7 = 0 THEN NULL ELSE repeat('<p>x</p>', int(id % 5)) END html"
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        got = dom.parse_pages(pages).selectExpr(
            "page_id", "size(nodes) n", "nodes IS NULL missing", "size(nodes) = 0 OR nodes.lo = sequence(0, size(nodes) - 1) ok"
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in got:
        assert r.missing == (r.page_id % 7 == 0)
        assert r.missing or (r.n == 2 * (r.page_id % 5) and r.ok)
