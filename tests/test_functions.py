from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import text as X
from harrow.functions import urls as U


def apply(spark, fn, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_thread_id(spark):
    urls = {
        "https://bbs.com/forum.php?mod=viewthread&tid=12345": "12345",
        "https://a.com/thread-77-1-1.html": "77",
        "https://a.com/t/88": "88",
        "https://a.com/forum.php?fid=9": "9",
        "https://a.com/news/55.html": "55",
        "https://a.com/5/": "5",
        "https://a.com/6?x=1": "6",
    }
    assert apply(spark, U.thread_id, urls) == list(urls.values())
    digest = apply(spark, U.thread_id, ["https://bbs.com/page/foo"])[0]
    assert len(digest) == 16 and set(digest) <= set("0123456789abcdef")


def test_article_id(spark):
    urls = {
        "/news/123": "123", "/15537?a=1": "15537", "/x?id=4": "4", "/x?article_id=6": "6",
        "/article/9-b": "9", "/news/8-b": "8",
    }
    assert apply(spark, U.article_id, urls) == list(urls.values())


def test_image_url(spark):
    urls = {
        "https://cdn.com/a.jpg": True, "https://cdn.com/path/image/123": True, "https://cdn.com/A.PNG": True,
        "": False, "not-a-url": False, "https://cdn.com/page": False, None: False, "/a.jpg": False,
    }
    assert apply(spark, U.is_image_url, urls) == list(urls.values())
    assert apply(spark, lambda c: U.is_image_url(c, ["gif"]), ["https://c.com/a.jpg", "https://c.com/a.gif"]) == [False, True]


def test_number_from_text(spark):
    assert apply(spark, X.number_from_text, ["1,234 次", "no digits here", "56", "a1b2"]) == [1234, 0, 56, 1]


def test_size_suffix(spark):
    assert apply(spark, U.strip_size_suffix, ["photo-100x100.jpg", "a-1x2/b.jpg"]) == ["photo.jpg", "a-1x2/b.jpg"]


def test_attachment(spark):
    fn = lambda c: U.full_size_attachment(c, F.lit("https://b.com"))
    got = apply(spark, fn, ["forum.php?mod=attachment&aid=1", "/forum.php?x=1", "https://b.com/a.jpg",
                            "https://b.com/forum.php?mod=attachment&nothumb=yes"])
    assert got == ["https://b.com/forum.php?mod=attachment&aid=1&nothumb=yes", "https://b.com/forum.php?x=1",
                   "https://b.com/a.jpg", "https://b.com/forum.php?mod=attachment&nothumb=yes"]


def test_image_filename(spark):
    got = apply(spark, U.image_filename, ["https://a.com/x/p-300x200.jpg?v=1", "https://a.com/x", "https://a.com/a-1x1.b.png"])
    assert got[0] == "p.jpg" and got[2] == "a.b.png"
    assert got[1].endswith(".jpg") and len(got[1]) == 16


def test_generated_filename(spark):
    fn = lambda c: U.generated_filename(c, F.lit(1), F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit("b1"), F.lit("t1"))
    assert apply(spark, fn, ["https://example.com/photo.xyz"]) == ["b1_t1_001_20240102_030405.jpg"]


def test_site_and_board(spark):
    assert apply(spark, U.site_key, ["https://a.com:81/x", "a.com", "a.com/x"]) == ["a.com:81", "a.com", "a.com"]
    assert apply(spark, U.board_key, ["", None, "b"]) == ["all", "all", "b"]


def test_page_url(spark):
    assert apply(spark, lambda c: U.page_url(c, F.lit(2)), ["http://a", "http://a?x=1"]) == ["http://a?page=2", "http://a?x=1&page=2"]
    assert apply(spark, lambda c: U.page_url(c, F.lit(1)), ["http://a"]) == ["http://a"]


def test_json(spark):
    got = apply(spark, lambda c: X.decode_json(c, "array<string>"), ['["a","b"]', "null", None, "oops", "[]"])
    assert got == [["a", "b"], None, None, None, []]
    df = spark.createDataFrame([(["x"],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(X.encode_json(F.col("v"), T.ArrayType(T.StringType()))).collect()] == ['["x"]', "null"]


BASES = ["http://a/b/c/d;p?q", "https://x.com", "https://x.com/", "https://x.com/a/b.html?q=1#f"]
REFS = """g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g /./g /../g
g. .g g.. ..g ./../g ./g/. g/./h g/../h http:g javascript:void(0) HTTP://Q/x a//b /a//b mailto:x@y g?y/./x g#s/../x
/a? /a# /a?x=1 /a.b?x#y /a?#b https://x.com http://a https://x.com? http://a/b/../c?q http:///x https:/y /.. /a/./b /a/.. /中文 ?a#b""".split() + [""]


def joined(spark, pairs):
    df = spark.createDataFrame(pairs, "b string, r string")
    return [r[0] for r in df.select(U.resolve_url(F.col("b"), F.col("r"))).collect()]


def test_resolve_url(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    assert joined(spark, pairs) == [urljoin(b, r) for b, r in pairs]


segments = st.lists(st.sampled_from(["a", "b.c", ".", "..", "", "d-1"]), max_size=5)
refs = st.builds(
    lambda lead, parts, tail: lead + "/".join(parts) + tail,
    st.sampled_from(["", "/", "./", "../"]), segments, st.sampled_from(["", "?x=1", "#f", "?x#f"]),
)


@settings(max_examples=5, deadline=None)
@given(st.lists(refs.filter(lambda r: not r.startswith("//")), min_size=40, max_size=60))
def test_resolve_url_any(spark, many):
    pairs = [(b, r) for b in BASES for r in many]
    assert joined(spark, pairs) == [urljoin(b, r) for b, r in pairs]


@pytest.mark.parametrize("base, ref, want", [
    ("https://news.com", "/item/456", "https://news.com/item/456"),
    ("https://news.com", "item/456", "https://news.com/item/456"),
    ("https://news.com", "http://o.com/1", "http://o.com/1"),
])
def test_article_url(spark, base, ref, want):
    assert apply(spark, lambda c: U.absolute_article_url(F.lit(base), c), [ref]) == [want]


def test_links(spark):
    hrefs = ["/thread/1", "/user/thread/1", "/x", "#thread"]
    assert apply(spark, U.is_thread_link, hrefs) == [True, False, False, False]
