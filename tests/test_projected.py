"""Single tags of a page are those of its full tree."""

from __future__ import annotations

import random

from harrow.operators import dom
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"
PARTS = [
    "<a href='x'>", "<A HREF=y CLASS=c>", '<a href="p&amp;q">', "<a>", "<a href>", "<img src=1.jpg/>", '<IMG alt="<a href=no>" src=\'2\'>', "</a>", "</p>", "<p>",
    "<!-- <a href=c> -->", "<!--", "-->", "<script>", "</script>", "<style>a{}</style>", "<![CDATA[<a href=d>]]>", "<!DOCTYPE html>", "<?php <a href=e> ?>", "<![bad<a href=f>",
    "<a href=1 href=2>", "<a\nhref = 'z'\n>", "<a href='open", "text & more &lt;", "<", "<a", "<textarea><a href=t></textarea>", "<title><a href=u></title>", "<b/>", "<a href=/s/>", "&#65;",
]


def same(spark, pages, tags, attrs):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(4)
    full = {}
    for r in dom.parse_pages(df).collect():
        keep = None if r.nodes is None else [
            (n.tag, {k: v for k, v in n.attrs.items() if attrs is None or k in attrs}) for n in r.nodes if n.attrs is not None and n.tag in tags]
        full[r.page_id] = keep
    got = {r.page_id: None if r.elements is None else [(e.tag, e.attrs) for e in r.elements] for r in dom.page_tags(df, tags, attrs, "page_id").collect()}
    assert got == full
    return got


def test_any_markup(spark):
    rng = random.Random(11)
    pages = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(1500)] + [None, ""]
    got = same(spark, pages, ["a", "img"], ["href", "src"])
    assert any(v for v in got.values()) and any(v is None for v in got.values())
    same(spark, pages, ["a", "p", "script", "textarea"], None)


def test_given_pages(spark):
    pages = [r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("html").collect()]
    same(spark, pages, ["a"], ["href"])
    same(spark, pages, ["li", "meta", "p"], None)


def test_links_of_other_quotes_and_cases(spark):
    df = spark.createDataFrame([(1, "<A HREF='/a'>x</A><a href=/b>y</a><!-- <a href=\"/no\"> --><a name=n>z</a><a href=\"\">e</a>")], "page_id long, html string")
    assert dom.page_links(df, "page_id").first().hrefs == ["/a", "/b", ""]
    assert [(r.pos, r.href) for r in dom.flat_links(df, "page_id").orderBy("pos").collect()] == [(1, "/a"), (2, "/b"), (3, "")]
    assert dom.flat_links(df.withColumn("html", F.lit(None).cast("string")), "page_id").collect() == []
