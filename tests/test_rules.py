import json

import pytest
from pyspark.sql import functions as F

from harrow.functions.selectors import selector_steps
from harrow.functions import urls as U
from harrow.operators import dom, extract
from harrow.sources import rules as R
from harrow.sources.pages import thread_references

FORUM = {
    "name": "F", "crawler_type": "bbs", "forum_type": "discuz", "base_url": "https://bbs.x.com",
    "selectors": {"thread_list": "li.row", "thread_link": "a", "image": "img", "next_page": "a.nxt"},
    "crawler": {"max_concurrent_requests": 3}, "image": {"min_width": 300},
    "urls": [{"type": "board", "name": "B", "url": "https://bbs.x.com/b"}, "https://bbs.x.com/t/1",
             {"type": "thread", "name": "Named", "url": "https://bbs.x.com/t/2"}, {"type": "board", "name": "empty"}],
}


@pytest.fixture()
def sites(spark, tmp_path):
    files = {
        "forum": FORUM,
        "news": {"forum_type": "news", "news_urls": ["https://n.com/"]},
        "legacy": {"crawler_type": "bbs", "boards": [{"name": "L", "url": "u1"}],
                   "example_threads": ["u2", {"type": "thread", "url": "u3"}, "u4"]},
        "odd": {"crawler_type": "mystery", "boards": [{"name": "L", "url": "u1"}],
                "urls": [{"type": "board", "name": "B", "url": "u5"}]},
        "example": FORUM, "template": FORUM,
    }
    for name, data in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1, ensure_ascii=False))
    (tmp_path / "broken.json").write_text('{"name": "x", ')
    (tmp_path / "notes.txt").write_text("no settings")
    return R.read_site_files(spark, str(tmp_path))


def test_files(sites):
    assert sorted(r.site for r in R.good_files(sites).collect()) == ["forum", "legacy", "news", "odd"]
    assert [r.file for r in R.bad_files(sites).collect()] == ["broken.json"]


def test_rules(sites):
    got = {r.site: r for r in R.site_rules(R.good_files(sites)).collect()}
    assert (got["forum"].crawler_type, got["forum"].image.min_width, got["forum"].next_page_selector) == ("bbs", 300, "a.nxt")
    assert (got["news"].crawler_type, got["news"].name, got["news"].thread_list_selector) == ("news", "Unknown Forum", "")
    assert got["odd"].crawler_type == "bbs" and got["odd"].forum_type == "custom"
    assert [t.url for t in got["legacy"].targets] == ["u1", "u2", "u4", "u3"]
    assert [t.url for t in got["odd"].targets] == ["u5"]


def test_targets(sites):
    rules = R.site_rules(R.good_files(sites))
    assert {(r.site, r.name, r.url) for r in R.boards(rules).collect()} == {
        ("forum", "B", "https://bbs.x.com/b"), ("legacy", "L", "u1"), ("odd", "B", "u5")
    }
    pages = [(r.url, r.name) for r in R.page_entries(rules).where("site = 'forum'").orderBy("pos").collect()]
    assert pages == [("https://bbs.x.com/t/1", None), ("https://bbs.x.com/t/2", "Named")]
    assert [r.url for r in R.entry_urls(rules).where("site = 'news'").collect()] == ["https://n.com/"]
    refs = thread_references(R.page_entries(rules).where("site = 'forum'"), name=F.col("name"), site_name=F.lit("F"))
    assert {(r.thread_id, r.title, r.board) for r in refs.collect()} == {("1", "Thread-1", "F"), ("2", "Named", "F")}


def test_presets(spark):
    got = {r.forum_type: r for r in R.forum_presets(spark).collect()}
    assert set(got) == {"discuz", "phpbb", "vbulletin"}
    assert (got["discuz"].min_size, got["phpbb"].min_size, got["vbulletin"].next_page_selector) == (30000, 10240, "a[rel='next']")
    df = spark.createDataFrame([("Discuz",), ("other",)], "forum_type string")
    assert {r.forum_type: r.min_width for r in R.with_presets(df).collect()} == {"discuz": 300, "other": 200}


def test_selector_steps(spark):
    text = "tbody[id^='normalthread'], a.s.xst,div.pcb  img , [class*=\"view\"],#single .body, img[file], a[rel='next']"
    got = spark.range(1).select(selector_steps(F.lit(text)).alias("s")).collect()[0]["s"]
    plain = [[(s.tag, s.classes, [tuple(a) for a in s.attrs]) for s in steps] for steps in got]
    assert plain == [
        [("tbody", [], [("id", "^=", "normalthread")])], [("a", ["s", "xst"], [])],
        [("div", ["pcb"], []), ("img", [], [])], [(None, [], [("class", "*=", "view")])],
        [(None, [], [("id", "=", "single")]), (None, ["body"], [])], [("img", [], [("file", "has", "")])],
        [("a", [], [("rel", "=", "next")])],
    ]


def test_rules_drive_pages(spark, sites):
    pages = spark.createDataFrame(
        [(1, "https://bbs.x.com/list", '<li class="row"><a href="/t/5">T</a></li>'), (2, "https://other.com/", "<li></li>")],
        "page_id long, url string, html string",
    )
    paired = dom.parse_pages(R.with_site_rules(pages, R.site_rules(R.good_files(sites))))
    rows = extract.thread_list(paired, F.col("thread_list_rule"), F.col("thread_link_rule"), "page_id").collect()
    assert [(r.page_id, r.thread_id) for r in rows] == [(1, "5")]


def test_hooks(spark):
    R.register_forum("mybb", lambda url, base: F.concat(base, F.lit("/big/"), url))
    try:
        df = spark.createDataFrame(
            [("Discuz", ["forum.php?mod=attachment&aid=1", "x.jpg"]), ("phpbb", ["forum.php?mod=attachment"]), ("MyBB", ["a"])],
            "t string, images array<string>",
        )
        got = [r[0] for r in df.select(R.process_images(F.col("images"), F.col("t"), F.lit("https://b"))).collect()]
    finally:
        del R._image_hooks["mybb"]
    assert got == [["https://b/forum.php?mod=attachment&aid=1&nothumb=yes", "x.jpg"], ["forum.php?mod=attachment"], ["https://b/big/a"]]


def test_precedence(spark):
    a, b = spark.range(1), spark.range(2)
    assert R.sites_to_crawl(a, b) is a and R.sites_to_crawl(None, b) is b and R.sites_to_crawl(detected=a) is a
    with pytest.raises(ValueError):
        R.sites_to_crawl()


def test_layout(spark):
    r = spark.range(1).select(
        U.forum_save_path(F.lit("d"), F.lit(None), F.lit("7"), F.lit("f.jpg")), U.news_save_path(F.lit("d"), F.lit("n.com"), F.lit("7"), F.lit("f.jpg"))
    ).collect()[0]
    assert tuple(r) == ("d/unknown/7/f.jpg", "d/n.com/7_f.jpg")
