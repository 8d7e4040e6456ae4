import datetime as dt

from pyspark.sql import functions as F

from harrow.operators import state
from harrow.plans.crawl import forum_crawl, news_crawl



def now():
    return F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")


PAGE = "page_id long, url string, html string, board string"


def test_forum(spark):
    def item(i):
        return f'<tbody id="normalthread_{i}"><a class="xst" href="/forum.php?mod=viewthread&tid={i}">Title {i}</a></tbody>'

    lists = spark.createDataFrame(
        [(1, "https://b.com/l?page=1", item(1) + item(2), "news"), (2, "https://b.com/l?page=2", item(2) + item(3) + item(4), "news"),
         (3, "https://b.com/l?page=3", None, "news")], PAGE)
    detail = '<div class="pcb"><img src="/forum.php?mod=attachment&aid={0}"><img src="/same.jpg"></div><div class="post-content">Text {0}</div>'
    threads = spark.createDataFrame(
        [(f"https://b.com/forum.php?mod=viewthread&tid={i}", detail.format(i)) for i in (1, 2, 3)], "url string, html string")
    rules = spark.createDataFrame(
        [("discuz", "https://b.com", "tbody[id^='normalthread'], tbody[id^='stickthread']", "a.s.xst, a.xst", "div.pcb img", "a.nxt")],
        "forum_type string, base_url string, thread_list_selector string, thread_link_selector string, image_selector string, next_page_selector string")
    stored = spark.createDataFrame([("1", "old", "u", "news", None, 0, None, "", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1))], state.THREADS)
    out = forum_crawl(lists, threads, rules, stored, now())
    assert sorted(r.thread_id for r in out["listed"].collect()) == ["2", "3", "4"]
    assert [r.thread_id for r in out["failed"].collect()] == ["4"]
    saved = {r.thread_id: r for r in out["threads"].collect()}
    assert sorted(saved) == ["1", "2", "3"] and saved["1"].title == "old"
    assert (saved["2"].title, saved["2"].content, saved["2"].image_count) == ("Title 2", "Text 2", 2)
    assert saved["3"].images == ["https://b.com/forum.php?mod=attachment&aid=3&nothumb=yes", "https://b.com/same.jpg"]
    images = {(r.thread_id, r.image_index): r.is_duplicate for r in out["images"].collect()}
    assert images == {("2", 1): False, ("2", 2): False, ("3", 1): False, ("3", 2): True}


def test_news(spark):
    def page(*ids, more=True):
        entries = "".join(f'<div class="article"><h3 class="title"><a href="/news/{i}">T{i}</a></h3></div>' for i in ids)
        return entries + ("<a class='load-more'>x</a>" if more else "")

    lists = spark.createDataFrame(
        [("n.com", 1, "https://n.com/", page(1, 2)), ("n.com", 2, "https://n.com/?page=2", page(2, 3)),
         ("n.com", 3, "https://n.com/?page=3", page(4, more=False)), ("n.com", 4, "https://n.com/?page=4", page(5)),
         ("gone.com", 1, "https://gone.com/", None)],
        "site string, page long, url string, html string")
    articles = spark.createDataFrame(
        [(f"https://n.com/news/{i}", f'<div class="article"><div class="body">Body {i}<img src="/i/{i}.jpg"><img src="/i/x.jpg"></div></div>') for i in (1, 2, 3)],
        "url string, html string")
    stored = spark.createDataFrame([("1", "u", "t", "n.com", "news", None, None, True), ("2", "u", "t", "n.com", "news", None, None, False)], state.ARTICLES)
    out = news_crawl(lists, articles, stored, F.lit("img"))
    extent = {r.site: (r.stop_page, r.stop_reason) for r in out["extent"].collect()}
    assert extent == {"n.com": (3, "no_load_more"), "gone.com": (1, "fetch_failed")}
    assert sorted(r.article_id for r in out["new_articles"].collect()) == ["2", "3", "4"]
    assert [r.article_id for r in out["failed"].collect()] == ["4"]
    full = {r.article_id: r for r in out["articles"].collect()}
    assert (full["2"].title, full["2"].content, full["2"].site) == ("T2", "Body 2", "n.com")
    tasks = sorted((r.article_id, r.image_url, r.save_path, r.total_count) for r in out["image_tasks"].collect())
    assert tasks[0] == ("2", "https://n.com/i/2.jpg", "img/n.com/2_2.jpg", 2) and len(tasks) == 4
    limited = news_crawl(lists, articles, stored, F.lit("img"), max_pages=1)
    assert sorted(r.article_id for r in limited["new_articles"].collect()) == ["2"]
