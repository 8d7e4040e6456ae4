"""Crawl runs with state, one after the other on the same small site."""

from __future__ import annotations

import datetime as dt

import pytest
from harrow.operators import keyfilter, state
from harrow.plans.runs import board_run, news_run
from harrow.sources.rules import boards
from pyspark.sql import functions as F

PAGE = "page_id long, url string, html string"
RULES = "forum_type string, base_url string, thread_list_selector string, thread_link_selector string, image_selector string, next_page_selector string"


@pytest.fixture
def now(spark):
    return F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")


def item(i):
    return f'<li class="t"><a href="/thread-{i}.html">Title {i}</a>'


def board_page(n, ids, nxt):
    return (n, f"https://b.com/f?p={n}", "<ul>" + "".join(map(item, ids)) + "</ul>" + (f'<a class="nxt" href="/f?p={nxt}">next</a>' if nxt else ""))


def board(spark, now, pages, threads, stored, checkpoints, **how):
    rules = spark.createDataFrame([("custom", "https://b.com", "li.t", "a", "div.c img", "a.nxt")], RULES)
    targets = spark.createDataFrame([("b.com", "one", "https://b.com/f?p=1"), ("b.com", "two", "https://b.com/f?p=90")], "site string, board string, url string")
    thread_pages = spark.createDataFrame(
        [(i, f"https://b.com/thread-{i}.html", f'<div class="c"><img src="/i/{i}.jpg"><img src="/i/same.jpg"></div>') for i in threads] + [(999, "https://b.com/thread-999.html", "x")], PAGE)
    return board_run(spark.createDataFrame(pages, PAGE), thread_pages, targets, rules, stored, checkpoints, now, **how)


def test_boards_go_on_where_they_were(spark, now, tmp_path):
    empty, none = spark.createDataFrame([], state.THREADS), spark.createDataFrame([], state.CHECKPOINTS)
    pages = [board_page(1, [1, 2], 2), board_page(2, [2, 3], 3), board_page(3, [4], 5), board_page(90, [3, 9], 1)]
    first = board(spark, now, pages, [1, 2, 3], empty, none, max_pages=2)
    assert [(r.board, r.page, r.url[-2:], r.work) for r in first["pages"].orderBy("board", "page").collect()] == [
        ("one", 1, "=1", "crawl"), ("one", 2, "=2", "crawl"), ("two", 1, "90", "crawl"), ("two", 2, "=1", "crawl")]
    assert sorted(r.thread_id for r in first["threads"].collect()) == ["1", "2", "3"]
    assert [r.thread_id for r in first["failed"].collect()] == ["9"]
    points = {r.board: r for r in first["checkpoints"].collect()}
    assert (points["one"].current_page, points["one"].last_thread_id, points["one"].status) == (3, "3", "completed")
    assert points["one"].stats == {"total_crawled": 3, "total_images": 6, "total_failed": 0}
    assert [(r.board, r.new_threads, r.saved, r.failed) for r in first["counters"].orderBy("board").collect()] == [("one", 3, 3, 0), ("two", 1, 0, 1)]

    # Taken up again, board one goes on with its third page, whose next page was never fetched.
    stored = spark.createDataFrame(first["threads"].collect(), state.THREADS)
    again = first["checkpoints"].withColumn("status", F.when(F.col("board") == "one", "running").otherwise(F.col("status")))
    again = spark.createDataFrame(again.collect(), state.CHECKPOINTS)
    second = board(spark, now, pages, [4], stored, again)
    assert [(r.page, r.work, r.fetched) for r in second["pages"].orderBy("page").collect()] == [(1, "skip", True), (2, "skip", True), (3, "crawl", True), (4, "crawl", False)]
    assert sorted(r.thread_id for r in second["threads"].collect()) == ["1", "2", "3", "4"]
    points = {r.board: r for r in second["checkpoints"].collect()}
    assert (points["one"].status, points["one"].last_error, points["one"].current_page) == ("error", "fetch_failed", 4)
    assert points["two"].status == "completed"
    images = {(r.thread_id, r.image_index): r.is_duplicate for r in first["images"].collect()}
    assert images == {(i, 1): False for i in "123"} | {("1", 2): False, ("2", 2): True, ("3", 2): True}


def news_page(site, n, ids, more=True):
    rows = "".join(f'<div class="article"><h3 class="title"><a href="/news/{i}">T{i}</a></h3></div>' for i in ids)
    return site, n, f"https://{site}/?page={n}", rows + ("<a class='load-more'>x</a>" if more else "")


def news(spark, now, lists, stored, seen, points, **how):
    articles = spark.createDataFrame(
        [(i, f"https://{s}/news/{i}", f'<div class="article"><div class="body">Body {i}<img src="/i/{i}.jpg"></div></div>') for s in ("n.com", "m.com") for i in range(1, 9)], PAGE)
    full = "site string, page long, url string, html string"
    return news_run(spark.createDataFrame(lists, full), articles, stored, seen, points, now, F.lit("img"), **how)


def test_news_sites_go_on_where_they_were(spark, now):
    lists = [news_page("n.com", 1, [1, 2]), news_page("n.com", 2, [2, 33]), news_page("n.com", 3, [5, 4]), news_page("n.com", 4, [6], False),
             news_page("m.com", 1, [7, 8], False), ("gone.com", 1, "https://gone.com/", None), news_page("rest.com", 1, [1])]
    stored = spark.createDataFrame([("1", "u", "t", "n.com", "news", None, None, True)], state.ARTICLES)
    seen = spark.createDataFrame([("n.com", "news", "5"), ("m.com", "news", "7")], state.SEEN)
    points = spark.createDataFrame([("rest.com", "news", 3, None, None, "completed", {}, None, None, None, None, None)], state.CHECKPOINTS)
    first = news(spark, now, lists, stored, seen, points, max_pages=2)
    ends = {r.site: (r.start_page, r.stop_page, r.stop_reason, r.status) for r in first["extent"].collect()}
    assert ends == {"n.com": (1, 2, "max_pages", "running"), "m.com": (1, 1, "no_load_more", "completed"), "gone.com": (1, 1, "fetch_failed", "completed")}
    # Without a checkpoint a site starts afresh: what it has seen does not count.
    assert sorted((r.site, r.article_id) for r in first["new_articles"].collect()) == [("m.com", "7"), ("m.com", "8"), ("n.com", "2"), ("n.com", "33")]
    assert [r.article_id for r in first["failed"].collect()] == ["33"]
    saved = {r.site: r for r in first["checkpoints"].collect()}
    assert (saved["n.com"].current_page, saved["n.com"].last_thread_id, saved["n.com"].min_article_id, saved["n.com"].max_article_id) == (3, "33", "2", "33")
    assert saved["n.com"].status == "running" and saved["n.com"].stats == {"articles_found": 2, "articles_crawled": 1, "images": 1}
    assert saved["m.com"].status == "completed" and saved["m.com"].stats == {"total_articles": 2, "total_images": 2}
    assert saved["gone.com"].current_page == 1 and saved["rest.com"].status == "completed"
    assert sorted((r.site, r.article_id) for r in first["seen"].collect()) == sorted(
        [("m.com", "7"), ("m.com", "8"), ("n.com", "1"), ("n.com", "2"), ("n.com", "33"), ("n.com", "5")])

    outcomes = spark.createDataFrame([("6", "ok", 1), ("4", None, 1)], "article_id string, outcome string, total_count int")
    again = spark.createDataFrame(first["checkpoints"].collect(), state.CHECKPOINTS)
    second = news(spark, now, lists, stored, spark.createDataFrame(first["seen"].collect(), state.SEEN), again, outcomes=outcomes)
    assert {r.site: (r.start_page, r.stop_page, r.stop_reason) for r in second["extent"].collect()} == {"n.com": (3, 4, "no_load_more")}
    assert sorted(r.article_id for r in second["new_articles"].collect()) == ["4", "6"]
    assert {r.article_id: r.images_downloaded for r in second["stored"].collect()} == {"1": True, "6": True}
    saved = {r.site: r for r in second["checkpoints"].collect()}
    assert (saved["n.com"].current_page, saved["n.com"].status, saved["n.com"].min_article_id, saved["n.com"].max_article_id) == (5, "completed", "2", "33")


def test_a_start_page_beyond_the_pages(spark, now):
    nothing = (spark.createDataFrame([], state.ARTICLES), spark.createDataFrame([], state.SEEN), spark.createDataFrame([], state.CHECKPOINTS))
    out = news(spark, now, [news_page("n.com", 1, [1])], *nothing, start_page=6)
    assert [tuple(r)[:5] for r in out["extent"].collect()] == [("n.com", "start", 6, 6, "fetch_failed")]
    assert out["new_articles"].collect() == []


def test_news_sites_with_rules_of_their_own(spark, now):
    nothing = (spark.createDataFrame([], state.ARTICLES), spark.createDataFrame([], state.SEEN), spark.createDataFrame([], state.CHECKPOINTS))
    lists = [("n.com", 1, "https://n.com/", '<li class="e"><b>One</b><a href="/news/1">x</a></li><li class="e"><b>Two</b><a class="go" href="/news/2">x</a></li>'),
             news_page("m.com", 1, [7])]
    rules = spark.createDataFrame([("n.com", "li.e", "b", "a.go"), ("other.com", "p", "p", "p")],
                                  "site string, article_selector string, title_selector string, link_selector string")
    out = news(spark, now, lists, *nothing, site_rules=rules)
    assert sorted((r.site, r.article_id, r.title) for r in out["new_articles"].collect()) == [("m.com", "7", "T7"), ("n.com", "1", "One"), ("n.com", "2", "Two")]


def test_older_board_settings_are_used_where_no_board_is_listed(spark):
    files = spark.createDataFrame(
        [("a", [("board", "new", "/new")], [("board", "old", "/old")]), ("b", [("thread", "t", "/t"), ("board", "none", "")], [("board", "old", "/old"), ("board", "x", "")])],
        "site string, targets array<struct<type:string,name:string,url:string>>, legacy_boards array<struct<type:string,name:string,url:string>>")
    assert sorted((r.site, r.name, r.url) for r in boards(files).collect()) == [("a", "new", "/new"), ("b", "old", "/old")]


def test_the_key_filter_keeps_all_wanted_rows_and_moves_none(spark):
    wide = spark.range(60_000).select(F.when(F.col("id") % 50 > 0, F.concat(F.lit("u"), F.col("id"))).alias("url"), F.col("id"), F.repeat(F.lit("x"), 100).alias("html"))
    wanted = wide.where("id % 9 = 4").select("url")
    out = keyfilter.passing(wide, wanted, "url")
    ids = {r.id for r in out.select("id").collect()}
    exact = {i for i in range(60_000) if i % 9 == 4 and i % 50}
    assert exact <= ids and len(ids - exact) < 0.02 * 60_000
    assert keyfilter.passing(wide, wanted.limit(0), "url").collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "html" in line]
    pieces = keyfilter.key_filter(wide.select("url"), "url").collect()
    assert len({r.piece for r in pieces}) == pieces[0].pieces and all(len(r.bits) == 4096 for r in pieces)
