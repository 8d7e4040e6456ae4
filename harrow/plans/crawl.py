"""Whole flows over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.operators import dom, extract, frontier
from harrow.operators.dedup import url_duplicates
from harrow.operators.keyfilter import passing
from harrow.operators.profile import detected_rules, forum_type, page_profiles, site_profiles
from harrow.operators.skew import keep_first
from harrow.operators.state import upsert_threads
from harrow.session import materialized
from harrow.sources.rules import news_rule_columns, process_images, with_news_rules, with_site_rules
from harrow.streaming.crawl_stream import image_tasks


def new_pages_per_host(pages: DataFrame) -> DataFrame:
    """Distinct thread pages per host: host and id of every URL, first seen wins."""
    ids = pages.select(
        "page_id", U.site_key(F.col("url")).alias("host"), U.thread_id(F.col("url")).alias("thread_id")
    )
    firsts = ids.groupBy("host", "thread_id").agg(F.min("page_id").alias("page_id"))
    return firsts.groupBy("host").agg(F.count("*").alias("n_threads"), F.min("page_id").alias("first_page_id"))


def forum_crawl(
    list_pages: DataFrame, thread_pages: DataFrame, rules: DataFrame, stored: DataFrame, now: Column
) -> dict[str, DataFrame]:
    """Forum flow: list pages -> new threads -> detail -> images -> thread table.

    ``list_pages`` has (page_id, url, html, board), ``thread_pages`` (url, html).
    The check against stored threads comes before any thread page is parsed.
    """
    lists = dom.parse_pages(with_site_rules(list_pages, rules), implied_ends=True)
    listed = extract.thread_list(
        lists, F.col("thread_list_rule"), F.col("thread_link_rule"), "page_id", "board", "host"
    )
    listed = frontier.new_threads(keep_first(materialized(listed, "listed"), "thread_id", ["page_id", "pos"]), stored)
    listed = materialized(listed, "new-threads")
    # A few pages that are not wanted may pass; they fall out of the joins with their URLs.
    wanted = passing(thread_pages, listed.select(F.col("thread_url").alias("url")), "url")
    details_in = dom.parse_pages(with_site_rules(wanted, rules, page_id="url"), implied_ends=True)
    details = extract.thread_detail(details_in, F.col("image_rule"), "forum_type", "base_url").drop("thread_id")
    details = materialized(details, "thread-details")
    threads = (
        listed.join(details, "thread_url")
        .withColumn("images", process_images(F.col("images"), F.col("forum_type"), F.col("base_url")))
        .withColumn("image_count", F.size("images"))
    )
    images = frontier.image_index(threads.select("page_id", "pos", "board", "thread_id", "thread_url", "images"))
    checked = url_duplicates(images, "image_url", ["page_id", "pos", "image_index"])
    batch = threads.select(
        "thread_id", "title", F.col("thread_url").alias("url"), "board", "images", "image_count", "metadata",
        "content", F.lit(None).cast("timestamp").alias("created_at"), F.lit(0).alias("seq"),
    )
    return {
        "listed": listed,
        "failed": frontier.failed_details(listed, details, "thread_url"),
        "threads": upsert_threads(stored, batch, now),
        "images": checked,
    }


def news_crawl(
    list_pages: DataFrame,
    article_pages: DataFrame,
    stored: DataFrame,
    root: Column,
    article_rules: dict | None = None,
    max_pages: int | None = None,
    start_page: int = 1,
    site_rules: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """News flow: list pages -> how far to go -> new articles -> detail -> image tasks.

    ``list_pages`` has (site, page, url, html), ``article_pages`` (url, html). The
    rules of the lists are the same for all sites, or each site has its own in
    ``site_rules`` (see ``with_news_rules``).
    """
    nodes = F.col("nodes")
    if site_rules is not None:
        list_pages, article_rules = with_news_rules(list_pages, site_rules, page_id="url"), news_rule_columns()
    lists = dom.parse_pages(list_pages)
    found = extract.article_entries(nodes, U.base_url(F.col("url")), article_rules)
    read = materialized(
        lists.select(
            "site", "page", nodes.isNotNull().alias("fetched"), found.alias("entries"),
            F.coalesce(extract.has_load_more(nodes), F.lit(False)).alias("has_more"),
        ),
        "list-pages",
    )
    entries = read.select("site", "page", F.posexplode("entries").alias("pos", "e")).select("site", "page", "pos", "e.*")
    known = entries.select("site", "article_id").join(
        frontier.finished_articles(stored), "article_id", "left_semi"
    )
    marked = frontier.mark_first_seen(entries, known)
    counts = frontier.page_counts(entries, known)
    nothing = {"n_articles": 0, "n_new": 0}
    pages = read.drop("entries").join(counts, ["site", "page"], "left").fillna(nothing)
    extent = materialized(frontier.crawl_extent(pages, start_page=start_page, max_pages=max_pages), "extent")
    fresh = frontier.crawled_pages(marked.where("is_new"), extent, start_page=start_page)
    fresh = materialized(fresh, "new-articles")
    wanted = passing(article_pages, fresh.select(F.col("article_url").alias("url")), "url")
    details = materialized(extract.article_detail(dom.parse_pages(wanted)), "article-details")
    full = frontier.merge_detail(fresh, details, "article_url")
    return {
        "extent": extent,
        "new_articles": fresh,
        "failed": frontier.failed_details(fresh, details, "article_url"),
        "articles": full,
        "image_tasks": image_tasks(full.select("site", "article_id", "article_url", "title", "images"), root),
    }


def detect_rules(pages: DataFrame) -> DataFrame:
    """Guess the rules of every site in a page table."""
    typed = pages.withColumn("site", U.host(F.col("url"))).withColumn("forum_type", forum_type(F.col("html")))
    profile = site_profiles(page_profiles(dom.parse_pages(typed, implied_ends=True), "site", "page_id"))
    return detected_rules(profile, F.concat(F.lit("https://"), F.col("site")))
