"""Whole crawl runs with state: where each board or site goes on, how far it gets, what it leaves behind.

A run takes the stored tables as they are and returns the new ones; the caller
writes them, or feeds them to a ``StateTable``. List pages are parsed once; what
comes of a page is narrow, and no join or filter moves its markup (pages of wanted
URLs pass a filter of their keys first, see ``operators.keyfilter``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.functions.text import integer_key, integer_text
from harrow.operators import dom, extract, frontier, state
from harrow.operators.dedup import url_duplicates
from harrow.operators.keyfilter import passing
from harrow.operators.skew import keep_first
from harrow.operators.stats import completed_articles
from harrow.operators.walk import board_walk, walk_checkpoints
from harrow.session import materialized
from harrow.sources.rules import news_rule_columns, process_images, with_news_rules, with_site_rules
from harrow.streaming.crawl_stream import completion_rows, image_tasks

KEYS = ["site", "board"]
NEWS = "news"


def _shaped(df: DataFrame, schema: DataFrame, *more: str) -> DataFrame:
    """The columns of a stored table in its types, NULL where ``df`` has none, and some others."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.schema], *more)


def _ended(checkpoints: DataFrame, rows: DataFrame, ends: DataFrame, now: Column) -> DataFrame:
    """Checkpoints after a run: saved as running, then marked completed or failed."""
    saved = state.save_checkpoints(checkpoints, _shaped(rows.withColumn("status", F.lit(state.RUNNING)), checkpoints).withColumn("seq", F.lit(0)), now)
    events = ends.where(F.col("status").isin(state.COMPLETED, state.ERROR)).select(
        *KEYS, F.col("status").alias("kind"), F.when(F.col("status") == state.ERROR, F.col("stop_reason")).alias("message"),
        F.when(F.col("status") == state.COMPLETED, F.col("final_stats")).alias("final_stats"), F.lit(0).alias("seq"))
    return state.apply_transitions(materialized(saved, "checkpoints"), events, now)


def thread_details(thread_pages: DataFrame, wanted: DataFrame, rules: DataFrame) -> DataFrame:
    """(thread_url, images, metadata, content, ...) of the pages of wanted URLs, the first page of each."""
    parsed = dom.parse_pages(with_site_rules(passing(thread_pages, wanted, "url"), rules), implied_ends=True)
    found = extract.thread_detail(parsed, F.col("image_rule"), "forum_type", "base_url", "page_id").drop("thread_id")
    exact = found.join(wanted.select(F.col("url").alias("thread_url")), "thread_url", "left_semi")
    return keep_first(materialized(exact, "thread-details"), "thread_url", "page_id").drop("page_id")


def board_run(
    list_pages: DataFrame,
    thread_pages: DataFrame,
    targets: DataFrame,
    rules: DataFrame,
    stored: DataFrame,
    checkpoints: DataFrame,
    now: Column,
    max_pages: int | None = None,
    start_page: int | None = None,
    resume: bool = True,
) -> dict[str, DataFrame]:
    """One run over the boards ``targets`` (site, board, url of the first page).

    ``list_pages`` and ``thread_pages`` have (page_id, url, html). Each board is
    walked by its next-page links from its checkpoint or start page; the threads of
    the pages crawled that are not stored are read and stored; the checkpoint is
    saved and ends as completed, or as failed where a page could not be fetched.
    Returns the walk (``pages``, ``ends``), ``listed`` (new threads), ``failed`` (those
    without a page), ``threads`` and ``checkpoints`` (the new stored tables),
    ``images`` and ``counters`` (per board).
    """
    nodes = F.col("nodes")
    lists = dom.parse_pages(with_site_rules(list_pages, rules), implied_ends=True)
    entries = extract.thread_entries(nodes, F.col("url"), F.col("thread_list_rule"), F.col("thread_link_rule"))
    read = lists.select(
        "page_id", "url", nodes.isNotNull().alias("fetched"), nodes.isNull().alias("missing"),
        extract.next_page(nodes, F.col("url"), F.col("next_page_rule")).alias("next_url"), entries.alias("entries"))
    read = keep_first(materialized(read, "list-pages"), "url", ["missing", "page_id"])
    walk = board_walk(targets, read, checkpoints, start_page, max_pages, resume)
    crawled = walk["pages"].where("work = 'crawl' AND fetched").select(*KEYS, "page", "url")
    every = crawled.join(read.select("url", F.posexplode("entries").alias("pos", "e")), "url").select(
        *KEYS, "page", (F.col("pos") + 1).alias("pos"), "e.*", U.thread_id(F.col("e.thread_url")).alias("thread_id"))
    every = materialized(every, "listed")
    listed = materialized(frontier.new_threads(keep_first(every, "thread_id", [*KEYS, "page", "pos"]), stored), "new-threads")
    details = thread_details(thread_pages, listed.select(F.col("thread_url").alias("url")).distinct(), rules)
    threads = materialized(
        listed.join(details, "thread_url")
        .withColumn("images", process_images(F.col("images"), F.col("forum_type"), F.col("base_url")))
        .withColumn("image_count", F.size("images")), "threads")
    failed = frontier.failed_details(listed, details, "thread_url")
    images = frontier.image_index(threads.select(*KEYS, "page", "pos", "thread_id", "thread_url", "images"))
    counters = (
        listed.groupBy(*KEYS).agg(F.count("*").alias("new_threads"))
        .join(threads.groupBy(*KEYS).agg(F.count("*").alias("saved"), F.sum("image_count").alias("images")), KEYS, "full_outer")
        .join(failed.groupBy(*KEYS).agg(F.count("*").alias("failed")), KEYS, "full_outer")
    )
    counters = materialized(
        walk["ends"].join(counters, KEYS, "left").select(
            *KEYS, "stop_page", "stop_reason", "status", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("new_threads", "saved", "images", "failed")]),
        "counters")
    final = F.create_map(F.lit("total_crawled"), F.col("saved"), F.lit("total_images"), F.col("images"), F.lit("total_failed"), F.col("failed"))
    rows = walk_checkpoints(walk, every.select(*KEYS, "page", "pos", "thread_id", "thread_url"))
    batch = _shaped(threads.withColumn("url", F.col("thread_url")), stored).withColumn("seq", F.lit(0))
    return {
        **walk,
        "listed": listed,
        "failed": failed,
        "threads": state.upsert_threads(stored, batch, now),
        "images": url_duplicates(images, "image_url", [*KEYS, "page", "pos", "image_index"]),
        "counters": counters,
        "checkpoints": _ended(checkpoints, rows, counters.withColumn("final_stats", final), now),
    }


def news_run(
    list_pages: DataFrame,
    article_pages: DataFrame,
    stored: DataFrame,
    seen: DataFrame,
    checkpoints: DataFrame,
    now: Column,
    root: Column,
    article_rules: dict | None = None,
    max_pages: int | None = None,
    start_page: int | None = None,
    resume: bool = True,
    outcomes: DataFrame | None = None,
    site_rules: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One run over the news sites of ``list_pages`` (site, page, url, html).

    ``article_pages`` has (page_id, url, html). ``seen`` (``state.SEEN``) holds the
    ids that a site's earlier pages have shown; they count where a run goes on from
    its checkpoint. ``outcomes`` (article_id, outcome, total_count) tells what became
    of the images; without it no article is stored as done. ``site_rules`` gives each site
    list rules of its own (see ``with_news_rules``). Returns ``extent`` (site,
    start_page, stop_page, stop_reason, status), ``new_articles``, ``failed``,
    ``articles`` (with details), ``image_tasks``, and the new tables ``stored``,
    ``seen`` and ``checkpoints``.
    """
    nodes = F.col("nodes")
    sites = list_pages.select("site").distinct().withColumn("board", F.lit(NEWS))
    wanted = F.lit(None).cast("int") if start_page is None else F.lit(start_page)
    points = frontier.resume_points(sites, checkpoints, F.lit(NEWS), wanted, max_pages, resume)
    points = materialized(points.where(F.col("action").isin("resume", "start")).select("site", "action", F.col("start_page").cast("long").alias("start_page")), "sites")
    # Sites that rest are not parsed; a few others may pass and fall out of the next join.
    wanted_lists = passing(list_pages, points, "site")
    if site_rules is not None:
        wanted_lists, article_rules = with_news_rules(wanted_lists, site_rules, page_id="url"), news_rule_columns()
    parsed = dom.parse_pages(wanted_lists)
    found = extract.article_entries(nodes, U.base_url(F.col("url")), article_rules)
    read = parsed.select(
        "site", F.col("page").cast("long").alias("page"), nodes.isNotNull().alias("fetched"), found.alias("entries"),
        F.coalesce(extract.has_load_more(nodes), F.lit(False)).alias("has_more"))
    read = materialized(materialized(read, "list-pages").join(points, "site").where(F.col("page") >= F.col("start_page")), "list-pages")
    entries = materialized(
        read.select("site", "page", "action", F.posexplode("entries").alias("pos", "e")).select("site", "page", "action", "pos", "e.*"), "entries")
    ids = entries.select("site", "article_id", "action")
    known = ids.join(frontier.finished_articles(stored), "article_id", "left_semi").select("site", "article_id").unionByName(
        ids.where("action = 'resume'").join(seen.where(F.col("board") == NEWS).select("site", "article_id"), ["site", "article_id"], "left_semi")
        .select("site", "article_id")).distinct()
    known = materialized(known, "known")
    marked = frontier.mark_first_seen(entries.drop("action"), known)
    counts = frontier.page_counts(entries, known)
    pages = read.drop("entries", "action").join(counts, ["site", "page"], "left").fillna({"n_articles": 0, "n_new": 0})
    extent = frontier.crawl_extent(pages, start_page=F.col("start_page"), max_pages=max_pages)
    # A site none of whose pages from the start page on is there ends at its first request.
    extent = materialized(points.join(extent, "site", "left").select(
        "site", F.lit(NEWS).alias("board"), "action", "start_page", F.coalesce("stop_page", "start_page").alias("stop_page"),
        F.coalesce("stop_reason", F.lit(frontier.STOP_REASONS[0])).alias("stop_reason"), F.coalesce("status", F.lit(state.COMPLETED)).alias("status")), "extent")
    visited = materialized(frontier.crawled_pages(marked, extent, start_page=1), "visited")
    fresh = visited.where("is_new")
    details = extract.article_detail(
        dom.parse_pages(passing(article_pages, fresh.select(F.col("article_url").alias("url")), "url")), "page_id")
    details = keep_first(materialized(details, "article-details"), "article_url", "page_id").drop("page_id")
    full = materialized(frontier.merge_detail(fresh.drop("is_new"), details, "article_url"), "articles")
    result = {
        "extent": extent.drop("board"),
        "new_articles": fresh,
        "failed": frontier.failed_details(fresh, details, "article_url"),
        "articles": full,
        "image_tasks": image_tasks(full.select("site", "article_id", "article_url", "title", "images"), root),
        "seen": seen.unionByName(visited.select("site", F.lit(NEWS).alias("board"), "article_id").where("article_id IS NOT NULL")).distinct(),
        "checkpoints": _ended(checkpoints, _news_checkpoints(extent, fresh, full, checkpoints), _news_ends(extent, fresh, full), now),
        "stored": stored,
    }
    if outcomes is not None:
        snapshots = _shaped(full.withColumn("url", F.col("article_url")).withColumn("board", F.lit(NEWS)), stored)
        batch = _shaped(completion_rows(snapshots, completed_articles(outcomes)), stored, "seq")
        result["stored"] = state.upsert_articles(stored, batch, now)
    return result


def _news_counts(extent: DataFrame, fresh: DataFrame, full: DataFrame) -> DataFrame:
    found = fresh.groupBy("site").agg(F.count("*").alias("found"))
    images = full.groupBy("site").agg(F.count("*").alias("crawled"), F.sum(F.size("images")).alias("images"))
    return extent.join(found, "site", "left").join(images, "site", "left").fillna({"found": 0, "crawled": 0, "images": 0})


def _news_ends(extent: DataFrame, fresh: DataFrame, full: DataFrame) -> DataFrame:
    final = F.create_map(F.lit("total_articles"), F.col("found").cast("bigint"), F.lit("total_images"), F.col("images").cast("bigint"))
    return _news_counts(extent, fresh, full).withColumn("final_stats", final)


def _news_checkpoints(extent: DataFrame, fresh: DataFrame, full: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The checkpoint of each site: next page, last new article, smallest and largest id so far."""
    place = F.struct("page", "pos")
    number = integer_key(F.col("article_id"))
    own = fresh.groupBy("site").agg(
        F.max_by("article_id", place).alias("last_thread_id"), F.max_by("article_url", place).alias("last_thread_url"),
        F.min(number).alias("least"), F.max(number).alias("most"))
    old = checkpoints.where(F.col("board") == NEWS).select(
        "site", integer_key(F.col("min_article_id")).alias("old_least"), integer_key(F.col("max_article_id")).alias("old_most"))
    resumed = F.col("action") == "resume"
    # The page that could not be read, or had no entries, is the one to go on with.
    again = F.col("stop_reason").isin("fetch_failed", "no_articles")
    stats = F.create_map(F.lit("articles_found"), F.col("found").cast("bigint"), F.lit("articles_crawled"), F.col("crawled").cast("bigint"),
                         F.lit("images"), F.col("images").cast("bigint"))
    return _news_counts(extent, fresh, full).join(own, "site", "left").join(old, "site", "left").select(
        *KEYS, (F.col("stop_page") + F.when(again, 0).otherwise(1)).cast("int").alias("current_page"), "last_thread_id", "last_thread_url", stats.alias("stats"),
        integer_text(F.least("least", F.when(resumed, F.col("old_least")))).alias("min_article_id"),
        integer_text(F.greatest("most", F.when(resumed, F.col("old_most")))).alias("max_article_id"))
