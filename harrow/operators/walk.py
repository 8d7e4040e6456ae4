"""Board walk: the pages of a board, numbered by their own next-page links.

A board is known by its first page; where its other pages stand follows from the
links alone. Pages are ranked by pointer doubling: round k joins what is reached
with jumps of 2^k pages, so a board of n pages takes log2(n) rounds, each a join
of the link table with itself, and no board is walked page by page or gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators.frontier import resume_points
from harrow.operators.state import COMPLETED, ERROR
from harrow.session import discard, materialized

# Why a walk ends; a page that links back to one of its board ends as "cycle".
FETCH_FAILED, NO_NEXT, MAX_PAGES, CYCLE = "fetch_failed", "no_next_page", "max_pages", "cycle"


def single_links(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """(url, fetched, next_url): one row per URL; of a URL fetched twice the first row that was fetched counts."""
    first = F.min(F.struct((~F.col("fetched")).alias("missing"), F.col(order).isNull(), F.col(order), F.col("next_url").alias("next_url")))
    return pages.where("url IS NOT NULL").groupBy("url").agg(first.alias("f")).select(
        "url", (~F.col("f.missing")).alias("fetched"), F.when(~F.col("f.missing"), F.col("f.next_url")).alias("next_url"))


def follow(starts: DataFrame, links: DataFrame, keys: list[str], last: str | None = None) -> DataFrame:
    """(keys, url, page): every page reached from ``url`` of a start over next-page links, the start being page 1.

    ``links`` has one row per URL (url, next_url). A URL that is linked but not
    in the table is reached too, and a page that comes again keeps its first
    number, so a cycle is gone round once. ``last`` names a column of ``starts``:
    no page beyond it is reached (NULL: no limit). The rounds end when nothing
    new is reached.
    """
    limit = [F.col(last).alias("_last")] if last else [F.lit(None).cast("int").alias("_last")]
    jumps = materialized(links.where("next_url IS NOT NULL").select("url", F.col("next_url").alias("to")), "jumps")
    allowed = F.col("_last").isNull() | (F.col("page") <= F.col("_last"))
    reached = materialized(starts.select(*keys, "url", F.lit(1).cast("long").alias("page"), *limit).where(allowed), "reached")
    length, n = 1, reached.count()
    while True:
        further = reached.join(jumps, "url").select(*keys, F.col("to").alias("url"), (F.col("page") + length).alias("page"), "_last").where(allowed)
        more = materialized(reached.unionByName(further).groupBy(*keys, "url").agg(F.min("page").alias("page"), F.first("_last").alias("_last")), "reached")
        now = more.count()
        discard(reached)
        reached = more
        if now == n:
            break
        length, n = 2 * length, now
        ahead = jumps.select(F.col("url").alias("to"), F.col("to").alias("_far"))
        doubled = materialized(jumps.join(ahead, "to").select("url", F.col("_far").alias("to")), "jumps")
        discard(jumps)
        jumps = doubled
    discard(jumps)
    return reached.drop("_last")


def board_walk(
    targets: DataFrame,
    pages: DataFrame,
    checkpoints: DataFrame,
    start_page: int | None = None,
    max_pages: int | None = None,
    resume: bool = True,
    order: str = "page_id",
) -> dict[str, DataFrame]:
    """Walk every board of ``targets`` (site, board, url) over ``pages`` (url, fetched, next_url, order).

    ``pages`` (site, board, page, url, fetched, work): the pages of each walk in
    their order; ``work`` is ``skip`` for those before the start page, which are
    only followed, else ``crawl``. ``ends`` (site, board, action, start_page,
    stop_page, stop_reason, cycle_page, status, next_page): where and why the walk
    ended, the page a cycle leads back to, and the page to go on from. A completed
    board is not walked and has no end. A run from a checkpoint counts the pages
    before it towards ``max_pages``, an explicit start page does not.
    """
    keys = ["site", "board"]
    wanted = F.lit(None).cast("int") if start_page is None else F.lit(start_page)
    points = resume_points(targets, checkpoints, F.lit("bbs"), wanted, resume=resume)
    resumed = F.col("action") == "resume"
    last = F.when(resumed, F.lit(max_pages)).otherwise(F.col("start_page") + F.lit(max_pages) - 1).cast("long")
    points = materialized(points.where("action <> 'skip_completed'").withColumn("last_page", last), "targets")
    links = materialized(single_links(pages, order), "links")
    reached = follow(points, links, keys, "last_page")
    known = reached.join(links, "url", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))
    walked = materialized(known.join(points.drop("url"), keys), "walk")
    ends = walked.groupBy(*keys).agg(F.max_by(F.struct("page", "fetched", "next_url", "last_page", "action", "start_page"), "page").alias("e")).select(*keys, "e.*")
    # The last page's link leads nowhere, beyond the limit, or back.
    back = walked.select(*keys, F.col("url").alias("next_url"), F.col("page").alias("cycle_page"))
    reason = (
        F.when(~F.col("fetched"), FETCH_FAILED).when(F.col("next_url").isNull(), NO_NEXT)
        .when(F.col("page") >= F.col("last_page"), MAX_PAGES).otherwise(CYCLE)
    )
    ends = ends.join(back, [*keys, "next_url"], "left").select(
        *keys, "action", "start_page", F.col("page").alias("stop_page"), reason.alias("stop_reason"),
        F.when(reason == CYCLE, F.col("cycle_page")).alias("cycle_page"),
        F.when(reason == FETCH_FAILED, ERROR).otherwise(COMPLETED).alias("status"),
        (F.col("page") + F.col("fetched").cast("int")).alias("next_page"),
    )
    work = F.when(F.col("page") < F.col("start_page"), "skip").otherwise("crawl")
    return {"pages": walked.select(*keys, "page", "url", "fetched", work.alias("work")), "ends": ends}


def walk_checkpoints(walk: dict[str, DataFrame], listed: DataFrame) -> DataFrame:
    """The checkpoint rows a walk leaves (see ``state.save_checkpoints``).

    ``listed`` has (site, board, page, pos, thread_id, thread_url), all entries of
    the pages crawled. The last thread is that of the last page that has any.
    """
    keys = ["site", "board"]
    place = F.struct("page", "pos")
    last = listed.groupBy(*keys).agg(
        F.max_by("thread_id", place).alias("last_thread_id"), F.max_by("thread_url", place).alias("last_thread_url"), F.count("*").alias("listed"))
    pages = F.greatest(F.col("next_page") - F.col("start_page"), F.lit(0)).cast("bigint")
    counters = F.create_map(F.lit("pages"), pages, F.lit("listed"), F.coalesce("listed", F.lit(0)).cast("bigint"))
    return walk["ends"].join(last, keys, "left").select(
        *keys, F.col("next_page").cast("int").alias("current_page"), "last_thread_id", "last_thread_url", "status", counters.alias("stats"),
        F.when(F.col("status") == ERROR, F.col("stop_reason")).alias("last_error"))
