"""Boards walked by the next-page links of their own pages.

The pages are given addresses of seven boards and a pager: a page links to the one
seven numbers on, every 13th to a page that was never fetched, every 17th back to
the board's first page, and every 11th to none. Each board begins with its first
page, and every fifth page begins a board of its own; those of every tenth page have
a checkpoint, completed for every thirtieth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators import extract as E
from harrow.operators import walk
from harrow.operators.dom import step
from harrow.plans.registry import Tables, query
from harrow.session import materialized

PAGER = [[step("a", attrs=[("rel", "=", "next")])]]

_WALK = """
p AS (SELECT page_id, 'https://board.example/b' || page_id % 7 || '/' AS base FROM pages),
links AS (
  SELECT page_id, base AS site, base || page_id AS url, CASE WHEN page_id % 11 = 10 THEN NULL WHEN page_id % 13 = 12 THEN base || 'gone/' || page_id
    WHEN page_id % 17 = 16 THEN base || page_id % 7 ELSE base || (page_id + 7) END AS next_url FROM p),
points AS (
  SELECT site, 'all' AS board, arg_min(url, page_id) AS url, 1 AS start_page, false AS resumed FROM links GROUP BY site
  UNION ALL
  SELECT site, CAST(page_id AS VARCHAR), url, CASE WHEN page_id % 2 = 0 THEN 3 ELSE 1 END, page_id % 2 = 0 FROM links WHERE page_id % 5 = 0 AND page_id % 30 <> 0),
limits AS (SELECT *, CASE WHEN resumed THEN 9 ELSE start_page + 8 END AS last_page FROM points),
walk AS (
  SELECT site, board, url, 1 AS page, [url] AS path FROM limits
  UNION ALL
  SELECT w.site, w.board, n.next_url, w.page + 1, list_append(w.path, n.next_url)
  FROM walk w JOIN links n ON n.url = w.url JOIN limits t ON t.site = w.site AND t.board = w.board
  WHERE n.next_url IS NOT NULL AND w.page < t.last_page AND NOT list_contains(w.path, n.next_url)),
walked AS (
  SELECT w.site, w.board, w.page, w.url, w.path, n.url IS NOT NULL AS fetched, n.next_url, t.start_page, t.resumed, t.last_page
  FROM walk w JOIN limits t ON t.site = w.site AND t.board = w.board LEFT JOIN links n ON n.url = w.url)"""


def boards(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pages of the boards (page_id, url, html), the boards (site, board, url) and their checkpoints."""
    base = F.concat(F.lit("https://board.example/b"), F.col("page_id") % 7, F.lit("/"))
    number = (
        F.when(F.col("page_id") % 11 == 10, None).when(F.col("page_id") % 13 == 12, F.concat(F.lit("gone/"), "page_id"))
        .when(F.col("page_id") % 17 == 16, (F.col("page_id") % 7).cast("string")).otherwise((F.col("page_id") + 7).cast("string"))
    )
    link = F.concat(F.lit("<p><a REL=next href='/b"), F.col("page_id") % 7, F.lit("/"), number, F.lit("'>on</a></p>"))
    pages = t.pages.select("page_id", F.concat(base, "page_id").alias("url"), F.concat("html", F.coalesce(link, F.lit(""))).alias("html"))
    named = t.pages.select("page_id", base.alias("site"), F.concat(base, "page_id").alias("url"), F.col("page_id").cast("string").alias("board"))
    targets = named.groupBy("site").agg(F.min_by("url", "page_id").alias("url")).select("site", F.lit("all").alias("board"), "url").unionByName(
        named.where("page_id % 5 = 0").select("site", "board", "url"))
    checkpoints = named.where("page_id % 10 = 0").select(
        "site", "board", F.lit(3).alias("current_page"), F.when(F.col("page_id") % 30 == 0, "completed").otherwise("running").alias("status"))
    return pages, targets, checkpoints


def _walk(t: Tables) -> dict[str, DataFrame]:
    """Links come from the parsed pages."""
    pages, targets, checkpoints = boards(t)
    read = materialized(t.parsed(pages).select(
        "page_id", "url", F.col("nodes").isNotNull().alias("fetched"), E.next_page(F.col("nodes"), F.col("url"), PAGER).alias("next_url")), "read-pages")
    return walk.board_walk(targets, read, checkpoints, max_pages=9)


@query(f"""WITH RECURSIVE {_WALK}
SELECT site, board, CAST(page AS BIGINT) AS page, url, fetched, CASE WHEN page < start_page THEN 'skip' ELSE 'crawl' END AS work FROM walked""")
def t3_board_walk(t: Tables) -> DataFrame:
    return _walk(t)["pages"]


@query(f"""WITH RECURSIVE {_WALK}, lasts AS (SELECT * FROM walked QUALIFY row_number() OVER (PARTITION BY site, board ORDER BY page DESC) = 1)
SELECT site, board, CASE WHEN resumed THEN 'resume' ELSE 'start' END AS action, start_page, CAST(page AS BIGINT) AS stop_page,
  CASE WHEN NOT fetched THEN 'fetch_failed' WHEN next_url IS NULL THEN 'no_next_page' WHEN page >= last_page THEN 'max_pages' ELSE 'cycle' END AS stop_reason,
  CASE WHEN fetched AND next_url IS NOT NULL AND page < last_page THEN CAST(list_position(path, next_url) AS BIGINT) END AS cycle_page,
  CASE WHEN fetched THEN 'completed' ELSE 'error' END AS status, CAST(page + CASE WHEN fetched THEN 1 ELSE 0 END AS BIGINT) AS next_page
FROM lasts""")
def t3_walk_ends(t: Tables) -> DataFrame:
    return _walk(t)["ends"]
