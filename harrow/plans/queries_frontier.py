"""What is new, how far a crawl goes, where it resumes.

Events play list entries: a site is a group of users, a page two hours of the
log, the article id the number in ``props``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.operators import frontier
from harrow.operators.dom import flat_links, page_links
from harrow.plans import sql
from harrow.plans.registry import Tables, query
from harrow.session import materialized

FIRST_HOUR = "2024-01-01 00:00:00"


def entries(t: Tables) -> DataFrame:
    hours = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit(FIRST_HOUR).cast("timestamp"))) / 7200
    return t.events.select(
        F.concat(F.lit("site"), F.col("user_id") % 3).alias("site"),
        (F.floor(hours) + 1).alias("page"),
        F.col("event_id").alias("pos"),
        F.get_json_object("props", "$.k").alias("article_id"),
        F.col("event_type"),
    )


ENTRIES = f"""entries AS (
  SELECT 'site' || user_id % 3 AS site, event_id AS pos,
    props->>'$.k' AS article_id, event_type, CAST(floor((epoch(ts) - epoch(TIMESTAMP '{FIRST_HOUR}')) / 7200) AS BIGINT) + 1 AS page
  FROM events),
marked AS (SELECT site, page, pos, article_id, event_type,
  row_number() OVER (PARTITION BY site, article_id ORDER BY page, pos) = 1 AS is_new FROM entries),
counts AS (SELECT site, page, count(*) AS n_articles, count(*) FILTER (is_new) AS n_new FROM marked GROUP BY 1, 2),
streaks AS (SELECT *, page - coalesce(max(CASE WHEN n_new > 0 THEN page END)
  OVER (PARTITION BY site ORDER BY page ROWS UNBOUNDED PRECEDING), 0) AS streak FROM counts)"""


@query(f"WITH {ENTRIES} SELECT site, page, pos, article_id, is_new FROM marked")
def w1_first_seen(t: Tables) -> DataFrame:
    return frontier.mark_first_seen(entries(t).drop("event_type"))


@query(f"""WITH {ENTRIES}, known AS (SELECT DISTINCT site, article_id FROM entries WHERE event_type = 'error' AND page < 30)
SELECT site, page, pos, article_id, is_new AND NOT EXISTS (
  SELECT 1 FROM known k WHERE k.site = marked.site AND k.article_id = marked.article_id) AS is_new
FROM marked""")
def w1_first_seen_unknown(t: Tables) -> DataFrame:
    all_entries = entries(t)
    known = all_entries.where("event_type = 'error' AND page < 30")
    return frontier.mark_first_seen(all_entries.drop("event_type"), known)


def _counts(t: Tables) -> DataFrame:
    return frontier.page_counts(entries(t))


@query(f"WITH {ENTRIES} SELECT site, page, n_articles, n_new, streak FROM streaks")
def w2_no_new_streak(t: Tables) -> DataFrame:
    return frontier.no_new_streak(_counts(t), block=64)


_EXTENT = f"""{ENTRIES},
stops AS (
  SELECT site, page, CASE WHEN n_articles = 0 THEN 2 WHEN streak >= 10 THEN 3 WHEN page >= 200 THEN 4
    WHEN n_articles % 23 = 0 THEN 5 END AS why FROM streaks
  UNION ALL SELECT site, page + 1, 1 FROM counts c WHERE NOT EXISTS (
    SELECT 1 FROM counts d WHERE d.site = c.site AND d.page = c.page + 1)
  UNION ALL SELECT DISTINCT site, 1, 1 FROM counts c WHERE NOT EXISTS (
    SELECT 1 FROM counts d WHERE d.site = c.site AND d.page = 1)),
best AS (SELECT site, min(page * 10 + why) AS b FROM stops WHERE why IS NOT NULL GROUP BY 1),
extent AS (SELECT site, b // 10 AS stop_page,
  ['fetch_failed', 'no_articles', 'no_new_articles', 'max_pages', 'no_load_more'][b % 10] AS stop_reason,
  CASE WHEN b % 10 IN (3, 4) THEN 'running' ELSE 'completed' END AS status FROM best)"""


def _extent(t: Tables, counts: DataFrame) -> DataFrame:
    pages = counts.withColumn("fetched", F.lit(True)).withColumn("has_more", F.col("n_articles") % 23 != 0)
    return frontier.crawl_extent(pages, max_pages=200, block=64)


@query(f"WITH {_EXTENT} SELECT * FROM extent")
def w3_crawl_extent(t: Tables) -> DataFrame:
    return _extent(t, materialized(_counts(t), "page-counts"))


@query(f"""WITH {ENTRIES},
stops AS (
  SELECT site, page, CASE WHEN page >= 5 + 30 - 1 THEN 4 WHEN n_articles % 23 = 0 THEN 5 END AS why FROM counts WHERE page >= 5
  UNION ALL SELECT site, page + 1, 1 FROM counts c WHERE page >= 5 AND NOT EXISTS (
    SELECT 1 FROM counts d WHERE d.site = c.site AND d.page = c.page + 1)
  UNION ALL SELECT DISTINCT site, 5, 1 FROM counts c WHERE NOT EXISTS (
    SELECT 1 FROM counts d WHERE d.site = c.site AND d.page = 5)),
best AS (SELECT site, min(page * 10 + why) AS b FROM stops WHERE why IS NOT NULL GROUP BY 1)
SELECT site, b // 10 AS stop_page, CASE b % 10 WHEN 1 THEN 'fetch_failed' WHEN 4 THEN 'max_pages' ELSE 'no_load_more' END AS stop_reason,
  CASE b % 10 WHEN 1 THEN 'error' ELSE 'completed' END AS status FROM best""")
def w3_board_extent(t: Tables) -> DataFrame:
    counts = materialized(_counts(t), "page-counts")
    pages = counts.withColumn("fetched", F.lit(True)).withColumn("has_more", F.col("n_articles") % 23 != 0)
    return frontier.crawl_extent(pages, start_page=5, max_pages=30, crawler_type="bbs", block=64)


@query(f"WITH {_EXTENT} SELECT site, page, n_articles, n_new FROM counts JOIN extent USING (site) WHERE page <= stop_page")
def w3_crawled_pages(t: Tables) -> DataFrame:
    counts = materialized(_counts(t), "page-counts")
    return frontier.crawled_pages(counts, materialized(_extent(t, counts), "extent"))


@query(f"WITH {sql.LINKS} SELECT page_id, href AS image_url, CAST(pos AS INTEGER) AS image_index FROM links")
def w4_image_index(t: Tables) -> DataFrame:
    return frontier.image_index(page_links(t.pages, "page_id").withColumnRenamed("hrefs", "images"))


@query(f"""WITH {sql.LINKS}
SELECT url AS site, page_id AS page, max_by({sql.thread_id('href')}, pos) AS last_id, max_by(href, pos) AS last_url
FROM links GROUP BY 1, 2""")
def w5_last_of_page(t: Tables) -> DataFrame:
    listed = flat_links(t.pages, "page_id", "url").select(
        F.col("url").alias("site"), F.col("page_id").alias("page"), "pos",
        U.thread_id(F.col("href")).alias("article_id"), F.col("href").alias("article_url"),
    )
    return frontier.last_of_page(listed)


@query(f"""WITH {ENTRIES}, lasts AS (
  SELECT site, page, max_by(article_id, pos) FILTER (is_new) AS last_id, max_by('/' || article_id || '?p=' || pos, pos) FILTER (is_new) AS last_url
  FROM marked GROUP BY 1, 2)
SELECT site, page, last_value(last_id IGNORE NULLS) OVER w AS last_new_id, last_value(last_url IGNORE NULLS) OVER w AS last_new_url
FROM lasts WINDOW w AS (PARTITION BY site ORDER BY page ROWS UNBOUNDED PRECEDING)""")
def w5_last_new_so_far(t: Tables) -> DataFrame:
    listed = entries(t).withColumn("article_url", F.concat(F.lit("/"), "article_id", F.lit("?p="), "pos"))
    return frontier.last_new_so_far(listed, block=64)


@query("""
WITH o AS (SELECT o_orderstatus, o_orderkey, o_custkey, greatest(max(o_custkey) OVER (
  PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100) AS max_before FROM orders)
SELECT *, o_custkey > max_before AS beyond_max FROM o""")
def w6_beyond_max(t: Tables) -> DataFrame:
    ordered = t.orders.select("o_orderstatus", "o_orderkey", "o_custkey")
    marked = frontier.beyond_max(ordered, ["o_orderstatus"], "o_orderkey", [], "o_custkey", F.lit(100), block=4096)
    return marked.withColumn("max_before", F.col("max_before").cast("bigint"))


@query("""
WITH o AS (SELECT o_orderkey, (CAST(o_custkey AS HUGEINT) - 700) * 1000000000000000000000 + o_orderkey AS id FROM orders),
b AS (SELECT *, max(id) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
SELECT o_orderkey, CAST(before AS VARCHAR) AS max_before, coalesce(id > before, false) AS beyond_max FROM b""")
def w6_beyond_max_long(t: Tables) -> DataFrame:
    """Ids of more than twenty digits, some of them negative."""
    number = (F.col("o_custkey").cast("decimal(10,0)") - 700) * F.lit("1000000000000000000000").cast("decimal(22,0)") + F.col("o_orderkey")
    ordered = t.orders.select("o_orderkey", number.cast("string").alias("id"), F.lit("all").alias("site"))
    return frontier.beyond_max(ordered, ["site"], "o_orderkey", [], "id", block=4096).select("o_orderkey", "max_before", "beyond_max")


@query(f"""WITH {ENTRIES}, starts AS (SELECT site, max(page) // 2 AS start_page FROM counts GROUP BY 1)
SELECT site, page, n_articles, n_new, start_page FROM counts JOIN starts USING (site)
WHERE page >= start_page AND CASE WHEN CAST(replace(site, 'site', '') AS INTEGER) % 2 = 0
  THEN page <= 25 ELSE page < start_page + 25 END""")
def t3_page_limit(t: Tables) -> DataFrame:
    counts = _counts(t)
    starts = counts.groupBy("site").agg(F.floor(F.max("page") / 2).alias("start_page"))
    # Sites of even number go on from a checkpoint, the others from a page that was asked for.
    even = F.replace("site", F.lit("site"), F.lit("")).cast("int") % 2 == 0
    return frontier.first_pages(counts.join(starts, "site"), 25, resumed=even)


@query(f"""WITH {ENTRIES}
SELECT DISTINCT site, article_id FROM entries""")
def u2_seen_union(t: Tables) -> DataFrame:
    ids = entries(t)
    old = F.col("event_type").isin("view", "error")
    return frontier.seen_union(ids.where(old).select("site", "article_id"), ids.where(~old).select("site", "article_id"))


@query("""
WITH targets AS (SELECT DISTINCT 'site' || user_id % 50 AS site, event_type AS board FROM events),
points AS (SELECT CASE WHEN user_id % 3 = 1 THEN 'old' ELSE 'site' END || user_id % 50 AS site, event_type AS board, CAST(max(event_id) % 40 AS INTEGER) AS current_page,
  CASE WHEN max(event_id) % 4 = 0 THEN 'completed' WHEN max(event_id) % 4 = 1 THEN 'error' ELSE 'running' END AS status
  FROM events GROUP BY 1, 2),
j AS (SELECT t.site, t.board, p.site IS NOT NULL AND t.board <> 'click' AS usable, current_page, status
  FROM targets t LEFT JOIN points p ON p.site = t.site AND p.board = t.board)
SELECT site, board,
  CASE WHEN usable THEN current_page WHEN board = 'click' THEN 7 ELSE 1 END AS start_page,
  CASE WHEN usable AND status = 'completed' THEN 'skip_completed'
    WHEN usable AND board = 'view' AND current_page > 20 THEN 'skip_over_limit'
    WHEN usable THEN 'resume' ELSE 'start' END AS action
FROM j""")
def c6_resume_points(t: Tables) -> DataFrame:
    site = F.concat(F.lit("site"), F.col("user_id") % 50).alias("site")
    board = F.col("event_type").alias("board")
    last = F.max("event_id")
    targets = t.events.select(site, board).distinct()
    stored = F.concat(F.when(F.col("user_id") % 3 == 1, "old").otherwise("site"), F.col("user_id") % 50).alias("site")
    checkpoints = t.events.groupBy(stored, board).agg(
        (last % 40).cast("int").alias("current_page"),
        F.when(last % 4 == 0, "completed").when(last % 4 == 1, "error").otherwise("running").alias("status"),
    )
    kind = F.when(F.col("board") == "view", "news").otherwise("bbs")
    return frontier.resume_points(targets, checkpoints, kind, F.when(F.col("board") == "click", 7), max_pages=20)
