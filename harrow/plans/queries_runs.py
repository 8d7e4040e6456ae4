"""Whole crawl runs over the page table: boards by their pagers, news sites by page number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.operators import state
from harrow.operators.extract import one
from harrow.plans import queries_walk as boards
from harrow.plans import runs, sql
from harrow.plans.queries_extract import _NAV_TEXT, NAV_ITEMS
from harrow.plans.queries_state import _NOW, now, shaped
from harrow.plans.registry import Tables, query, spread

_FIRST = f"regexp_extract(html, '{sql.LINK}', 1)"
_TITLED = f"""titled AS (
  SELECT page_id, unnest(l) AS href, unnest(t) AS title, generate_subscripts(l, 1) AS pos
  FROM (SELECT page_id, regexp_extract_all(html, '{sql.LINK}', 1) AS l, {_NAV_TEXT} AS t FROM pages))"""
_THREAD = "'https://board.example' || href"

_BOARD = f"""{boards._WALK}, {_TITLED},
stored AS (SELECT DISTINCT {sql.thread_id(f"'https://board.example' || {_FIRST}")} AS thread_id FROM pages WHERE page_id % 9 = 4),
found AS (SELECT DISTINCT 'https://board.example' || {_FIRST} AS url FROM pages WHERE page_id % 3 = 0),
every AS (
  SELECT w.site, w.board, w.page, t.pos, {sql.strip(sql.unescape('t.title'))} AS title, {_THREAD} AS thread_url, {sql.thread_id(_THREAD)} AS thread_id
  FROM walked w JOIN links n ON n.url = w.url JOIN titled t ON t.page_id = n.page_id WHERE w.page >= w.start_page),
listed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY site, board, page, pos) AS rn FROM every)
  WHERE rn = 1 AND thread_id NOT IN (SELECT thread_id FROM stored)),
ends AS (SELECT * FROM walked QUALIFY row_number() OVER (PARTITION BY site, board ORDER BY page DESC) = 1),
counts AS (
  SELECT site, board, count(*) AS new_threads, count(*) FILTER (thread_url IN (SELECT url FROM found)) AS saved FROM listed GROUP BY 1, 2)"""


def _board_run(t: Tables) -> dict[str, DataFrame]:
    pages, targets, checkpoints = boards.boards(t)
    home = F.lit("https://board.example")
    first = F.concat(home, F.regexp_extract("html", sql.LINK, 1))
    threads = spread(t.pages).where("page_id % 3 = 0").select("page_id", first.alias("url"), "html")
    old = t.pages.where("page_id % 9 = 4").select(U.thread_id(first).alias("thread_id")).distinct().withColumn("title", F.lit("old"))
    rules = t.spark.createDataFrame(
        [("custom", "https://board.example", "nav li", "a", "nav img", "a[rel='next']")],
        "forum_type string, base_url string, thread_list_selector string, thread_link_selector string, image_selector string, next_page_selector string")
    return runs.board_run(spread(pages), threads, targets, rules, shaped(old, state.THREADS), shaped(checkpoints, state.CHECKPOINTS), now(), max_pages=9)


@query(f"""WITH RECURSIVE {_BOARD}
SELECT thread_id, title, thread_url AS url, board, TIMESTAMP '{_NOW}' AS updated_at FROM listed WHERE thread_url IN (SELECT url FROM found)
UNION ALL SELECT thread_id, 'old', NULL, NULL, NULL FROM stored""")
def run_board_threads(t: Tables) -> DataFrame:
    return _board_run(t)["threads"].select("thread_id", "title", "url", "board", "updated_at")


@query(f"""WITH RECURSIVE {_BOARD}, lasts AS (
  SELECT site, board, arg_max(thread_id, page * 1000 + pos) AS last_thread_id FROM every GROUP BY 1, 2)
SELECT e.site, e.board, CAST(e.page + CASE WHEN e.fetched THEN 1 ELSE 0 END AS INTEGER) AS current_page, l.last_thread_id,
  CASE WHEN e.fetched THEN 'completed' ELSE 'error' END AS status, CASE WHEN NOT e.fetched THEN 'fetch_failed' END AS last_error,
  CASE WHEN e.fetched THEN coalesce(saved, 0) END AS total_crawled, CASE WHEN e.fetched THEN coalesce(new_threads - saved, 0) END AS total_failed,
  CASE WHEN NOT e.fetched THEN 1 END AS error_count
FROM ends e LEFT JOIN lasts l ON l.site = e.site AND l.board = e.board LEFT JOIN counts c ON c.site = e.site AND c.board = e.board
UNION ALL SELECT site, CAST(page_id AS VARCHAR), 3, NULL, 'completed', NULL, NULL, NULL, NULL FROM links WHERE page_id % 30 = 0""")
def run_board_checkpoints(t: Tables) -> DataFrame:
    count = lambda name: F.try_element_at("stats", F.lit(name)).alias(name)
    return _board_run(t)["checkpoints"].select(
        "site", "board", "current_page", "last_thread_id", "status", "last_error", count("total_crawled"), count("total_failed"), count("error_count"))


_NEWS_RULES = {"article": NAV_ITEMS, "title": one("a")}
_SITE = "'n' || page_id % 5"
_NEWS = f"""{_TITLED},
p AS (SELECT page_id, {_SITE} AS site, page_id // 5 + 1 AS page, page_id % 53 <> 52 AS fetched, page_id % 53 <> 52 AND page_id % 41 <> 40 AS has_more FROM pages),
points AS (SELECT * FROM (VALUES ('n0', 'start', 1), ('n1', 'resume', 5), ('n4', 'resume', 7)) v(site, action, start_page)),
every AS (
  SELECT p.site, p.page, t.pos, {sql.article_id('href')} AS article_id, 'https://' || p.site || '.example' || href AS article_url
  FROM p JOIN titled t USING (page_id) WHERE p.fetched),
e AS (SELECT every.*, action, start_page FROM every JOIN points USING (site) WHERE page >= start_page),
done AS (SELECT DISTINCT {sql.article_id(_FIRST)} AS article_id FROM pages WHERE page_id % 16 = 3),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY site, article_id ORDER BY page, pos) = 1 AND article_id NOT IN (SELECT article_id FROM done)
    AND NOT (action = 'resume' AND EXISTS (SELECT 1 FROM every s WHERE s.site = e.site AND s.site = 'n1' AND s.page <= 4 AND s.article_id = e.article_id)) AS is_new
  FROM e),
counts AS (
  SELECT p.site, p.page, p.fetched, p.has_more, s.start_page, count(m.article_id) AS n_articles, count(*) FILTER (m.is_new) AS n_new
  FROM p JOIN points s ON s.site = p.site AND p.page >= s.start_page LEFT JOIN marked m ON m.site = p.site AND m.page = p.page GROUP BY ALL),
streaks AS (
  SELECT *, page - coalesce(max(CASE WHEN n_new > 0 THEN page END) OVER (PARTITION BY site ORDER BY page ROWS UNBOUNDED PRECEDING), start_page - 1) AS streak
  FROM counts),
stops AS (
  SELECT site, page, CASE WHEN NOT fetched THEN 1 WHEN n_articles = 0 THEN 2 WHEN streak >= 10 THEN 3 WHEN page >= 20 THEN 4 WHEN NOT has_more THEN 5 END AS why FROM streaks
  UNION ALL SELECT site, page + 1, 1 FROM counts c WHERE NOT EXISTS (SELECT 1 FROM counts d WHERE d.site = c.site AND d.page = c.page + 1)
  UNION ALL SELECT site, start_page, 1 FROM points s WHERE NOT EXISTS (SELECT 1 FROM counts d WHERE d.site = s.site AND d.page = s.start_page)),
extent AS (
  SELECT site, min(page * 10 + why) // 10 AS stop_page, min(page * 10 + why) % 10 AS why FROM stops WHERE why IS NOT NULL GROUP BY 1),
fresh AS (SELECT m.* FROM marked m JOIN extent x ON x.site = m.site AND m.page <= x.stop_page WHERE is_new),
found AS (SELECT DISTINCT 'https://' || {_SITE} || '.example' || {_FIRST} AS url FROM pages WHERE page_id % 2 = 0)"""


def _news_run(t: Tables) -> dict[str, DataFrame]:
    n, page = F.col("page_id"), F.floor(F.col("page_id") / 5) + 1
    site = F.concat(F.lit("n"), n % 5)
    home = F.concat(F.lit("https://"), site, F.lit(".example"))
    first = F.regexp_extract("html", sql.LINK, 1)
    shown = F.when(n % 53 != 52, F.concat("html", F.when(n % 41 != 40, '<a class="load-more">x</a>').otherwise("")))
    scan = spread(t.pages)
    lists = scan.select(site.alias("site"), page.alias("page"), F.concat(home, F.lit("/?page="), page).alias("url"), shown.alias("html"))
    articles = scan.where(n % 2 == 0).select("page_id", F.concat(home, first).alias("url"), "html")
    stored = t.pages.where(n % 8 == 3).groupBy(U.article_id(first).alias("article_id")).agg(F.max(n % 16 == 3).alias("images_downloaded"))
    early = t.pages.where((n % 5 == 1) & (page <= 4) & (n % 53 != 52)).select(F.explode(F.regexp_extract_all("html", F.lit(sql.LINK), F.lit(1))).alias("href"))
    seen = early.select(F.lit("n1").alias("site"), F.lit("news").alias("board"), U.article_id(F.col("href")).alias("article_id"))
    checkpoints = t.spark.createDataFrame(
        [("n1", "news", 5, "running", "100", "200"), ("n2", "news", 3, "completed", None, None), ("n3", "news", 99, "running", None, None), ("n4", "news", 7, "error", "7", None)],
        "site string, board string, current_page int, status string, min_article_id string, max_article_id string")
    return runs.news_run(lists, articles, shaped(stored, state.ARTICLES), seen, shaped(checkpoints, state.CHECKPOINTS), now(), F.lit("img"), _NEWS_RULES, max_pages=20)


@query(f"""WITH {_NEWS}
SELECT site, CAST(page AS BIGINT) AS page, CAST(pos - 1 AS INTEGER) AS pos, CASE WHEN article_url IN (SELECT url FROM found)
  THEN {sql.article_id('article_url')} ELSE article_id END AS article_id, article_url, article_url IN (SELECT url FROM found) AS has_page FROM fresh""")
def run_news_articles(t: Tables) -> DataFrame:
    """Of an article whose page was read, the id is that of the page."""
    run = _news_run(t)
    columns = ["site", "page", "pos", "article_id", "article_url"]
    read = run["articles"].select(*columns, F.lit(True).alias("has_page"))
    return read.unionByName(run["failed"].select(*columns, F.lit(False).alias("has_page")))


@query(f"""WITH {_NEWS}, lasts AS (
  SELECT site, arg_max(article_id, page * 1000 + pos) AS last_thread_id, count(*) AS found FROM fresh GROUP BY 1),
numbers AS (SELECT site, min(TRY_CAST(article_id AS HUGEINT)) AS least, max(TRY_CAST(article_id AS HUGEINT)) AS most FROM fresh GROUP BY 1)
SELECT x.site, CAST(stop_page + CASE WHEN why <= 2 THEN 0 ELSE 1 END AS INTEGER) AS current_page, CASE WHEN why IN (3, 4) THEN 'running' ELSE 'completed' END AS status,
  last_thread_id, CASE WHEN why IN (3, 4) THEN coalesce(found, 0) END AS articles_found, CASE WHEN why NOT IN (3, 4) THEN coalesce(found, 0) END AS total_articles,
  CAST(least(least, CASE x.site WHEN 'n1' THEN 100 WHEN 'n4' THEN 7 END) AS VARCHAR) AS min_article_id,
  CAST(greatest(most, CASE x.site WHEN 'n1' THEN 200 END) AS VARCHAR) AS max_article_id
FROM extent x LEFT JOIN lasts USING (site) LEFT JOIN numbers USING (site)
UNION ALL SELECT * FROM (VALUES ('n2', 3, 'completed', NULL, NULL, NULL, NULL, NULL), ('n3', 99, 'running', NULL, NULL, NULL, NULL, NULL))""")
def run_news_checkpoints(t: Tables) -> DataFrame:
    count = lambda name: F.try_element_at("stats", F.lit(name)).alias(name)
    return _news_run(t)["checkpoints"].select(
        "site", "current_page", "status", "last_thread_id", count("articles_found"), count("total_articles"), "min_article_id", "max_article_id")
