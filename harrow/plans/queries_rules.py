"""Settings files of sites, written as JSON text from the hosts of the page table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.plans import sql
from harrow.plans.registry import Tables, query
from harrow.sources import rules as R

# Five kinds of files by the first page of the host: a board list beside plain URLs, a news
# site with objects and URLs mixed, an old news file, an old forum file, and a broken one.
_HOSTS = f"""hosts AS (SELECT {sql.host('url')} AS site, min(page_id) AS n FROM pages GROUP BY 1),
kinds AS (SELECT *, 'https://' || site AS base, n % 5 AS kind FROM hosts)"""


def _files(t: Tables) -> DataFrame:
    """(file, site, is_good, value) as ``read_site_files`` gives them."""
    hosts = t.pages.groupBy(U.host(F.col("url")).alias("site")).agg(F.min("page_id").alias("n"))
    base = F.concat(F.lit("https://"), "site")
    n = F.col("n").cast("string")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    value = (
        F.when(F.col("n") % 5 == 0, text(
            '{"name": "Site ', n, '", "crawler_type": "bbs", "forum_type": "phpbb", "base_url": "', base,
            '", "selectors": {"thread_list": "li.row"}, "boards": [{"name": "B', n, '", "url": "', base, '/b"}], "urls": ["', base, '/t/', n, '"]}'))
        .when(F.col("n") % 5 == 1, text(
            '{"crawler_type": "news", "base_url": "', base, '", "urls": [{"type": "board", "name": "front", "url": "', base, '/"}, "', base,
            '/a", {"type": "article", "name": "one", "url": "', base, '/a/', n, '"}]}'))
        .when(F.col("n") % 5 == 2, text('{"forum_type": "news", "news_urls": ["', base, '/n"]}'))
        .when(F.col("n") % 5 == 3, text(
            '{"crawler_type": "bbs", "name": "Old", "boards": [{"name": "L", "url": "', base, '/l"}], "example_threads": [{"type": "thread", "url": "',
            base, '/x"}, "', base, '/y"]}'))
        .otherwise(text('{"name": "', n))
    )
    return hosts.select(
        F.concat("site", F.lit(".json")).alias("file"), "site", F.try_parse_json(value).isNotNull().alias("is_good"), value.alias("value"))


def _rules(t: Tables) -> DataFrame:
    return R.site_rules(R.good_files(_files(t)))


@query(f"WITH {_HOSTS} SELECT site || '.json' AS file, '{{\"name\": \"' || n AS value FROM kinds WHERE kind = 4")
def s2_bad_files(t: Tables) -> DataFrame:
    return R.bad_files(_files(t))


@query(f"""WITH {_HOSTS}
SELECT site, CASE kind WHEN 0 THEN 'Site ' || n WHEN 3 THEN 'Old' ELSE 'Unknown Forum' END AS name,
  CASE WHEN kind IN (0, 3) THEN 'bbs' ELSE 'news' END AS crawler_type,
  CASE kind WHEN 0 THEN 'phpbb' WHEN 2 THEN 'news' ELSE 'custom' END AS forum_type,
  CASE WHEN kind < 2 THEN base ELSE '' END AS base_url, CASE kind WHEN 0 THEN 'li.row' ELSE '' END AS thread_list_selector,
  '' AS image_selector, CAST(CASE kind WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS INTEGER) AS n_targets
FROM kinds WHERE kind < 4""")
def s3_site_rules(t: Tables) -> DataFrame:
    return _rules(t).select(
        "site", "name", "crawler_type", "forum_type", "base_url", "thread_list_selector", "image_selector", F.size("targets").alias("n_targets"))


# Boards of old files come first, then plain URLs, then objects, where the file has no board of its own.
_TARGETS = """targets AS (
  SELECT site, 0 AS pos, 'board' AS type, 'B' || n AS name, base || '/b' AS url FROM kinds WHERE kind = 0
  UNION ALL SELECT site, 1, NULL, NULL, base || '/t/' || n FROM kinds WHERE kind = 0
  UNION ALL SELECT site, 0, 'board', 'front', base || '/' FROM kinds WHERE kind = 1
  UNION ALL SELECT site, 1, NULL, NULL, base || '/a' FROM kinds WHERE kind = 1
  UNION ALL SELECT site, 2, 'article', 'one', base || '/a/' || n FROM kinds WHERE kind = 1
  UNION ALL SELECT site, 0, NULL, NULL, base || '/n' FROM kinds WHERE kind = 2
  UNION ALL SELECT site, 0, 'board', 'L', base || '/l' FROM kinds WHERE kind = 3
  UNION ALL SELECT site, 1, NULL, NULL, base || '/y' FROM kinds WHERE kind = 3
  UNION ALL SELECT site, 2, 'thread', NULL, base || '/x' FROM kinds WHERE kind = 3)"""


@query(f"WITH {_HOSTS}, {_TARGETS} SELECT site, CAST(pos AS INTEGER) AS pos, name, url FROM targets WHERE type = 'board'")
def s4_boards(t: Tables) -> DataFrame:
    return R.boards(_rules(t))


@query(f"WITH {_HOSTS}, {_TARGETS} SELECT site, CAST(pos AS INTEGER) AS pos, name, url FROM targets WHERE type IS NULL OR type <> 'board'")
def s4_page_entries(t: Tables) -> DataFrame:
    return R.page_entries(_rules(t))


@query(f"WITH {_HOSTS}, {_TARGETS} SELECT site, CAST(pos AS INTEGER) AS pos, type, name, url FROM targets")
def u1_target_union(t: Tables) -> DataFrame:
    return R.targets(_rules(t))


@query(f"""WITH {_HOSTS}
SELECT site, CASE WHEN kind < 4 THEN 'file' WHEN n % 2 = 0 THEN 'preset' ELSE 'detected' END AS origin FROM kinds""")
def x2_rules_by_precedence(t: Tables) -> DataFrame:
    hosts = _files(t).join(t.pages.groupBy(U.host(F.col("url")).alias("site")).agg(F.min("page_id").alias("n")), "site")
    configured = _rules(t).select("site", F.lit("file").alias("origin"))
    preset = hosts.where("n % 2 = 0").select("site", F.lit("preset").alias("origin"))
    detected = hosts.select("site", F.lit("detected").alias("origin"))
    return R.rules_by_precedence(configured, preset, detected)
