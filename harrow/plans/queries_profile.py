"""Guessing the rules of unknown sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import selectors as S
from harrow.functions import urls as U
from harrow.operators import dom
from harrow.operators import profile as P
from harrow.operators.dom import step
from harrow.plans import sql
from harrow.plans.crawl import detect_rules
from harrow.plans.registry import Tables, query, spread
from harrow.sources.rules import process_images, with_presets


def _typed(t: Tables) -> DataFrame:
    """Pages with the mark of a forum system added to some of them."""
    n = F.col("page_id") % 5
    mark = F.when(n == 0, "Powered by PHPBB, not Discuz").when(n == 1, "phpBB").when(n == 2, "vBulletin 4").otherwise("")
    return t.pages.withColumn("html", F.concat("html", mark))


_TYPE = """CASE WHEN regexp_matches(lower(html), 'discuz') OR page_id % 5 = 0 THEN 'discuz' WHEN page_id % 5 = 1 THEN 'phpbb'
  WHEN page_id % 5 = 2 THEN 'vbulletin' ELSE 'custom' END"""


@query(f"SELECT page_id, {_TYPE} AS forum_type FROM pages")
def p1_forum_type(t: Tables) -> DataFrame:
    return _typed(t).select("page_id", P.forum_type(F.col("html")).alias("forum_type"))


@query(f"""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN [base || '/forum.php?mod=attachment&aid=1&nothumb=yes', url]
  ELSE ['forum.php?mod=attachment&aid=1', url] END AS images
FROM (SELECT page_id, url, {sql.base('url')} AS base FROM pages)""")
def x1_process_images(t: Tables) -> DataFrame:
    typed = _typed(t).withColumn("forum_type", P.forum_type(F.col("html")))
    images = F.array(F.lit("forum.php?mod=attachment&aid=1"), F.col("url"))
    return typed.select("page_id", process_images(images, F.col("forum_type"), U.base_url(F.col("url"))).alias("images"))


@query(f"""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a.s.xst, a.xst' WHEN 1 THEN 'a.topictitle' WHEN 2 THEN 'a.title' ELSE 'a.thread-link' END
  AS thread_link_selector, CASE page_id % 5 WHEN 0 THEN 30000 ELSE 10240 END AS min_size FROM pages""")
def s5_presets(t: Tables) -> DataFrame:
    typed = _typed(t).select("page_id", P.forum_type(F.col("html")).alias("forum_type"))
    return with_presets(typed).select("page_id", "thread_link_selector", "min_size")


def _classed(t: Tables) -> DataFrame:
    """Pages whose links and paragraphs carry classes."""
    linked = F.regexp_replace("html", F.lit('<a href="/([a-zA-Z])'), F.lit('<a class="k$1 lnk" href="/$1'))
    return t.pages.select(
        "page_id", "url", U.host(F.col("url")).alias("site"),
        F.replace(F.replace(linked, F.lit("<p>"), F.lit('<p class="para">')), F.lit("<li>"), F.lit('<li id="item-9">')).alias("html"),
    )


_OCCURRENCES = f"""occurrences AS (
  SELECT page_id, {sql.host('url')} AS site, 'a' AS tag, 'k' || m || ' lnk' AS classes, pos AS lo
  FROM (SELECT page_id, url, unnest(l) AS m, generate_subscripts(l, 1) AS pos
    FROM (SELECT page_id, url, list_transform(regexp_extract_all(html, '<a href="(/[^"])', 1), lambda x: substr(x, 2, 1)) AS l FROM pages))
  WHERE regexp_matches(m, '^[a-zA-Z]$')
  UNION ALL SELECT page_id, {sql.host('url')}, 'div', 'ad', 100000 FROM pages
  UNION ALL SELECT page_id, site, 'p', 'para', 200000 + pos FROM (SELECT page_id, {sql.host('url')} AS site,
    unnest(range(len(regexp_extract_all(html, '<p>')))) AS pos FROM pages))"""


@query(f"WITH {_OCCURRENCES} SELECT site, tag, classes, count(*) AS n FROM occurrences GROUP BY 1, 2, 3")
def a9_pattern_counts(t: Tables) -> DataFrame:
    counts = P.pattern_counts(t.parsed(_classed(t)), "site")
    return counts.select("site", "tag", F.array_join("classes", " ").alias("classes"), "n")


@query(f"""
WITH {_OCCURRENCES}, c AS (SELECT site, tag, classes, count(*) AS n, min(page_id * 1000000 + lo) AS first_at
  FROM occurrences GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY n DESC, first_at) AS INTEGER) AS place FROM c)
SELECT site, tag, classes, n, place FROM r WHERE place <= 10 AND n >= 5""")
def t1_top_patterns(t: Tables) -> DataFrame:
    top = P.top_patterns(P.pattern_counts(t.parsed(_classed(t)), "site"), "site")
    return top.withColumn("classes", F.array_join("classes", " "))


@query(f"""
WITH {_OCCURRENCES}, c AS (SELECT page_id, tag, classes, count(*) AS n, min(lo) AS first_at FROM occurrences GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first_at) AS place FROM c),
ok AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY least(1.0, n / 20) DESC, place) AS best
  FROM r WHERE place <= 10 AND n BETWEEN 5 AND 50)
SELECT p.page_id, coalesce(tag || '.' || split_part(classes, ' ', 1), '') AS selector, CASE WHEN n IS NULL THEN 0.0 ELSE least(1.0, n / 20) END AS confidence
FROM pages p LEFT JOIN ok ON ok.page_id = p.page_id AND best = 1""")
def p2_list_candidate(t: Tables) -> DataFrame:
    parsed = t.parsed(_classed(t))
    return parsed.select("page_id", P.list_candidate(F.col("nodes"), F.lit("custom")).alias("c")).select("page_id", "c.*")


@query("""
WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: length(x)) AS l FROM pages)
SELECT page_id, CASE WHEN len(l) = 0 THEN 0.0 ELSE
  (CASE WHEN len(l) BETWEEN 10 AND 30 THEN 0.9 WHEN len(l) BETWEEN 5 AND 9 THEN 0.7 WHEN len(l) > 30 THEN 0.6 ELSE 0.4 END)
  * (len(list_filter(l, lambda x: x >= l[1] - 100 AND x < l[1] + 100)) / len(l)) END AS confidence
FROM l""")
def p3_list_confidence(t: Tables) -> DataFrame:
    lengths = F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1)), F.length)
    return t.pages.select("page_id", P.list_confidence(lengths).alias("confidence"))


_GOOD_LINK = """NOT regexp_matches(lower(href), 'javascript:|#|user|member|avatar')
  AND regexp_matches(lower(href), 'thread|topic|viewthread|t/|tid=')"""


@query(f"""
WITH {sql.LINKS}, changed AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/thread' || href ELSE href END AS href FROM links WHERE pos = 1)
SELECT page_id, 'a' AS selector, CASE WHEN {_GOOD_LINK} THEN 0.9 ELSE 0.6 END AS confidence FROM changed""")
def p4_link_candidate(t: Tables) -> DataFrame:
    html = F.when(
        F.col("page_id") % 3 == 0, F.replace("html", F.lit('<a href="/'), F.lit('<a href="/thread/'))
    ).otherwise(F.col("html"))
    parsed = t.parsed(t.pages.withColumn("html", html))
    found = parsed.select("page_id", P.link_candidate(F.col("nodes"), F.lit("nav li")).alias("c"))
    return found.select("page_id", "c.*")


def _pictured(t: Tables) -> DataFrame:
    n = F.col("page_id") % 4
    shape = (
        F.when(n == 0, '<img class="shot" src="/x.jpg"><a href="')
        .when(n == 1, '<div class="message"><img src="/icon.png"></div><a href="')
        .when(n == 2, '<img src="/x.JPG"><a href="')
        .otherwise('<a href="')
    )
    return t.parsed(t.pages.withColumn("html", F.replace("html", F.lit('<a href="'), shape)))


@query(f"""
WITH n AS (SELECT page_id, len(regexp_extract_all(html, '{sql.LINK}')) AS n FROM pages)
SELECT page_id, CASE WHEN n = 0 THEN 'img' WHEN page_id % 4 = 0 THEN 'img.shot' WHEN page_id % 4 = 1 THEN 'div.message img'
    WHEN page_id % 4 = 2 THEN 'img[src]' ELSE 'img' END AS selector,
  CASE WHEN n = 0 THEN 0.3 WHEN page_id % 4 = 0 THEN least(1.0, n / 10) WHEN page_id % 4 = 1 THEN least(1.0, n / 5)
    WHEN page_id % 4 = 2 THEN 0.5 ELSE 0.3 END AS confidence
FROM n""")
def p5_image_candidate(t: Tables) -> DataFrame:
    return _pictured(t).select("page_id", P.image_candidate(F.col("nodes")).alias("c")).select("page_id", "c.*")


@query(f"""
SELECT {sql.host('url')} AS site, 'shot' AS class, CAST(sum(len(regexp_extract_all(html, '{sql.LINK}'))) AS BIGINT) AS n
FROM pages WHERE page_id % 4 = 0 GROUP BY 1 HAVING sum(len(regexp_extract_all(html, '{sql.LINK}'))) > 0""")
def a10_image_class(t: Tables) -> DataFrame:
    parsed = _pictured(t).withColumn("site", U.host(F.col("url")))
    return P.image_class_counts(parsed, "site")


_NEXT = "regexp_matches(lower(array_to_string(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)', 1), ' ')), '下一页|下一頁|next|›|»')"


@query(f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 AND NOT {_NEXT} THEN 'a.b.c' WHEN {_NEXT} THEN 'a' WHEN page_id % 3 = 1 THEN 'a.nxt' ELSE '' END AS selector,
  CASE WHEN page_id % 3 = 0 OR {_NEXT} THEN 0.9 WHEN page_id % 3 = 1 THEN 0.8 ELSE 0.0 END AS confidence
FROM pages""")
def p6_next_candidate(t: Tables) -> DataFrame:
    n = F.col("page_id") % 3
    extra = (
        F.when(n == 0, '<a class="b c" href="?p=2">Next »</a></nav>')
        .when(n == 1, '<a class="nxt" href="?p=2">2</a></nav>')
        .otherwise("</nav>")
    )
    parsed = t.parsed(t.pages.withColumn("html", F.replace("html", F.lit("</nav>"), extra)))
    return parsed.select("page_id", P.next_candidate(F.col("nodes")).alias("c")).select("page_id", "c.*")


_PROFILE = f"""{sql.LINKS}, good AS (SELECT DISTINCT page_id FROM links WHERE {_GOOD_LINK}),
profile AS (SELECT page_id, {sql.host('url')} AS site,
  CASE WHEN page_id IN (SELECT page_id FROM good) THEN 0.9 WHEN contains(html, '<a href') THEN 0.6 ELSE 0.3 END AS link,
  CASE WHEN {_NEXT} THEN 0.9 ELSE 0.0 END AS nxt FROM pages)"""


@query(f"""
WITH {_PROFILE}
SELECT page_id, '' AS list_selector, 'a' AS link_selector, 'img' AS image_selector, CASE WHEN nxt > 0 THEN 'a' ELSE '' END AS next_selector,
  round((0.0 + link + 0.3 + nxt) / 4, 6) AS overall, 'uncertain' AS status FROM profile""")
def p7_page_profiles(t: Tables) -> DataFrame:
    typed = t.pages.withColumn("forum_type", P.forum_type(F.col("html")))
    return P.page_profiles(t.parsed(typed), "page_id").select(
        "page_id",
        F.col("thread_list.selector").alias("list_selector"),
        F.col("thread_link.selector").alias("link_selector"),
        F.col("image.selector").alias("image_selector"),
        F.col("next_page.selector").alias("next_selector"),
        F.round("overall", 6).alias("overall"),
        "status",
    )


@query(f"""
WITH {_PROFILE}
SELECT site, count(*) AS n_pages, 'custom' AS forum_type, round(avg(link), 6) AS link_confidence,
  CASE WHEN sum(nxt) > 0 THEN 'a' ELSE '' END AS next_selector
FROM profile GROUP BY 1""")
def p7_site_profiles(t: Tables) -> DataFrame:
    typed = t.pages.withColumn("site", U.host(F.col("url"))).withColumn("forum_type", P.forum_type(F.col("html")))
    sites = P.site_profiles(P.page_profiles(t.parsed(typed), "site", "page_id"))
    return sites.select(
        "site", "n_pages", "forum_type", F.round("thread_link.confidence", 6).alias("link_confidence"),
        F.col("next_page.selector").alias("next_selector"),
    )


_SITES = f"""{_PROFILE}, sites AS (
  SELECT site, CASE WHEN sum(nxt) > 0 THEN 'a' ELSE '' END AS next_selector, avg(link) AS link, CASE WHEN sum(nxt) > 0 THEN 0.9 ELSE 0.0 END AS nxt FROM profile GROUP BY 1)"""


@query(f"""
WITH {_SITES}
SELECT site, '' AS list_selector, 0.0 AS list_confidence, 'a' AS link_selector, 'img' AS image_selector, 0.3 AS image_confidence, next_selector,
  nxt AS next_confidence, round((0.0 + link + 0.3 + nxt) / 4, 6) AS overall, 'uncertain' AS status FROM sites""")
def p7_site_votes(t: Tables) -> DataFrame:
    """Every rule of a site with its confidence, and the verdict over all of them."""
    typed = t.pages.withColumn("site", U.host(F.col("url"))).withColumn("forum_type", P.forum_type(F.col("html")))
    sites = P.site_profiles(P.page_profiles(t.parsed(typed), "site", "page_id"))
    return sites.select(
        "site", F.col("thread_list.selector").alias("list_selector"), F.round("thread_list.confidence", 9).alias("list_confidence"),
        F.col("thread_link.selector").alias("link_selector"), F.col("image.selector").alias("image_selector"),
        F.round("image.confidence", 9).alias("image_confidence"), F.col("next_page.selector").alias("next_selector"),
        F.round("next_page.confidence", 9).alias("next_confidence"), F.round("overall", 6).alias("overall"), "status")


@query(f"""
WITH {_SITES}
SELECT site, 'Auto-custom' AS name, 'bbs' AS crawler_type, 'custom' AS forum_type, 'https://' || site AS base_url, '' AS thread_list_selector,
  'a' AS thread_link_selector, 'img' AS image_selector, next_selector AS next_page_selector FROM sites""")
def run_detected_rules(t: Tables) -> DataFrame:
    """The rules guessed for every host, as a crawl would use them."""
    return detect_rules(spread(t.pages))


@query(f"""
WITH {_OCCURRENCES}
SELECT page_id, lo AS pos, 'a.' || split_part(classes, ' ', 1) AS by_class, 'a.' || replace(classes, ' ', '.') AS as_link,
  'li[id^=''item-'']' AS by_id, '.lnk a' AS by_parent
FROM occurrences WHERE tag = 'a'""")
def p8_selector_text(t: Tables) -> DataFrame:
    nodes = F.col("nodes")
    links = dom.find_all(nodes, [[step("a")]])
    items = dom.find_all(nodes, [[step("li")]])
    found = t.parsed(_classed(t)).select("page_id", F.posexplode(F.arrays_zip(links.alias("a"), items.alias("li"))).alias("i", "z"))
    a, li = F.col("z.a"), F.col("z.li")
    return found.where(F.size(a["classes"]) > 0).select(
        "page_id", (F.col("i") + 1).cast("bigint").alias("pos"),
        S.class_selector(a).alias("by_class"),
        S.link_selector(a["classes"]).alias("as_link"),
        S.id_selector(li["tag"], dom.attr(li, "id")).alias("by_id"),
        S.link_selector(F.array().cast("array<string>"), F.array(F.lit("lnk"))).alias("by_parent"),
    )


def _counted(t: Tables) -> DataFrame:
    def n(tag: str) -> Column:
        return F.size(F.regexp_extract_all("html", F.lit(tag), F.lit(0)))

    return t.pages.select("page_id", n("<li>").alias("li"), n("<p>").alias("p"), n("<b>").alias("b"))


@query("""
WITH n AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS li, len(regexp_extract_all(html, '<p>')) AS p,
  len(regexp_extract_all(html, '<b>')) AS b FROM pages),
c AS (SELECT page_id, 1 AS i, 'li' AS selector, least(1.0, li / 10) AS confidence FROM n WHERE li > 5
  UNION ALL SELECT page_id, 2, 'p', least(1.0, p / 10) FROM n WHERE p > 0
  UNION ALL SELECT page_id, 3, 'b', least(1.0, b / 2) FROM n WHERE b > 0)
SELECT n.page_id, coalesce(min_by(selector, -confidence * 100 + i), '') AS selector, coalesce(max(confidence), 0.0) AS confidence
FROM n LEFT JOIN c ON c.page_id = n.page_id GROUP BY 1""")
def t2_best_candidate(t: Tables) -> DataFrame:
    def of(name: str, full: int, more_than: int) -> Column:
        return F.when(F.col(name) > more_than, P.candidate(name, P.share(F.col(name), full)))

    choices = F.array(of("li", 10, 5), of("p", 10, 0), of("b", 2, 0))
    best = P.best_candidate(choices, P.candidate("", 0.0))
    return _counted(t).select("page_id", best.alias("c")).select("page_id", "c.*")
