"""Page parsing and extraction. Rules are chosen for the markup of the page table;
where it lacks some markup, the pages are first rewritten by Spark and by the SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.operators import dom
from harrow.operators import extract as E
from harrow.operators.dom import step
from harrow.operators.extract import one
from harrow.operators.frontier import list_fields_win
from harrow.plans import sql
from harrow.plans.registry import Tables, query, spread
from harrow.sources.rules import news_rule_columns, with_news_rules, with_site_rules

NAV_ITEMS = [[step("nav"), step("li")]]
NAV_LINKS = [[step("nav"), step("a")]]


def _parsed(t: Tables) -> DataFrame:
    return t.parsed()


def _rewritten(t: Tables, html: Column) -> DataFrame:
    return t.parsed(t.pages.withColumn("html", html))


_AD = "regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)"
_H1 = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"


@query(f"WITH {sql.LINKS} SELECT page_id, pos, href FROM links")
def e1_flat_links(t: Tables) -> DataFrame:
    return dom.flat_links(t.pages, "page_id")


@query("""
WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '<\\1></\\1>', 'g'),
  '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
tags AS (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)[^<>]*>', 1)) AS tag FROM bare)
SELECT page_id, tag, count(*) AS n FROM tags GROUP BY 1, 2""")
def e1_elements(t: Tables) -> DataFrame:
    return (
        dom.elements(_parsed(t), "page_id").where(F.col("attrs").isNotNull())
        .groupBy("page_id", "tag").agg(F.count("*").alias("n"))
    )


_NAV_TEXT = """regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)"""


@query(f"""
WITH {sql.LINKS}, titles AS (
  SELECT page_id, unnest(t) AS title, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, {_NAV_TEXT} AS t FROM pages))
SELECT page_id, pos, {sql.resolved()} AS thread_url, {sql.strip(sql.unescape('title'))} AS title,
  {sql.thread_id(sql.resolved())} AS thread_id
FROM links JOIN titles USING (page_id, pos)""")
def e2_thread_list(t: Tables) -> DataFrame:
    return E.thread_list(_parsed(t), NAV_ITEMS, one("a"), "page_id")


_ARTICLE = "regexp_replace(regexp_extract(html, '(?s)<article>(.*)', 1), '(?s)</article>.*$', '</article>')"


@query(f"""
SELECT page_id, url AS thread_url, {sql.thread_id('url')} AS thread_id, {sql.text(_ARTICLE, 'chr(10)')} AS content,
  CAST(len(list_filter(list_distinct(regexp_extract_all(html, '{sql.LINK}', 1)),
    lambda x: regexp_matches(lower({sql.base('url')} || x), 'image|img|photo|pic|attachment|\\.(jpg|jpeg|png|gif|bmp|webp)$'))) AS INTEGER)
    AS image_count
FROM (SELECT page_id, url, replace(html, '<a href=', '<img src=') AS shown, html FROM pages)""")
def e3_thread_detail(t: Tables) -> DataFrame:
    pages = _rewritten(t, F.replace("html", F.lit("<a href="), F.lit("<img src=")))
    return E.thread_detail(pages, [[step("nav"), step("img")]], "page_id").drop("images", "metadata")


@query(f"""
WITH {sql.LINKS}, titles AS (
  SELECT page_id, unnest(t) AS title, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, {_NAV_TEXT} AS t FROM pages))
SELECT page_id, pos, {sql.resolved()} AS thread_url, {sql.strip(sql.unescape('title'))} AS title FROM links JOIN titles USING (page_id, pos)""")
def e2_forum_markup(t: Tables) -> DataFrame:
    """Lists without end tags, as forums write them: a new item ends the one before."""
    html = F.regexp_replace("html", "</li>|</ul>|</p>", "")
    parsed = dom.parse_pages(spread(t.pages.withColumn("html", F.regexp_replace(html, "</nav>", "</ul></nav>"))), implied_ends=True)
    return E.thread_list(parsed, NAV_ITEMS, one("a"), "page_id").select("page_id", "pos", "thread_url", "title")


@query(f"""
SELECT page_id, {sql.strip(sql.unescape(_H1))} AS author, {sql.strip(sql.unescape(_AD))} AS post_time, page_id * 1001 AS views,
  CASE WHEN page_id % 2 = 0 THEN page_id + 5 END AS replies
FROM pages""")
def e4_thread_metadata(t: Tables) -> DataFrame:
    n = F.col("page_id")
    views = F.format_string('<nav><i class="the-view">seen %,d times</i>', n * 1001)
    replies = F.when(n % 2 == 0, F.format_string('<b class="replies">%d / 7</b>', n + 5)).otherwise("")
    named = F.replace(F.replace("html", F.lit("<h1>"), F.lit('<h1 class="x username">')), F.lit('"ad"'), F.lit('"timer"'))
    pages = _rewritten(t, F.replace(named, F.lit("<nav>"), F.concat(views, replies)))
    return pages.select("page_id", E.thread_metadata(F.col("nodes")).alias("m")).select("page_id", "m.*")


@query(f"""
WITH {sql.LINKS}, shown AS (
  SELECT page_id, {sql.resolved()} AS image, min(pos) AS pos FROM links
  WHERE regexp_matches(lower({sql.resolved()}), 'image|img|photo|pic|attachment|\\.(jpg|jpeg|png|gif|bmp|webp)$') GROUP BY 1, 2),
listed AS (SELECT page_id, string_agg(image, ' ' ORDER BY pos) AS images FROM shown GROUP BY 1)
SELECT page_id, coalesce(images, '') AS images, {sql.strip(sql.unescape(_H1))} AS author, {sql.strip(sql.unescape(_AD))} AS post_time,
  page_id * 1001 AS views, CASE WHEN page_id % 2 = 0 THEN page_id + 5 END AS replies
FROM pages LEFT JOIN listed USING (page_id)""")
def e3_images_and_metadata(t: Tables) -> DataFrame:
    """The pictures of a thread in their order, and its metadata."""
    n = F.col("page_id")
    views = F.format_string('<nav><i class="the-view">seen %,d times</i>', n * 1001)
    replies = F.when(n % 2 == 0, F.format_string('<b class="replies">%d / 7</b>', n + 5)).otherwise("")
    named = F.replace(F.replace("html", F.lit("<h1>"), F.lit('<h1 class="x username">')), F.lit('"ad"'), F.lit('"timer"'))
    pages = _rewritten(t, F.replace(F.replace(named, F.lit("<nav>"), F.concat(views, replies)), F.lit("<a href="), F.lit("<img src=")))
    return E.thread_detail(pages, [[step("nav"), step("img")]], "page_id").select("page_id", F.array_join("images", " ").alias("images"), "metadata.*")


@query(f"SELECT page_id, {sql.text(_ARTICLE, 'chr(10)')} AS content FROM pages")
def e5_thread_content(t: Tables) -> DataFrame:
    return _parsed(t).select("page_id", E.thread_content(F.col("nodes")).alias("content"))


@query(f"""
WITH {sql.LINKS} SELECT p.page_id, {sql.resolved('href', 'p.url')} AS next_url
FROM pages p LEFT JOIN links l ON l.page_id = p.page_id AND l.pos = 1""")
def e6_next_page(t: Tables) -> DataFrame:
    return _parsed(t).select("page_id", E.next_page(F.col("nodes"), F.col("url"), NAV_LINKS).alias("next_url"))


_NEWS_RULES = {"article": one("body"), "title": one("h1"), "author": one("div", "ad"), "summary": one("footer")}


@query(f"""
WITH {sql.LINKS}
SELECT page_id, 1 AS pos, {sql.article_id('href')} AS article_id, {sql.strip(sql.unescape(_H1))} AS title, {sql.strip(sql.unescape(_AD))} AS author,
  CAST(NULL AS VARCHAR) AS date, {sql.text("regexp_extract(html, '(?s)<footer>.*')")} AS summary, {sql.resolved('href', 'p.url')} AS article_url
FROM pages p JOIN links l USING (page_id) WHERE l.pos = 1""")
def e7_article_list(t: Tables) -> DataFrame:
    return E.article_list(_parsed(t), "page_id", site_base=U.base_url(F.col("url")), rules=_NEWS_RULES)


@query(f"""
WITH {sql.LINKS}, titles AS (
  SELECT page_id, unnest(t) AS title, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, {_NAV_TEXT} AS t FROM pages))
SELECT page_id, pos, {sql.article_id('href')} AS article_id, {sql.strip(sql.unescape('title'))} AS title, '{E.UNKNOWN_AUTHOR}' AS author,
  CAST(NULL AS VARCHAR) AS date, '' AS summary, {sql.resolved()} AS article_url
FROM links JOIN titles USING (page_id, pos)""")
def e7_several_entries(t: Tables) -> DataFrame:
    """Every item of a page's list is an entry."""
    rules = {"article": NAV_ITEMS, "title": one("a")}
    return E.article_list(_parsed(t), "page_id", site_base=U.base_url(F.col("url")), rules=rules)


@query(f"""
WITH {sql.LINKS}, titles AS (
  SELECT page_id, unnest(t) AS title, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, {_NAV_TEXT} AS t FROM pages))
SELECT page_id, pos, {sql.article_id('href')} AS article_id, {sql.strip(sql.unescape('title'))} AS title, {sql.resolved()} AS article_url
FROM links JOIN titles USING (page_id, pos) WHERE page_id % 3 = 0
UNION ALL
SELECT page_id, 1, {sql.article_id('href')}, {sql.strip(sql.unescape(_H1))}, {sql.resolved('href', 'p.url')}
FROM pages p JOIN links l USING (page_id) WHERE l.pos = 1 AND page_id % 3 = 1""")
def e7_site_rules(t: Tables) -> DataFrame:
    """Each site has rules of its own: list items, the whole body, or the usual ones, which find nothing here."""
    site = F.concat(F.lit("s"), F.col("page_id") % 3)
    rules = t.spark.createDataFrame(
        [("s0", "nav li", "a", None), ("s1", "body", "h1", "nav a"), ("s2", " ", None, None)],
        "site string, article_selector string, title_selector string, link_selector string")
    parsed = dom.parse_pages(with_news_rules(spread(t.pages).withColumn("site", site), rules))
    found = E.article_list(parsed, "page_id", site_base=U.base_url(F.col("url")), rules=news_rule_columns())
    return found.select("page_id", "pos", "article_id", "title", "article_url")


@query("""
WITH hrefs AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1),
  lambda x, i: CASE WHEN i % 3 = 0 AND page_id % 2 = 0 THEN x || i WHEN regexp_matches(x, '^/[a-mA-M]') THEN x || '.PNG' ELSE x END) AS l
  FROM pages),
ok AS (SELECT page_id, l, list_filter(l, lambda x: NOT regexp_matches(lower(x), '\\.(jpg|jpeg|png|gif|webp)|res\\.xdcdn\\.net')) AS good FROM hrefs)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN l[1]
  ELSE coalesce(CASE WHEN l[1] = good[1] THEN l[1] END, list_filter(good, lambda x: regexp_matches(x, '[0-9]'))[1], good[1]) END AS link
FROM ok""")
def e8_article_link(t: Tables) -> DataFrame:
    hrefs, n = F.col("hrefs"), F.col("page_id")

    def change(x: Column, i: Column) -> Column:
        return (
            F.when(((i + 1) % 3 == 0) & (n % 2 == 0), F.concat(x, (i + 1).cast("string")))
            .when(F.regexp_like(x, F.lit("^/[a-mA-M]")), F.concat(x, F.lit(".PNG")))
            .otherwise(x)
        )

    links = F.array_join(F.transform(F.transform(hrefs, change), lambda x: F.concat(F.lit('<a href="'), x, F.lit('">x</a>'))), "")
    first = F.concat(F.lit('<a href="'), F.get(F.transform(hrefs, change), F.lit(0)), F.lit('">x</a>'))
    title = F.when(n % 5 == 0, F.concat(F.lit('<b class="title">'), first, F.lit("</b>"))).otherwise('<b class="title">t</b>')
    html = F.concat(F.lit('<div class="article">'), links, title, F.lit("</div>"))
    pages = dom.parse_pages(dom.page_links(t.pages, "page_id").select("page_id", html.alias("html")))
    nodes = F.col("nodes")
    return pages.select(
        "page_id",
        E.let(
            dom.find_first(nodes, one(cls="article")),
            lambda a: E.let(
                dom.find_first(nodes, one(cls="title"), dom.subtree(nodes, a)),
                lambda b: E.article_link(nodes, a, b, E.ANY_LINK),
            ),
        ).alias("link"),
    )


_BODY = "regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)</body>.*$', '')"


@query(f"""
SELECT page_id, {sql.article_id('url')} AS article_id, url AS article_url, {sql.text(_BODY)} AS content,
  CAST(len(list_distinct(list_filter(regexp_extract_all(html, '{sql.LINK}', 1),
    lambda x: regexp_matches(lower(x), '\\.(jpg|jpeg|png|gif|webp)')))) AS INTEGER) AS n_images
FROM pages""")
def e9_article_detail(t: Tables) -> DataFrame:
    return E.article_detail(_parsed(t), "page_id").withColumn("n_images", F.size("images")).drop("images")


@query(f"""
WITH {sql.LINKS}, shown AS (
  SELECT page_id, {sql.resolved()} || '.JPG' AS image, min(pos) AS pos FROM links WHERE regexp_matches(href, '^/[a-m]') GROUP BY 1, 2
  UNION ALL SELECT page_id, {sql.resolved()}, min(pos) FROM links
  WHERE NOT regexp_matches(href, '^/[a-m]') AND regexp_matches(lower(href), '\\.(jpg|jpeg|png|gif|webp)') GROUP BY 1, 2),
listed AS (SELECT page_id, string_agg(image, ' ' ORDER BY pos) AS images FROM shown GROUP BY 1)
SELECT page_id, coalesce(images, '') AS images FROM pages LEFT JOIN listed USING (page_id)""")
def e9_article_images(t: Tables) -> DataFrame:
    """The pictures an article links to, each once and in order."""
    pages = _rewritten(t, F.regexp_replace("html", '<a href="(/[a-m][^"]*)"', '<a href="$1.JPG"'))
    return E.article_detail(pages, "page_id").select("page_id", F.array_join("images", " ").alias("images"))


@query("""
SELECT page_id, page_id % 5 = 0 OR page_id % 7 = 0
  OR regexp_matches(lower(html), '查看更多|load more|加载更多|show more|更多') AS has_more FROM pages""")
def e10_load_more(t: Tables) -> DataFrame:
    n = F.col("page_id")
    mark = (
        F.when(n % 5 == 0, "<nav><!-- Load More -->")
        .when(n % 7 == 0, '<nav><a class="b more" data-action="switch_page">x</a>')
        .otherwise("<nav>")
    )
    pages = _rewritten(t, F.replace("html", F.lit("<nav>"), mark))
    return pages.select("page_id", E.has_load_more(F.col("nodes")).alias("has_more"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN CAST(page_id AS INTEGER) END AS next_number FROM pages")
def e11_next_page_number(t: Tables) -> DataFrame:
    n = F.col("page_id")
    mark = (
        F.when(n % 3 == 0, F.concat(F.lit('<nav data-page=" '), n, F.lit(' "><i data-page="7"></i>')))
        .when(n % 3 == 1, '<nav data-page="last">')
        .otherwise("<nav>")
    )
    pages = _rewritten(t, F.replace("html", F.lit("<nav>"), mark))
    return pages.select("page_id", E.next_page_number(F.col("nodes")).alias("next_number"))


@query(f"""
WITH {sql.LINKS}, firsts AS (
  SELECT page_id, {sql.resolved()} AS image_url, min(pos) AS first_pos FROM links GROUP BY 1, 2)
SELECT page_id, image_url, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) AS pos FROM firsts""")
def e12_image_urls(t: Tables) -> DataFrame:
    nodes = F.col("nodes")
    hrefs = F.transform(dom.find_all(nodes, NAV_LINKS), lambda a: dom.filled_attr(a, "href"))
    urls = E.distinct_urls(F.col("url"), hrefs)
    return _parsed(t).select("page_id", F.posexplode(urls).alias("i", "image_url")).select(
        "page_id", "image_url", (F.col("i") + 1).cast("bigint").alias("pos")
    )


def _with_images(t: Tables) -> DataFrame:
    """One picture per navigation link, its attributes varying with the page."""
    n = F.col("page_id") % 4
    shape = (
        F.when(n == 0, r'<img srcset="$1-s.jpg 320w, $1-l.jpg 800w , $1-m.jpg 800w" src="$1.jpg"><a href="$1"')
        .when(n == 1, r'<img srcset="$1-s.jpg" src="" data-src="$1-lazy.jpg"><a href="$1"')
        .when(n == 2, r'<img src="$1-100x200.png" data-original="$1-o.png"><a href="$1"')
        .otherwise(r'<img data-original="$1-o.png"><a href="$1"')
    )
    return _rewritten(t, F.regexp_replace("html", F.lit('<a href="([^"]*)"'), shape))


@query(f"""
WITH {sql.LINKS}
SELECT page_id, pos, CASE page_id % 4 WHEN 0 THEN regexp_extract(href, '[^,]*$') || '-l.jpg' WHEN 1 THEN href || '-lazy.jpg' WHEN 2 THEN href || '.png' END AS image_url
FROM links""")
def e13_news_image(t: Tables) -> DataFrame:
    found = F.transform(dom.find_all(F.col("nodes"), one("img")), E.news_image_candidate)
    return _with_images(t).select("page_id", F.posexplode(found).alias("i", "image_url")).select(
        "page_id", (F.col("i") + 1).cast("bigint").alias("pos"), "image_url"
    )


@query(f"""
WITH {sql.LINKS}
SELECT page_id, pos, CASE page_id % 4 WHEN 0 THEN href || '.jpg' WHEN 1 THEN href || '-lazy.jpg'
  WHEN 2 THEN href || '-100x200.png' ELSE href || '-o.png' END AS image_url
FROM links""")
def e14_forum_image(t: Tables) -> DataFrame:
    found = F.transform(dom.find_all(F.col("nodes"), one("img")), E.forum_image_candidate)
    return _with_images(t).select("page_id", F.posexplode(found).alias("i", "image_url")).select(
        "page_id", (F.col("i") + 1).cast("bigint").alias("pos"), "image_url"
    )


@query(f"""
WITH n AS (SELECT page_id, {sql.host('url')} AS host, len(regexp_extract_all(html, '<li>')) AS li,
  len(regexp_extract_all(html, '<p>')) AS p FROM pages)
SELECT page_id, host, CASE WHEN length(host) % 2 = 0 THEN 'discuz' ELSE 'custom' END AS forum_type,
  CAST(CASE WHEN length(host) % 2 = 0 THEN li ELSE p + 1 END AS INTEGER) AS n_items FROM n""")
def j5_site_rules(t: Tables) -> DataFrame:
    """Every host gets rules of its own; they drive the matching as data."""
    host = U.host(F.col("url"))
    even = F.length("host") % 2 == 0
    rules = t.pages.select(host.alias("host")).distinct().select(
        F.concat(F.lit("https://"), "host").alias("base_url"),
        F.when(even, "discuz").otherwise("custom").alias("forum_type"),
        F.when(even, "nav li, nav ul li").otherwise("article p, div[class^='a'], #none").alias("thread_list_selector"),
        F.lit("a").alias("thread_link_selector"),
        F.lit("img").alias("image_selector"),
        F.lit("a[rel='next']").alias("next_page_selector"),
    )
    paired = dom.parse_pages(with_site_rules(spread(t.pages), rules))
    found = dom.find_all_by(F.col("nodes"), F.col("thread_list_rule"))
    return paired.select("page_id", "host", "forum_type", F.size(found).alias("n_items"))


@query(f"""
SELECT url AS thread_url, {sql.host('url')} AS board, 'Thread-' || {sql.thread_id('url')} AS title, length(html) AS n_chars
FROM pages""")
def j4_list_fields_win(t: Tables) -> DataFrame:
    url = F.col("url")
    listed = t.pages.select(
        url.alias("thread_url"), U.host(url).alias("board"), F.concat(F.lit("Thread-"), U.thread_id(url)).alias("title")
    )
    detail = t.pages.select(
        url.alias("thread_url"), F.lit("?").alias("title"), F.lit("?").alias("board"), F.length("html").cast("bigint").alias("n_chars")
    )
    return list_fields_win(listed, detail)


@query(f"WITH {sql.LINKS} SELECT page_id, href FROM links")
def j6_inside(t: Tables) -> DataFrame:
    pairs = dom.inside_pairs(_parsed(t), one("nav"), one("a"), "page_id")
    return pairs.select("page_id", F.element_at("attrs", "href").alias("href"))


@query(f"""
WITH {sql.LINKS} SELECT page_id, href, CASE WHEN page_id % 2 = 0 THEN 'li' ELSE 'ul' END AS outer_tag,
  CAST(CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) + CAST(page_id % 7 AS INTEGER) AS depth FROM links""")
def j6_nearest(t: Tables) -> DataFrame:
    """Pages wrapped into up to six sections; list items count as outer elements on even pages."""
    wraps = (F.col("page_id") % 7).cast("int")
    html = F.concat(F.repeat(F.lit("<section>"), wraps), F.regexp_extract("html", r"(?s)<nav>.*?</nav>", 0), F.repeat(F.lit("</section>"), wraps))
    pages = t.pages.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.replace(html, F.lit("<li>"), F.lit('<li class="o">'))).otherwise(html))
    outer = [[step("section")], [step("nav")], [step("ul")], [step("li", "o")]]
    found = dom.nearest_outer(t.parsed(pages), outer, one("a"), "page_id")
    return found.select("page_id", F.element_at("attrs", "href").alias("href"), "outer_tag", "depth")


@query(f"WITH {sql.LINKS} SELECT page_id, pos, href FROM links")
def t4_document_order(t: Tables) -> DataFrame:
    """Two overlapping rules still give every link once and in document order."""
    found = dom.find_all(F.col("nodes"), [*NAV_LINKS, [step("li"), step("a")], [step("a")]])
    hrefs = F.transform(found, lambda a: dom.attr(a, "href"))
    return _parsed(t).select("page_id", F.posexplode(hrefs).alias("i", "href")).select(
        "page_id", (F.col("i") + 1).cast("bigint").alias("pos"), "href"
    )


@query(f"""
WITH {sql.LINKS}, firsts AS (SELECT page_id, substr(href, 2, 1) AS letter, min(pos) AS first_pos FROM links GROUP BY 1, 2)
SELECT page_id, string_agg(letter, ',' ORDER BY first_pos) AS letters FROM firsts GROUP BY 1""")
def u3_ordered_distinct(t: Tables) -> DataFrame:
    letters = F.array_distinct(F.transform("hrefs", lambda h: F.substring(h, 2, 1)))
    return dom.page_links(t.pages, "page_id").where(F.size("hrefs") > 0).select("page_id", F.array_join(letters, ",").alias("letters"))
