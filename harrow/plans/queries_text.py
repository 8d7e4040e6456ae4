"""Scans, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import text as X
from harrow.functions import urls as U
from harrow.operators import images as I
from harrow.operators import state
from harrow.operators.dom import flat_links
from harrow.operators.profile import is_content_image
from harrow.plans import sql
from harrow.plans.crawl import new_pages_per_host
from harrow.plans.registry import Tables, query
from harrow.sources.pages import fetch_summary, thread_references


@query(f"""
SELECT host, count(*) AS n_threads, min(page_id) AS first_page_id FROM (
  SELECT {sql.host('url')} AS host, {sql.thread_id('url')} AS tid, min(page_id) AS page_id
  FROM pages GROUP BY 1, 2) GROUP BY host""")
def new_threads_per_host(t: Tables) -> DataFrame:
    return new_pages_per_host(t.pages)


@query(f"""
SELECT {sql.host('url')} AS host, count(html) AS pages_fetched,
       count(*) FILTER (html IS NULL) AS requests_failed, CAST(sum(length(html)) AS BIGINT) AS n_chars
FROM pages GROUP BY 1""")
def s1_page_scan(t: Tables) -> DataFrame:
    return fetch_summary(t.pages)


@query(f"""
SELECT page_id, 'downloads/' || {sql.host('url')} || '/' || {sql.article_id('url')} || '_' || {sql.file_name('url')} AS news_path,
       'downloads/' || {sql.host('url')} || '/' || {sql.thread_id('url')} || '/' || {sql.file_name('url')} AS forum_path
FROM pages""")
def s8_output_layout(t: Tables) -> DataFrame:
    url = F.col("url")
    root, name = F.lit("downloads"), U.image_filename(url)
    return t.pages.select(
        "page_id",
        U.news_save_path(root, U.host(url), U.article_id(url), name).alias("news_path"),
        U.forum_save_path(root, U.host(url), U.thread_id(url), name).alias("forum_path"),
    )


@query(f"""
SELECT url, {sql.thread_id('url')} AS thread_id, 'Thread-' || {sql.thread_id('url')} AS title, {sql.host('url')} AS board
FROM pages""")
def s9_thread_references(t: Tables) -> DataFrame:
    return thread_references(t.pages)


@query(f"SELECT page_id, {sql.thread_id('url')} AS thread_id FROM pages")
def f1_thread_id(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.thread_id(F.col("url")).alias("thread_id"))


@query(f"SELECT page_id, {sql.article_id('url')} AS article_id FROM pages")
def f2_article_id(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.article_id(F.col("url")).alias("article_id"))


@query("SELECT page_id, substr(md5(url), 1, 16) AS url_id FROM pages")
def f3_url_digest(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.url_digest(F.col("url")).alias("url_id"))


_FOLDER = f"regexp_extract({sql.path('url')}, '^(.*/)', 1)"
_BARE = "regexp_replace(url, '[?#].*$', '')"


@query(f"""
WITH {sql.LINKS}
SELECT page_id, pos, {sql.resolved()} AS rooted,
  {sql.base('url')} || {_FOLDER} || 'x' || href AS relative,
  {sql.base('url')} || (CASE WHEN {_FOLDER} = '/' THEN '/' ELSE regexp_replace({_FOLDER}, '[^/]+/$', '') END)
     || 'y' || pos AS parent,
  {_BARE} || '?p=' || pos AS query,
  regexp_replace(url, '#.*$', '') || '#f' || pos AS fragment,
  regexp_extract(url, '^[a-z]+:') || '//cdn.example.org/z' AS network,
  'mailto:a@b' AS other
FROM links""")
def f4_url_resolve(t: Tables) -> DataFrame:
    url, n = F.col("url"), F.col("pos").cast("string")
    refs = {
        "rooted": F.col("href"),
        "relative": F.concat(F.lit("./x"), F.col("href")),
        "parent": F.concat(F.lit("../q/../y"), n),
        "query": F.concat(F.lit("?p="), n),
        "fragment": F.concat(F.lit("#f"), n),
        "network": F.lit("//cdn.example.org/z"),
        "other": F.lit("mailto:a@b"),
    }
    return flat_links(t.pages, "page_id", "url").select(
        "page_id", "pos", *[U.resolve_url(url, r).alias(name) for name, r in refs.items()]
    )


_IMAGE_TEST = """(regexp_matches(lower(u), '\\.(jpg|jpeg|png|gif|bmp|webp)$')
  OR regexp_matches(lower(u), 'image|img|photo|pic|attachment'))"""


@query(f"""
WITH {sql.LINKS}, u AS (
  SELECT page_id, pos, href, {sql.resolved()} || CASE WHEN pos % 3 = 0 THEN '.PNG' WHEN pos % 3 = 1 THEN '.html' ELSE '' END AS u
  FROM links)
SELECT page_id, pos, {_IMAGE_TEST} AS is_image, false AS bare_is_image FROM u""")
def f5_image_url(t: Tables) -> DataFrame:
    tail = F.when(F.col("pos") % 3 == 0, ".PNG").when(F.col("pos") % 3 == 1, ".html").otherwise("")
    full = F.concat(U.resolve_url(F.col("url"), F.col("href")), tail)
    return flat_links(t.pages, "page_id", "url").select(
        "page_id",
        "pos",
        U.is_image_url(full).alias("is_image"),
        U.is_image_url(F.concat(F.col("href"), F.lit(".jpg"))).alias("bare_is_image"),
    )


@query("""
SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(replace(text, ',', ''), '[0-9]+'), '') AS BIGINT), 0) AS number
FROM documents""")
def f6_number_from_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.number_from_text(F.col("text")).alias("number"))


@query(f"""
WITH {sql.LINKS}, s AS (
  SELECT page_id, pos, href || '-' || page_id || 'x' || pos || CASE WHEN pos % 2 = 0 THEN '.jpg' ELSE '-b' END AS src FROM links)
SELECT page_id, pos, regexp_replace(src, '-[0-9]+x[0-9]+(\\.[a-zA-Z]+)$', '\\1') AS src FROM s""")
def f7_strip_size_suffix(t: Tables) -> DataFrame:
    tail = F.when(F.col("pos") % 2 == 0, ".jpg").otherwise("-b")
    src = F.concat("href", F.lit("-"), "page_id", F.lit("x"), "pos", tail)
    return flat_links(t.pages, "page_id").select("page_id", "pos", U.strip_size_suffix(src).alias("src"))


@query(f"""
WITH {sql.LINKS}
SELECT page_id, pos, CASE
  WHEN pos % 4 = 0 THEN {sql.base('url')} || '/forum.php?mod=attachment&aid=' || pos || '&nothumb=yes'
  WHEN pos % 4 = 1 THEN {sql.base('url')} || '/forum.php?mod=attachment&aid=' || pos || '&nothumb=yes'
  WHEN pos % 4 = 2 THEN {sql.base('url')} || '/forum.php?mod=attachment&nothumb=no&aid=' || pos
  ELSE {sql.base('url')} || href END AS image_url
FROM links""")
def f8_full_size_attachment(t: Tables) -> DataFrame:
    n, site = F.col("pos").cast("string"), U.base_url(F.col("url"))
    raw = (
        F.when(F.col("pos") % 4 == 0, F.concat(F.lit("forum.php?mod=attachment&aid="), n))
        .when(F.col("pos") % 4 == 1, F.concat(F.lit("/forum.php?mod=attachment&aid="), n))
        .when(F.col("pos") % 4 == 2, F.concat(F.lit("forum.php?mod=attachment&nothumb=no&aid="), n))
        .otherwise(F.concat(site, "href"))
    )
    return flat_links(t.pages, "page_id", "url").select(
        "page_id", "pos", U.full_size_attachment(raw, site).alias("image_url")
    )


def _image_urls(t: Tables) -> DataFrame:
    """Image-like URLs made from the links of the pages."""
    tail = F.when(F.col("pos") % 3 == 0, "-300x200.jpg").when(F.col("pos") % 3 == 1, ".WEBP?size=1").otherwise("")
    return flat_links(t.pages, "page_id", "url").select(
        "page_id", "url", "pos", F.concat(U.base_url(F.col("url")), "href", tail).alias("image_url")
    )


_IMAGE_URLS = f"""WITH {sql.LINKS}, img AS (
  SELECT page_id, url, pos, {sql.resolved()} || CASE WHEN pos % 3 = 0 THEN '-300x200.jpg'
    WHEN pos % 3 = 1 THEN '.WEBP?size=1' ELSE '' END AS image_url FROM links)"""


@query(f"{_IMAGE_URLS} SELECT page_id, pos, {sql.file_name('image_url')} AS file_name FROM img")
def f9_image_filename(t: Tables) -> DataFrame:
    return _image_urls(t).select("page_id", "pos", U.image_filename(F.col("image_url")).alias("file_name"))


_EXT = """lower(split_part(split_part(image_url, '.', -1), '?', 1))"""


@query(f"""{_IMAGE_URLS}, e AS (
  SELECT *, CASE WHEN {_EXT} IN ('jpg', 'jpeg', 'png', 'gif', 'webp') THEN {_EXT} ELSE 'jpg' END AS ext FROM img)
SELECT page_id, pos,
  {sql.host('url')} || '_' || {sql.thread_id('url')} || '_' || format('{{:03d}}', pos) || '_20240131_235959.' || ext AS file_name,
  'image_' || format('{{:03d}}', pos) || '_20240131_235959.' || ext AS plain_name
FROM e""")
def f10_generated_filename(t: Tables) -> DataFrame:
    url, image, at = F.col("url"), F.col("image_url"), F.lit("2024-01-31 23:59:59").cast("timestamp")
    return _image_urls(t).select(
        "page_id",
        "pos",
        U.generated_filename(image, F.col("pos"), at, U.host(url), U.thread_id(url)).alias("file_name"),
        U.generated_filename(image, F.col("pos"), at).alias("plain_name"),
    )


@query(f"""
SELECT page_id, {sql.host('url')} AS site, {sql.host('url')} AS site_of_host,
  CASE WHEN page_id % 2 = 0 THEN 'all' ELSE 'board' || page_id END AS board
FROM pages""")
def f11_site_key(t: Tables) -> DataFrame:
    board = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 2 == 1, F.concat(F.lit("board"), "page_id"))
    return t.pages.select(
        "page_id",
        U.site_key(F.col("url")).alias("site"),
        U.site_key(U.host(F.col("url"))).alias("site_of_host"),
        U.board_key(board).alias("board"),
    )


@query("""
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k,
  CASE WHEN event_type = 'view' THEN 'null' ELSE '{"kind":"' || event_type || '","user":' || user_id || '}' END AS encoded,
  CASE WHEN event_type = 'view' THEN 'null' ELSE event_type END AS plain
FROM events""")
def f12_json(t: Tables) -> DataFrame:
    n = F.col("event_id") % 10
    stored = F.when(n == 0, F.concat(F.lit("{"), "props")).when(n == 5, "null").otherwise(F.col("props"))
    shown = F.col("event_type") != "view"
    record = F.when(shown, F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return t.events.select(
        "event_id",
        X.decode_json(stored, "k bigint")["k"].alias("k"),
        X.encode_json(record, T.StructType()).alias("encoded"),
        X.encode_json(F.when(shown, F.col("event_type")), T.StringType()).alias("plain"),
    )


@query("""
SELECT page_id, CAST(n AS INTEGER) AS page, CASE WHEN n = 1 THEN url WHEN contains(url, '?') THEN url || '&page=' || n
  ELSE url || '?page=' || n END AS page_url
FROM pages, (SELECT unnest(range(1, 4)) AS n)""")
def f13_page_url(t: Tables) -> DataFrame:
    listed = t.pages.select("page_id", "url", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    return listed.select("page_id", "page", U.page_url(F.col("url"), F.col("page")).alias("page_url"))


@query("""
SELECT p_partkey, NOT (contains(lower(src), 'avatar') OR coalesce(try_cast(w AS INTEGER) < 100, false)
  OR ((w IS NULL OR try_cast(w AS INTEGER) IS NOT NULL) AND h < 100)) AS is_content
FROM (SELECT p_partkey, p_size * 5 AS h,
  CASE WHEN p_partkey % 3 = 0 THEN 'auto' WHEN p_partkey % 3 = 1 THEN CAST(p_size * 6 AS VARCHAR) END AS w,
  CASE WHEN p_partkey % 7 = 0 THEN 'My-AVATAR.png' ELSE p_name || '.png' END AS src FROM part)""")
def f14_content_image(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    src = F.when(key % 7 == 0, "My-AVATAR.png").otherwise(F.concat("p_name", F.lit(".png")))
    width = F.when(key % 3 == 0, "auto").when(key % 3 == 1, (F.col("p_size") * 6).cast("string")).otherwise("")
    height = (F.col("p_size") * 5).cast("string")
    attrs = F.create_map(F.lit("src"), src, F.lit("width"), width, F.lit("height"), height)
    return t.part.withColumn("img", F.struct(attrs.alias("attrs"))).select(
        "p_partkey", is_content_image(F.col("img")).alias("is_content")
    )


@query(f"SELECT page_id, {sql.base('url')} AS base_url FROM pages")
def f15_base_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.base_url(F.col("url")).alias("base_url"))


@query("""
SELECT doc_id, CASE WHEN n_chars < 300 THEN 'too_few_bytes' WHEN n_chars > 3000 THEN 'too_many_bytes'
  WHEN doc_id % 11 = 0 THEN 'unreadable' WHEN doc_id * 7 % 600 < 200 OR doc_id * 13 % 600 < 200 THEN 'too_small'
  WHEN lang NOT IN ('en', 'fr') THEN 'format' END AS reject_reason
FROM documents""")
def q1_image_quality(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    width = F.when(n % 11 != 0, n * 7 % 600)
    reason = I.reject_reason(
        F.col("n_chars"), width, n * 13 % 600, F.col("lang"), min_bytes=300, max_bytes=3000, formats=["en", "fr"]
    )
    return t.documents.select("doc_id", reason.alias("reject_reason"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'jpeg' END AS format,
  CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id % 900 + 1 AS INTEGER) END AS width,
  CASE WHEN doc_id % 4 < 3 THEN CAST(n_chars % 900 + 1 AS INTEGER) END AS height,
  CASE WHEN doc_id % 4 = 3 THEN 'unreadable' WHEN doc_id % 900 + 1 < 200 OR n_chars % 900 + 1 < 200 THEN 'too_small' END
    AS reject_reason
FROM documents""")
def q1_image_headers(t: Tables) -> DataFrame:
    def number(c: Column, size: int, little: bool = False) -> Column:
        text = F.lpad(F.hex(c), size * 2, "0")
        parts = [F.substring(text, 1 + 2 * i, 2) for i in range(size)]
        return F.concat(*(parts[::-1] if little else parts))

    w, h = F.col("doc_id") % 900 + 1, F.col("n_chars") % 900 + 1
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(w, 4), number(h, 4))
    gif = F.concat(F.lit("474946383961"), number(w, 2, True), number(h, 2, True))
    # A segment of application data comes before the frame header.
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), number(h, 2), number(w, 2))
    head = F.when(F.col("doc_id") % 4 == 0, png).when(F.col("doc_id") % 4 == 1, gif).when(F.col("doc_id") % 4 == 2, jpeg)
    content = F.unhex(F.concat(F.coalesce(head, F.lit("00")), F.hex("text")))
    files = t.documents.select("doc_id", content.alias("content"))
    return I.checked_images(files, min_bytes=0, max_bytes=10**9).select(
        "doc_id", "header.format", "header.width", "header.height", "reject_reason"
    )


def _documents_as_threads(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").cast("string").alias("thread_id"), F.col("source").alias("board"), F.col("lang").alias("title")
    )


@query("SELECT CAST(doc_id AS VARCHAR) AS thread_id, source AS board, lang AS title FROM documents WHERE source = 'src3'")
def q2_threads_of_board(t: Tables) -> DataFrame:
    return state.threads_of_board(_documents_as_threads(t), "src3")


@query("SELECT CAST(doc_id AS VARCHAR) AS thread_id, source AS board, lang AS title FROM documents WHERE doc_id = 17")
def q3_thread_by_id(t: Tables) -> DataFrame:
    return state.thread_by_id(_documents_as_threads(t), "17")


_REJECTED = "regexp_matches(lower(href), 'javascript:|#|user|member|avatar')"


@query(f"""
WITH {sql.LINKS}
SELECT page_id, pos, {_REJECTED} AS rejected,
  NOT {_REJECTED} AND regexp_matches(lower(href), 'thread|topic|viewthread|t/|tid=') AS is_thread
FROM (SELECT page_id, pos, CASE pos % 5 WHEN 0 THEN href || '#top' WHEN 1 THEN '/Thread' || href WHEN 2 THEN href || 't/' ELSE href END
  AS href FROM links)""")
def q4_thread_links(t: Tables) -> DataFrame:
    n = F.col("pos") % 5
    href = (
        F.when(n == 0, F.concat("href", F.lit("#top")))
        .when(n == 1, F.concat(F.lit("/Thread"), "href"))
        .when(n == 2, F.concat("href", F.lit("t/")))
        .otherwise(F.col("href"))
    )
    return flat_links(t.pages, "page_id").withColumn("href", href).select(
        "page_id", "pos", U.is_rejected_link(F.col("href")).alias("rejected"), U.is_thread_link(F.col("href")).alias("is_thread")
    )
