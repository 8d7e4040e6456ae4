"""Duplicate removal and the look-ups against stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.operators import dedup, frontier
from harrow.operators.dom import flat_links
from harrow.operators.skew import without_known
from harrow.plans import sql
from harrow.plans.registry import Tables, query
from harrow.session import materialized


@query("""
SELECT event_id, md5(user_id || '/' || event_type) AS url_hash,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS is_duplicate FROM events""")
def d1_url_duplicates(t: Tables) -> DataFrame:
    checks = t.events.select("event_id", F.concat_ws("/", "user_id", "event_type").alias("url"))
    return dedup.url_duplicates(checks, "url", "event_id").drop("url")


@query(f"""
WITH {sql.LINKS}, u AS (SELECT page_id, pos, {sql.resolved()} AS image_url FROM links)
SELECT page_id, pos, row_number() OVER (PARTITION BY image_url ORDER BY page_id, pos) > 1 AS is_duplicate FROM u""")
def d1_link_duplicates(t: Tables) -> DataFrame:
    links = flat_links(t.pages, "page_id", "url").select(
        "page_id", "pos", U.resolve_url(F.col("url"), F.col("href")).alias("image_url")
    )
    # Read twice below: once for the firsts, once for the marks.
    return dedup.url_duplicates(materialized(links, "links"), "image_url", ["page_id", "pos"]).drop("image_url", "url_hash")


@query("""
SELECT doc_id, md5(text) AS content_hash, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS is_duplicate
FROM documents""")
def d2_content_duplicates(t: Tables) -> DataFrame:
    return dedup.content_duplicates(t.documents, "text", "doc_id")


_BITS = """list_aggregate(list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0),
  lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN '1' ELSE '0' END), 'string_agg', '')"""


@query(f"""
WITH pics AS (SELECT vec_id AS seq, {_BITS} AS bits FROM embeddings
  UNION ALL SELECT vec_id + 1000000 AS seq, CASE WHEN vec_id % 3 > 0 THEN {_BITS} END AS bits FROM embeddings)
SELECT seq, bits, bits IS NOT NULL AND row_number() OVER (PARTITION BY bits ORDER BY seq) > 1 AS is_duplicate FROM pics""")
def d3_picture_duplicates(t: Tables) -> DataFrame:
    pics = t.embeddings.select(
        F.col("vec_id").alias("seq"), dedup.difference_hash(F.col("embedding"), 8).alias("phash")
    )
    again = pics.select(
        (F.col("seq") + 1000000).alias("seq"), F.when(F.col("seq") % 3 > 0, F.col("phash")).alias("phash")
    )
    # The hash is computed once; the several passes read the written narrow table.
    hashed = materialized(pics.unionByName(again), "picture-hashes")
    marked = dedup.picture_duplicates(hashed, "phash", "seq")
    bits = F.lpad(F.conv("phash", 16, 2), 56, "0")
    return marked.select("seq", bits.alias("bits"), "is_duplicate")


def _files(t: Tables) -> DataFrame:
    """Documents as stored files; their length plays the picture hash, NULL where it failed."""
    n = F.col("n_chars")
    files = t.documents.withColumn("phash", F.when(n % 10 != 0, n.cast("string")))
    return dedup.content_hashes(files, "text", "doc_id", "source", "phash")


_FILES = """files AS (SELECT doc_id, source, md5(text) AS content_hash,
  CASE WHEN n_chars % 10 <> 0 THEN CAST(n_chars AS VARCHAR) END AS phash FROM documents),
verdicts AS (SELECT doc_id, CASE
  WHEN row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 THEN 'same_bytes'
  WHEN phash IS NOT NULL AND row_number() OVER (PARTITION BY phash ORDER BY doc_id) > 1 THEN 'same_picture' END AS reason
  FROM files)"""


@query(f"WITH {_FILES} SELECT doc_id FROM verdicts WHERE reason IS NULL")
def d4_kept_files(t: Tables) -> DataFrame:
    verdicts = dedup.file_verdicts(_files(t), "content_hash", "phash", "doc_id")
    return dedup.kept_files(verdicts).select("doc_id")


@query("""
WITH files AS (SELECT doc_id, source, md5(text) AS content_hash,
  CASE WHEN n_chars % 10 <> 0 THEN CAST(n_chars AS VARCHAR) END AS phash FROM documents),
known AS (SELECT * FROM files WHERE source IN ('src0', 'src1')),
known_content AS (SELECT content_hash FROM known UNION SELECT md5(text) FROM benchmark),
fresh AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS copy FROM files WHERE source NOT IN ('src0', 'src1')),
uniq AS (SELECT * FROM fresh WHERE copy = 1 AND content_hash NOT IN (SELECT content_hash FROM known_content)),
pics AS (SELECT doc_id, phash, row_number() OVER (PARTITION BY phash ORDER BY doc_id) AS n FROM uniq),
kept AS (SELECT doc_id FROM pics WHERE phash IS NULL
  OR (n = 1 AND phash NOT IN (SELECT phash FROM known WHERE phash IS NOT NULL)))
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM kept) THEN NULL
  WHEN doc_id IN (SELECT doc_id FROM uniq) THEN 'same_picture' ELSE 'same_bytes' END AS reason FROM fresh""")
def d5_against_known(t: Tables) -> DataFrame:
    files = _files(t)
    stored = F.col("source").isin("src0", "src1")
    known = files.where(stored)
    known_content = known.select("content_hash").unionByName(t.benchmark.select(F.md5("text").alias("content_hash")))
    verdicts = dedup.file_verdicts(
        files.where(~stored), "content_hash", "phash", "doc_id", known_content, known.select("phash")
    )
    return verdicts.select("doc_id", "reason")


@query("""
WITH u AS (SELECT count(*) AS n, count(DISTINCT user_id || '/' || event_type) AS d FROM events)
SELECT n AS total_checked, n - d AS duplicates_found, d AS unique_images, (n - d) / n AS duplicate_rate FROM u""")
def d6_dedup_statistics(t: Tables) -> DataFrame:
    checks = t.events.select("event_id", F.concat_ws("/", "user_id", "event_type").alias("url"))
    return dedup.url_statistics(checks, "url")


@query(f"""WITH {_FILES}
SELECT count(*) AS files_checked, count(*) FILTER (reason = 'same_bytes') AS same_bytes,
  count(*) FILTER (reason = 'same_picture') AS same_picture, count(*) FILTER (reason IS NULL) AS files_kept FROM verdicts""")
def d6_file_statistics(t: Tables) -> DataFrame:
    return dedup.file_statistics(dedup.file_verdicts(_files(t), "content_hash", "phash", "doc_id"))


@query(f"WITH {_FILES} SELECT doc_id, reason FROM verdicts WHERE reason IS NOT NULL")
def d7_removal_list(t: Tables) -> DataFrame:
    verdicts = dedup.file_verdicts(_files(t), "content_hash", "phash", "doc_id")
    return dedup.removal_list(verdicts).select("doc_id", "reason")


@query(f"WITH {sql.LINKS} SELECT DISTINCT {sql.resolved()} AS url FROM links")
def d8_unvisited(t: Tables) -> DataFrame:
    links = flat_links(t.pages, "page_id", "url")
    return dedup.unvisited(links.select(U.resolve_url(F.col("url"), F.col("href")).alias("url")))


@query("""
SELECT l_orderkey AS thread_id, l_partkey, l_linenumber FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def j1_new_threads(t: Tables) -> DataFrame:
    threads = t.lineitem.select(F.col("l_orderkey").alias("thread_id"), "l_partkey", "l_linenumber")
    stored = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("thread_id"))
    return frontier.new_threads(threads, stored)


@query("""
SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity < 2)""")
def j1_hot_keys(t: Tables) -> DataFrame:
    """The salted form of J1: rows of hot keys are spread by event id."""
    known = t.lineitem.where("l_quantity < 2").select(F.col("l_suppkey").alias("user_id"))
    return without_known(t.events.select("event_id", "user_id"), known, "user_id", salt_by="event_id")


@query("""
SELECT doc_id AS article_id, lang FROM documents WHERE doc_id NOT IN (
  SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.source <> 'src5' AND coalesce(l.quality, 1) = 1)""")
def j2_new_articles(t: Tables) -> DataFrame:
    stored = t.documents.where("source <> 'src5'").join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("article_id"), (F.col("quality") == 1).alias("images_downloaded")
    )
    return frontier.new_articles(t.documents.select(F.col("doc_id").alias("article_id"), "lang"), stored)


_DETAIL = """detail AS (SELECT l_orderkey, max(l_returnflag) AS title, CAST(sum(l_quantity) AS BIGINT) AS images
  FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)"""


def _listed_and_detail(t: Tables) -> tuple[DataFrame, DataFrame]:
    listed = t.orders.select(
        F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("author")
    )
    detail = t.lineitem.where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("article_id")).agg(
        F.max("l_returnflag").alias("title"), F.sum("l_quantity").cast("bigint").alias("images")
    )
    return listed, detail


@query(f"""WITH {_DETAIL}
SELECT o_orderkey AS article_id, coalesce(d.title, o_orderpriority) AS title, o_orderstatus AS author, images
FROM orders JOIN detail d ON l_orderkey = o_orderkey""")
def j3_merge_detail(t: Tables) -> DataFrame:
    return frontier.merge_detail(*_listed_and_detail(t), "article_id")


@query(f"""WITH {_DETAIL}
SELECT o_orderkey AS article_id, o_orderpriority AS title, o_orderstatus AS author FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM detail)""")
def j3_failed_details(t: Tables) -> DataFrame:
    return frontier.failed_details(*_listed_and_detail(t), "article_id")
