"""Keyed crawl state and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import urls as U
from harrow.operators import state, stats
from harrow.plans import sql
from harrow.plans.registry import Tables, query

_NOW = "2024-06-01 12:00:00"


def now():
    return F.lit(_NOW).cast("timestamp")


def shaped(df: DataFrame, schema: str, *extra: str) -> DataFrame:
    """Columns of a state table in order; those not given are NULL."""
    fields = T.StructType.fromDDL(schema).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ],
        *extra,
    )


def _stored_threads(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("thread_id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("board"),
        F.lit(1).alias("image_count"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )
    return shaped(rows, state.THREADS)


def _thread_batch(t: Tables) -> DataFrame:
    # A third of the threads is new, so the stored ones of these numbers stay as they are.
    key = F.col("l_orderkey").cast("string")
    rows = t.lineitem.select(
        F.when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("n"), key)).otherwise(key).alias("thread_id"),
        F.concat(F.lit("part "), "l_partkey").alias("title"),
        F.col("l_returnflag").alias("board"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("images"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linenumber")).otherwise(0).alias("image_count"),
        F.when(F.col("l_linestatus") == "O", F.col("l_shipdate")).alias("created_at"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )
    return shaped(rows, state.THREADS, "seq")


@query(f"""
WITH b AS (SELECT CASE WHEN l_orderkey % 3 = 1 THEN 'n' ELSE '' END || l_orderkey AS thread_id, l_partkey * 1000 + l_suppkey * 8 + l_linenumber AS seq,
  'part ' || l_partkey AS title, l_returnflag AS board, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber
    WHEN l_linenumber % 2 = 0 THEN 2 ELSE 0 END AS image_count,
  CASE WHEN l_linestatus = 'O' THEN l_shipdate ELSE TIMESTAMP '{_NOW}' END AS made FROM lineitem),
n AS (SELECT thread_id, max_by(title, seq) AS title, max_by(image_count, seq) AS image_count,
  min_by(made, seq) AS made FROM b GROUP BY 1),
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS thread_id, o_orderpriority AS title, 1 AS image_count, o_orderdate FROM orders)
SELECT coalesce(n.thread_id, o.thread_id) AS thread_id,
  CASE WHEN n.thread_id IS NOT NULL THEN n.title ELSE o.title END AS title,
  CASE WHEN n.thread_id IS NOT NULL THEN n.image_count ELSE o.image_count END AS image_count,
  coalesce(o_orderdate, made) AS created_at,
  CASE WHEN n.thread_id IS NOT NULL THEN TIMESTAMP '{_NOW}' ELSE o_orderdate END AS updated_at
FROM n FULL OUTER JOIN o ON n.thread_id = o.thread_id""")
def c1_upsert_threads(t: Tables) -> DataFrame:
    merged = state.upsert_threads(_stored_threads(t), _thread_batch(t), now())
    return merged.select("thread_id", "title", "image_count", "created_at", "updated_at")


@query(f"""
WITH o AS (SELECT d.doc_id::VARCHAR AS doc_id, source, CAST(quality AS BOOLEAN) AS flag FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
n AS (SELECT CASE WHEN d.doc_id % 3 = 1 THEN 'n' ELSE '' END || d.doc_id AS doc_id, lang, coalesce(toxic = 0, false) AS flag
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT coalesce(n.doc_id, o.doc_id) AS article_id,
  CASE WHEN n.doc_id IS NOT NULL THEN lang ELSE source END AS title,
  CASE WHEN n.doc_id IS NOT NULL THEN n.flag ELSE o.flag END AS images_downloaded,
  CASE WHEN o.doc_id IS NOT NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '{_NOW}' END AS created_at
FROM n FULL OUTER JOIN o ON n.doc_id = o.doc_id""")
def c2_upsert_articles(t: Tables) -> DataFrame:
    labelled = t.documents.join(t.labels, "doc_id", "left").withColumn("article_id", F.col("doc_id").cast("string"))
    stored = labelled.select(
        "article_id", F.col("source").alias("title"), F.col("quality").cast("boolean").alias("images_downloaded"),
        F.lit("2024-01-01").alias("created_at"),
    )
    # A third of the articles is new.
    named = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("n"), "article_id")).otherwise(F.col("article_id"))
    batch = labelled.select(
        named.alias("article_id"), F.col("lang").alias("title"), (F.col("toxic") == 0).alias("images_downloaded"), "doc_id"
    )
    merged = state.upsert_articles(
        shaped(stored, state.ARTICLES), shaped(batch, state.ARTICLES, "doc_id"), now(), "doc_id"
    )
    return merged.select("article_id", "title", "images_downloaded", "created_at")


@query(f"""
SELECT 'http://img/' || l_partkey AS url, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS file_size,
  CASE WHEN l_returnflag = 'N' THEN true ELSE l_returnflag = 'A' END AS success,
  CASE WHEN l_linestatus = 'O' THEN l_shipdate ELSE TIMESTAMP '{_NOW}' END AS created_at
FROM lineitem""")
def c3_image_records(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.concat(F.lit("http://img/"), "l_partkey").alias("url"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("file_size"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("success"),
        F.when(F.col("l_linestatus") == "O", F.col("l_shipdate")).alias("created_at"),
    )
    return state.image_records(shaped(rows, state.IMAGES), now()).drop("save_path", "metadata")


def _site(t: Tables) -> DataFrame:
    return t.events.withColumn("site", F.concat(F.lit("site"), F.col("user_id") % 50)).withColumn(
        "board", F.col("event_type")
    )


def _checkpoint_batch(t: Tables) -> DataFrame:
    rows = _site(t).select(
        "site", "board",
        F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 90).alias("current_page"),
        F.col("event_id").alias("last_thread_id"),
        F.when(F.col("event_id") % 5 != 0, "error").alias("status"),
        F.create_map(F.lit("crawled_count"), F.col("event_id")).alias("stats"),
        F.col("event_id").alias("seq"),
    )
    return shaped(rows, state.CHECKPOINTS, "seq")


def _stored_checkpoints(t: Tables) -> DataFrame:
    # Two sites in five are still there, the others have been given up.
    gone = F.when(F.col("user_id") % 50 < 20, F.col("site")).otherwise(F.concat(F.lit("old-"), "site"))
    rows = _site(t).withColumn("site", gone).groupBy("site", "board").agg(
        F.min("event_id").alias("last_thread_id"), F.lit("running").alias("status"), F.lit(0).alias("current_page"),
        F.create_map(F.lit("error_count"), F.lit(2)).alias("stats"), F.lit("old").alias("last_error"),
        F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-02").alias("updated_at"),
    )
    return shaped(rows, state.CHECKPOINTS)


_SITE = "'site' || user_id % 50 AS site, event_type AS board"
_STORED = """SELECT CASE WHEN user_id % 50 < 20 THEN 'site' ELSE 'old-site' END || user_id % 50 AS site, event_type AS board, min(event_id) AS e
  FROM events GROUP BY 1, 2"""


@query(f"""
WITH o AS ({_STORED}), n AS (SELECT {_SITE}, max(event_id) AS e FROM events GROUP BY 1, 2)
SELECT n.site, n.board, CAST(CASE WHEN n.e % 7 = 0 THEN 1 ELSE n.e % 90 END AS INTEGER) AS current_page, CAST(n.e AS VARCHAR) AS last_thread_id,
  CASE WHEN n.e % 5 = 0 THEN 'running' ELSE 'error' END AS status, n.e AS crawled,
  CASE WHEN o.site IS NULL THEN TIMESTAMP '{_NOW}' ELSE TIMESTAMP '2024-01-01' END AS created_at, TIMESTAMP '{_NOW}' AS updated_at
FROM n LEFT JOIN o ON o.site = n.site AND o.board = n.board
UNION ALL SELECT site, board, 0, CAST(e AS VARCHAR), 'running', NULL, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02'
FROM o WHERE site LIKE 'old%'""")
def c4_save_checkpoints(t: Tables) -> DataFrame:
    saved = state.save_checkpoints(_stored_checkpoints(t), _checkpoint_batch(t), now())
    return saved.select(
        "site", "board", "current_page", "last_thread_id", "status",
        F.try_element_at("stats", F.lit("crawled_count")).alias("crawled"), "created_at", "updated_at",
    )


@query(f"""
SELECT site, board, 1 AS current_page, 'running' AS status FROM ({_STORED}) WHERE board <> 'click' OR site LIKE 'old%'""")
def c4_load_checkpoints(t: Tables) -> DataFrame:
    stored = _stored_checkpoints(t)
    left = state.delete_checkpoints(stored, _site(t).where("event_type = 'click'").select("site", "board"))
    return state.load_checkpoints(left).select("site", "board", "current_page", "status")


@query(f"""
SELECT DISTINCT {_SITE} FROM events INTERSECT SELECT site, board FROM ({_STORED})""")
def c4_existing_checkpoints(t: Tables) -> DataFrame:
    targets = _site(t).select("site", "board").distinct()
    return state.existing_checkpoints(targets, _stored_checkpoints(t))


@query(f"""
WITH ev AS (SELECT {_SITE}, event_id, CASE WHEN event_id % 4 = 0 THEN 'completed' ELSE 'error' END AS kind FROM events),
cut AS (SELECT site, board, max(event_id) FILTER (event_id % 8 = 0) AS cut FROM ev GROUP BY 1, 2),
agg AS (SELECT ev.site, ev.board, max_by(kind, event_id) AS status, max(cut) AS cut,
    count(*) FILTER (kind = 'error' AND (cut IS NULL OR event_id > cut)) AS errors,
    max(event_id) FILTER (kind = 'error' AND (cut IS NULL OR event_id > cut)) AS last
  FROM ev JOIN cut ON cut.site = ev.site AND cut.board = ev.board GROUP BY 1, 2),
o AS ({_STORED})
SELECT o.site, o.board, status, CASE WHEN cut IS NULL THEN 2 + errors WHEN errors > 0 THEN errors END AS error_count,
  cut AS total_crawled, CASE WHEN errors > 0 THEN 'e' || last WHEN cut IS NULL THEN 'old' END AS last_error,
  TIMESTAMP '{_NOW}' AS updated_at
FROM o JOIN agg ON agg.site = o.site AND agg.board = o.board
UNION ALL SELECT site, board, 'running', 2, NULL, 'old', TIMESTAMP '2024-01-02' FROM o WHERE site LIKE 'old%'""")
def c5_transitions(t: Tables) -> DataFrame:
    event = F.col("event_id")
    happened = _site(t).select(
        "site", "board",
        F.when(event % 4 == 0, "completed").otherwise("error").alias("kind"),
        F.when(event % 4 != 0, F.concat(F.lit("e"), event)).alias("message"),
        F.when(event % 8 == 0, F.create_map(F.lit("total_crawled"), event)).alias("final_stats"),
        event.alias("seq"),
    )
    changed = state.apply_transitions(_stored_checkpoints(t), happened, now())
    return changed.select(
        "site", "board", "status",
        F.try_element_at("stats", F.lit("error_count")).alias("error_count"),
        F.try_element_at("stats", F.lit("total_crawled")).alias("total_crawled"),
        "last_error", "updated_at",
    )


@query("""
SELECT (SELECT count(*) FROM orders) AS total_threads, (SELECT count(*) FROM lineitem) AS total_images,
  (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS successful_downloads,
  (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS failed_downloads""")
def a1_storage_statistics(t: Tables) -> DataFrame:
    return stats.storage_statistics(t.orders, t.lineitem.select((F.col("l_returnflag") != "R").alias("success")))


@query("SELECT source AS board, count(*) AS n FROM documents WHERE lang <> 'de' AND source <> 'src1' GROUP BY 1")
def a2_board_counts(t: Tables) -> DataFrame:
    board = F.when(F.col("source") == "src1", "").when(F.col("lang") != "de", F.col("source"))
    return stats.board_counts(t.documents.select(board.alias("board")))


@query("""
SELECT l_linestatus, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS success,
  count(*) FILTER (l_returnflag = 'N') AS failed, count(*) FILTER (l_returnflag = 'R') AS skipped
FROM lineitem GROUP BY 1""")
def a3_download_counters(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    outcome = F.when(flag == "A", "success").when(flag == "N", "failed").otherwise("skipped")
    return stats.download_counters(t.lineitem.select("l_linestatus", outcome.alias("outcome")), "l_linestatus")


_N = "count(*) FILTER (kind = '{}' AND outcome = '{}')"


@query(f"""
WITH e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'thread' WHEN 'signup' THEN 'article' ELSE 'image' END AS kind,
  CASE WHEN event_type = 'error' THEN 'duplicate' WHEN value < 10 THEN 'failed' ELSE 'ok' END AS outcome FROM events)
SELECT user_id, {_N.format('page', 'ok')} AS pages_fetched, {_N.format('page', 'failed')} AS requests_failed,
  {_N.format('thread', 'ok')} AS threads_crawled, count(*) FILTER (kind = 'article') AS articles_found,
  {_N.format('article', 'ok')} AS articles_crawled, {_N.format('article', 'failed')} AS articles_failed,
  count(*) FILTER (kind = 'image') AS images_found, {_N.format('image', 'ok')} AS images_downloaded,
  {_N.format('image', 'failed')} AS images_failed, {_N.format('image', 'duplicate')} AS duplicates_skipped
FROM e GROUP BY 1""")
def a4_crawl_counters(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    outcomes = t.events.select(
        "user_id",
        F.when(kind == "view", "page").when(kind == "click", "thread").when(kind == "signup", "article").otherwise("image").alias("kind"),
        F.when(kind == "error", "duplicate").when(F.col("value") < 10, "failed").otherwise("ok").alias("outcome"),
    )
    return stats.crawl_counters(outcomes, "user_id")


@query("""
SELECT user_id, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS articles, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS images,
  count(*) FILTER (event_type <> 'error') AS tasks_ok, count(*) FILTER (event_type = 'error') AS tasks_failed,
  grouping(user_id) = 1 AS is_total
FROM events GROUP BY ROLLUP (user_id)""")
def a5_entry_totals(t: Tables) -> DataFrame:
    per_event = t.events.select(
        "user_id",
        (F.col("event_type") == "view").cast("bigint").alias("articles"),
        F.get_json_object("props", "$.k").cast("bigint").alias("images"),
        (F.col("event_type") != "error").alias("ok"),
    )
    return stats.entry_totals(per_event, "user_id")


def _tasks(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind != "signup", "completed").otherwise("waiting")
    return t.events.withColumn("status", status)


@query("""
SELECT user_id, count(*) AS total_tasks, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS completed_tasks,
  count(*) FILTER (event_type = 'error') AS failed_tasks,
  CASE WHEN count(*) FILTER (event_type <> 'signup') > 0 THEN count(*) FILTER (event_type = 'error') / count(*) FILTER (event_type <> 'signup')
    ELSE 0.0 END AS error_rate
FROM events GROUP BY 1""")
def a6_task_outcomes(t: Tables) -> DataFrame:
    return stats.task_outcomes(_tasks(t), "user_id")


@query("""
SELECT event_id, user_id, substr(repeat(props, 20), 1, 100) AS item FROM events WHERE event_type = 'error'
ORDER BY event_id DESC LIMIT 100""")
def a7_recent_errors(t: Tables) -> DataFrame:
    tasks = _tasks(t).select("event_id", "user_id", "status", F.repeat("props", F.lit(20)).alias("item"))
    return stats.recent_errors(tasks, "event_id", "item").drop("status")


@query("""
WITH tasks AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN NULL ELSE l_returnflag END AS outcome FROM lineitem)
SELECT l_orderkey AS article_id, count(outcome) AS processed, count(*) AS total_count FROM tasks GROUP BY 1 HAVING count(outcome) >= count(*)""")
def a8_completed_articles(t: Tables) -> DataFrame:
    raised = (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)
    tasks = t.lineitem.select(
        F.col("l_orderkey").alias("article_id"), F.when(~raised, F.col("l_returnflag")).alias("outcome")
    )
    totals = tasks.groupBy("article_id").agg(F.count("*").alias("total_count"))
    return stats.completed_articles(tasks.join(totals, "article_id"))


@query(f"""
SELECT {sql.host('url')} AS host, CAST(min(try_cast({sql.article_id('url')} AS BIGINT)) AS VARCHAR) AS min_article_id,
  CAST(max(try_cast({sql.article_id('url')} AS BIGINT)) AS VARCHAR) AS max_article_id FROM pages GROUP BY 1""")
def a11_id_range(t: Tables) -> DataFrame:
    url = F.col("url")
    ids = t.pages.select(U.host(url).alias("host"), U.article_id(url).alias("article_id"))
    return stats.id_range(ids, "article_id", "host")
