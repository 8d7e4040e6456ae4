"""Streams over the given tables, run to their end and read back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harrow.functions import urls as U
from harrow.operators import dom, state
from harrow.operators.extract import one, thread_list
from harrow.plans import sql
from harrow.plans.queries_extract import NAV_ITEMS
from harrow.plans.queries_frontier import ENTRIES, entries
from harrow.plans.queries_state import now, shaped
from harrow.plans.registry import Tables, query
from harrow.session import materialized, shared_dir
from harrow.sources.pages import table
from harrow.sources.state_table import StateTable
from harrow.streaming import crawl_stream as C


class StreamedTables(Tables):
    """The same tables as streams of files; a table may be one file or a folder of part files."""

    def __getattr__(self, name: str) -> DataFrame:
        schema = table(self.spark, self.folder, name).schema
        reader = self.spark.readStream.schema(schema)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if store.getFileStatus(path).isDirectory():
            return reader.parquet(path.toString())
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def _streamed(t: Tables) -> StreamedTables:
    return StreamedTables(t.spark, t.folder)


def _arrivals(rows: DataFrame, folder: str, part: Column, n: int) -> Iterator[DataFrame]:
    """The rows as a stream of files that come in ``n`` parts, one after the other."""
    held = materialized(rows.withColumn("_part", part), "arriving")
    for i in range(n):
        held.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(folder)
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


@query(f"""WITH {ENTRIES}
SELECT site, page, pos, article_id FROM marked WHERE is_new AND CAST(article_id AS INTEGER) % 10 <> 0""")
def st1_new_articles(t: Tables) -> DataFrame:
    """The log comes in five parts; the stream ends after each and goes on from its checkpoint."""
    root = shared_dir(t.spark, "new-articles")
    every = entries(t).drop("event_type")
    finished = every.where("cast(article_id as int) % 10 = 0").select("article_id").distinct()
    fifth = F.least(F.floor(F.col("page") * 5 / every.agg(F.max("page") + 1).first()[0]), F.lit(4))
    for found in _arrivals(every, f"{root}/in", fifth, 5):
        C.stream_new_articles(found, ["page", "pos"], finished, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").drop("batch")


_TASKS = f"""{sql.LINKS}, tasks AS (
  SELECT page_id, {sql.host('url')} AS site, {sql.article_id('url')} AS article_id, {sql.resolved()} || '-30x20.jpg' AS image_url,
    count(*) OVER (PARTITION BY page_id) AS total_count FROM links)"""


@query(f"""WITH {_TASKS}
SELECT site, article_id, CAST(total_count AS INTEGER) AS total_count, image_url,
  'img/' || site || '/' || article_id || '_' || {sql.file_name('image_url')} AS save_path FROM tasks""")
def st2_image_tasks(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "image-tasks")

    def articles(pages: DataFrame) -> DataFrame:
        url = F.col("url")
        images = F.transform("hrefs", lambda h: F.concat(U.base_url(url), h, F.lit("-30x20.jpg")))
        return dom.page_links(pages, "url").select(U.host(url).alias("site"), U.article_id(url).alias("article_id"), images.alias("images"))

    tasks = C.image_tasks(articles(_streamed(t).pages), F.lit("img"))
    C.ingest(tasks, lambda batch, _: batch, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").drop("batch")


@query(f"""WITH {_TASKS}, paths AS (
  SELECT 'img/' || site || '/' || article_id || '_' || {sql.file_name('image_url')} AS save_path FROM tasks)
SELECT save_path, count(*) AS n_images FROM paths GROUP BY 1 HAVING count(*) > 1""")
def st2_name_collisions(t: Tables) -> DataFrame:
    return C.name_collisions(st2_image_tasks(t))


def _outcomes(lines: DataFrame, t: Tables) -> DataFrame:
    """Image tasks of orders; a task that raised has no outcome."""
    totals = t.lineitem.groupBy(F.col("l_orderkey").alias("article_id")).agg(F.count("*").alias("total_count"))
    raised = (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)
    tasks = lines.select(F.col("l_orderkey").alias("article_id"), F.when(~raised, F.col("l_returnflag")).alias("outcome"))
    return tasks.join(totals, "article_id")


_DONE = """tasks AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN NULL ELSE l_returnflag END AS outcome FROM lineitem),
done AS (SELECT l_orderkey AS article_id, count(outcome) AS processed, count(*) AS total_count FROM tasks GROUP BY 1 HAVING count(outcome) >= count(*))"""


class Lost(RuntimeError):
    """Stands for a driver that dies."""


def _once(folder: str, spark: SparkSession) -> bool:
    """True at the first call for a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(place)


def _recorded(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Completions and stored articles of a stream that dies once, after it stored a batch and before it ended it."""
    root = shared_dir(t.spark, "completions")
    tasks = _outcomes(t.lineitem, t).withColumn("article_id", F.col("article_id").cast("string"))
    stored, snapshots = _article_tables(t)
    articles = StateTable(t.spark, f"{root}/articles", state.ARTICLES, ["article_id"], 16)
    articles.update(stored.withColumn("seq", F.lit(0)), lambda old, new: state.upsert_articles(old, new, now()))
    record = C.recorder(articles, snapshots, now(), "completions")

    def dies_once(done: DataFrame, batch_id: int) -> None:
        record(done, batch_id)
        if batch_id == 1 and _once(f"{root}/died", t.spark):
            raise Lost

    line = F.pmod(F.xxhash64("article_id", "outcome"), F.lit(3))
    for arrived in _arrivals(tasks, f"{root}/in", line, 3):
        while True:
            run = C.stream_completions(arrived, f"{root}/out", f"{root}/checkpoint", dies_once)
            try:
                run.awaitTermination()
                break
            except StreamingQueryException:
                if not _died(run):
                    raise
    return t.spark.read.parquet(f"{root}/out").drop("batch"), articles.snapshot()


def _died(run: StreamingQuery) -> bool:
    return Lost.__name__ in str(run.exception())


def _article_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Articles that are stored already, and what a task knows of its article."""
    named = t.orders.select(F.col("o_orderkey").cast("string").alias("article_id"), F.col("o_orderpriority").alias("title"))
    stored = t.orders.select(
        F.concat(F.when(F.col("o_orderkey") % 4 != 0, "old").otherwise(""), F.col("o_orderkey")).alias("article_id"), F.col("o_orderpriority").alias("title"),
        F.lit(False).alias("images_downloaded"),
    )
    return shaped(stored, state.ARTICLES), shaped(named, state.ARTICLES)


@query(f"WITH {_DONE} SELECT CAST(article_id AS VARCHAR) AS article_id, processed, total_count FROM done")
def st3_completions(t: Tables) -> DataFrame:
    return _recorded(t)[0]


_STORED = """
SELECT CAST(o_orderkey AS VARCHAR) AS article_id, o_orderpriority AS title,
  CASE WHEN o_orderkey IN (SELECT article_id FROM done) THEN true ELSE false END AS images_downloaded
FROM orders WHERE o_orderkey IN (SELECT article_id FROM done) OR o_orderkey % 4 = 0
UNION ALL SELECT 'old' || o_orderkey, o_orderpriority, false FROM orders WHERE o_orderkey % 4 <> 0"""


@query(f"WITH {_DONE} {_STORED}")
def st3_recorded_articles(t: Tables) -> DataFrame:
    return _recorded(t)[1].select("article_id", "title", "images_downloaded")


@query(f"WITH {_DONE} {_STORED}")
def st5_record_completions(t: Tables) -> DataFrame:
    """The batch form, up to the stored articles."""
    done = C.completions(_outcomes(t.lineitem, t)).withColumn("article_id", F.col("article_id").cast("string"))
    stored, snapshots = _article_tables(t)
    return C.record_completions(stored, snapshots, done, now()).select("article_id", "title", "images_downloaded")


@query(f"""WITH {sql.LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, {sql.resolved()} AS thread_url FROM links""")
def st4_resumable_ingest(t: Tables) -> DataFrame:
    """Pages come as many files, two to a batch; the third batch fails, and the next run goes on with it."""
    root = shared_dir(t.spark, "ingest")
    t.pages.write.option("maxRecordsPerFile", max(1, t.pages.count() // 12)).parquet(f"{root}/in")
    arriving = t.spark.readStream.schema(t.pages.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")

    def step(batch: DataFrame, number: int) -> DataFrame:
        listed = thread_list(dom.parse_pages(batch), NAV_ITEMS, one("a"), "page_id")
        if number == 2 and _once(f"{root}/died", t.spark):
            listed.limit(1).write.parquet(f"{root}/out/batch={number}")  # half a batch is left behind
            raise Lost
        return listed.select("page_id", "pos", "thread_url")

    while True:
        run = C.ingest(arriving, step, f"{root}/out", f"{root}/checkpoint")
        try:
            run.awaitTermination()
            return t.spark.read.parquet(f"{root}/out").drop("batch")
        except StreamingQueryException:
            if not _died(run):
                raise
