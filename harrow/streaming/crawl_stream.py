"""ST1-ST5: the list -> detail -> image flow as streams.

The stages are plain functions on DataFrames, so a batch run (ST5) and a stream
use the same code. What a stream must remember (which articles it has seen, how
many images of an article are done) is kept in Spark's state store, so a batch
costs what its own rows cost, however long the stream has run. A stream's results
go to one folder per micro-batch, written by overwriting, and stored tables note the
number of the batch: a replayed batch replaces itself, nothing is lost or doubled
when an executor or the driver dies (ST4).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harrow.functions import urls as U
from harrow.operators.skew import keep_first, without_known
from harrow.operators.state import upsert_articles
from harrow.operators.stats import completed_articles
from harrow.session import materialized
from harrow.sources.state_table import StateTable

BatchStep = Callable[[DataFrame, int], DataFrame]


def ingest(stream: DataFrame, step: BatchStep, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """ST4: run ``step`` on every micro-batch; its rows go to ``out/batch=<id>``.

    Takes all input there is and stops; a later call goes on from ``checkpoint``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def new_entries(entries: DataFrame, order: list[str], *known: DataFrame | None) -> DataFrame:
    """W1 + J2: first occurrence of every article that is not known yet."""
    fresh = keep_first(entries, ["site", "article_id"], order)
    for ids in known:
        if ids is not None and "site" in ids.columns:
            fresh = without_known(fresh, ids, ["site", "article_id"])
        elif ids is not None:
            # One id may occur on very many sites, and streams run without adaptive execution.
            fresh = without_known(fresh, ids, "article_id", salt_by="site")
    return fresh


def first_seen(entries: DataFrame, order: list[str], keys: tuple[str, ...] = ("site", "article_id")) -> DataFrame:
    """ST1: of a stream, the first row of every key, when the key comes for the first time.

    The state store holds one row for each key: its first row by (batch, ``order``),
    an arrival being the time Spark gives the micro-batch and gives again when it is
    replayed. A key is new in a batch if its first arrival is its latest one. Minima
    are combined before the shuffle, so a hot key costs no more than others. Entries
    without a key are left out. For the output mode ``update``.
    """
    rest = [c for c in entries.columns if c not in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    place = F.struct("_arrived", *[x for o in order for x in (F.col(o).isNull(), F.col(o))])
    grouped = (
        entries.where(known).withColumn("_arrived", F.current_timestamp())
        .groupBy(*keys).agg(F.min_by(F.struct("_arrived", *rest), place).alias("_first"), F.max("_arrived").alias("_latest"))
    )
    return grouped.where(F.col("_first._arrived") == F.col("_latest")).select(
        *[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in entries.columns])


def first_seen_within(entries: DataFrame, at: str, forget_after: str, keys: tuple[str, ...] = ("site", "article_id")) -> DataFrame:
    """ST1 with bounded state: a key counts as seen for ``forget_after`` of the event time ``at``.

    Of equal keys in one micro-batch any one stays.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return entries.where(known).withWatermark(at, forget_after).dropDuplicatesWithinWatermark(list(keys))


def stream_new_articles(
    entries: DataFrame, order: list[str], finished: DataFrame | None, out: str, checkpoint: str,
    at: str | None = None, forget_after: str | None = None,
) -> StreamingQuery:
    """ST1: new articles of a stream of list entries; no earlier output is read.

    Finished articles are looked up in each batch. With ``forget_after`` an article
    is forgotten again (see ``first_seen_within``).
    """
    fresh = first_seen_within(entries, at, forget_after) if at and forget_after else first_seen(entries, order)

    def step(batch: DataFrame, _: int) -> DataFrame:
        # One id may occur on very many sites, and streams run without adaptive execution.
        return batch if finished is None else without_known(batch, finished, "article_id", salt_by="site")

    return ingest(fresh, step, out, checkpoint, "append" if at and forget_after else "update")


def image_tasks(articles: DataFrame, root: Column, images: str = "images") -> DataFrame:
    """ST2: one task per image of an article, with what is needed to finish the article."""
    kept = [c for c in articles.columns if c != images]
    tasks = articles.withColumn("total_count", F.size(images)).select(
        *kept, "total_count", F.explode(images).alias("image_url")
    )
    name = U.image_filename(F.col("image_url"))
    return tasks.withColumn(
        "save_path", U.news_save_path(root, F.col("site"), F.col("article_id"), name)
    )


def name_collisions(tasks: DataFrame) -> DataFrame:
    """ST2: save paths that more than one image would be written to."""
    return tasks.groupBy("save_path").agg(F.count("*").alias("n_images")).where("n_images > 1")


def _counted(outcomes: DataFrame, at: str | None) -> DataFrame:
    """(article_id, processed, total_count[, at]): one row for each article of an Arrow batch."""
    kind = outcomes.schema["article_id"].dataType.simpleString()
    columns = ["article_id", "outcome", "total_count", *([at] if at else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({
                "article_id": batch.column("article_id"), "processed": pc.cast(pc.is_valid(batch.column("outcome")), pa.int64()),
                "total_count": pc.cast(batch.column("total_count"), pa.int64()), **({at: batch.column(at)} if at else {})})
            wanted = [("processed", "sum"), ("total_count", "max"), *([(at, "max")] if at else [])]
            summed = table.group_by("article_id").aggregate(wanted)
            yield from summed.select(["article_id", *[f"{c}_{f}" for c, f in wanted]]).rename_columns(["article_id", *[c for c, _ in wanted]]).to_batches()

    return outcomes.select(*columns).mapInArrow(run, f"article_id {kind}, processed long, total_count long" + (f", {at} timestamp" if at else ""))


def complete(outcomes: DataFrame, at: str | None = None, give_up: str | None = None, buckets: int = 256) -> DataFrame:
    """ST3: (article_id, processed, total_count) of an article when its last image is processed.

    The state holds a counter for each article that is not complete yet, as one table
    for each of ``buckets`` hash buckets, so a batch takes a few steps over columns
    for each bucket and none for each article; a cluster with many articles under way
    gives more buckets. A counter goes when its article is reported and, where the
    event time ``at`` and ``give_up`` are given, when nothing was heard of the article
    for so long. An outcome that comes after the report begins a counter of its own.
    """
    kind = outcomes.schema["article_id"].dataType.simpleString()
    patience = int(pd.Timedelta(give_up).total_seconds() * 1000) if at and give_up else 0
    counted = _counted(outcomes, at if patience else None)
    if patience:
        counted = counted.withWatermark(at, give_up)
    bucketed = counted.withColumn("_bucket", F.pmod(F.xxhash64("article_id"), F.lit(buckets)))

    def count(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = [some.drop(columns="_bucket") for some in rows]
        if state.exists:
            held = pa.ipc.open_stream(state.get[0]).read_pandas()
            if patience:
                held = held[held[at].isna() | (held[at] > pd.Timestamp(state.getCurrentWatermarkMs() - patience, unit="ms"))]
            told.insert(0, held)
        every = pd.concat(told, ignore_index=True)
        every["total_count"] = every["total_count"].fillna(0).astype("int64")
        sums = {"processed": "sum", "total_count": "max", **({at: "max"} if patience else {})}
        every = every.groupby("article_id", sort=False, as_index=False).agg(sums)
        done = (every["total_count"] > 0) & (every["processed"] >= every["total_count"])
        left = pa.Table.from_pandas(every[~done], preserve_index=False)
        if left.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, left.schema) as out:
                out.write_table(left)
            state.update((sink.getvalue().to_pybytes(),))
        elif state.exists:
            state.remove()
        if done.any():
            yield every.loc[done, ["article_id", "processed", "total_count"]]

    return bucketed.groupBy("_bucket").applyInPandasWithState(
        count, f"article_id {kind}, processed long, total_count long", "open binary", "update", GroupStateTimeout.NoTimeout)


def stream_completions(
    outcomes: DataFrame, out: str, checkpoint: str, record: Callable[[DataFrame, int], None] | None = None,
    at: str | None = None, give_up: str | None = None,
) -> StreamingQuery:
    """ST3: articles whose images are all processed, each reported once; ``record`` stores a batch of them first."""

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        if record is None:
            return batch
        done = materialized(batch, "completed")
        record(done, batch_id)
        return done

    return ingest(complete(outcomes, at, give_up), step, out, checkpoint, "update")


def recorder(articles: StateTable, snapshots: DataFrame, now: Column, writer: str) -> Callable[[DataFrame, int], None]:
    """ST3: stores the completed articles of a batch with their flag set, once for each batch number of ``writer``."""

    def record(done: DataFrame, batch_id: int) -> None:
        articles.update(completion_rows(snapshots, done), lambda old, new: upsert_articles(old, new, now), writer, batch_id)

    return record


def finished_articles(completions: DataFrame) -> DataFrame:
    """ST3: each completed article once; a later batch may report one again."""
    return completions.groupBy("article_id").agg(
        F.max("processed").alias("processed"), F.max("total_count").alias("total_count")
    )


def completion_rows(snapshots: DataFrame, done: DataFrame) -> DataFrame:
    """The articles of ``done`` as a batch for the article table, their flag set."""
    return (
        snapshots.join(done.select("article_id"), "article_id", "left_semi")
        .withColumn("images_downloaded", F.lit(True))
        .withColumn("created_at", F.lit(None).cast("timestamp"))
        .withColumn("seq", F.lit(0))
    )


def record_completions(articles: DataFrame, snapshots: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """ST5: store the completed articles with their flag set."""
    return upsert_articles(articles, completion_rows(snapshots, done), now)


def completions(outcomes: DataFrame) -> DataFrame:
    """ST5: the same result from a static table."""
    return completed_articles(outcomes)
