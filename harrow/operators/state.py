"""Keyed crawl state as pure functions old table + batch -> new table.

The result is written to a new version path by the caller; a table is never
overwritten while it is read. The clock is a parameter, so runs repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.skew import lookup

THREADS = (
    "thread_id string, title string, url string, board string, images array<string>, image_count int, "
    "metadata struct<author:string,post_time:string,views:bigint,replies:bigint>, content string, "
    "created_at timestamp, updated_at timestamp"
)
ARTICLES = (
    "article_id string, url string, title string, site string, board string, metadata map<string,string>, "
    "created_at timestamp, images_downloaded boolean"
)
IMAGES = (
    "url string, save_path string, file_size bigint, success boolean, metadata map<string,string>, created_at timestamp"
)
CHECKPOINTS = (
    "site string, board string, current_page int, last_thread_id string, last_thread_url string, status string, "
    "stats map<string,bigint>, last_error string, min_article_id string, max_article_id string, "
    "created_at timestamp, updated_at timestamp"
)
SEEN = "site string, board string, article_id string"

RUNNING, COMPLETED, ERROR = "running", "completed", "error"


def _upsert(
    stored: DataFrame, batch: DataFrame, keys: list[str], order: str, now: Column, touch: bool
) -> DataFrame:
    """Replace all columns but ``created_at``; the last row per key in the batch wins.

    The batch is reduced to one row per key by partial aggregation, so both
    sides of the outer join have unique keys and no key can be hot there.
    """
    replaced = [c for c in stored.columns if c not in (*keys, "created_at", "updated_at")]
    # A row without an order comes before all others; max_by alone would leave it out.
    place = F.struct(F.col(order).isNotNull(), F.col(order))
    latest = batch.groupBy(*keys).agg(
        F.max_by(F.struct(*replaced), place).alias("_new"),
        F.min_by(F.coalesce("created_at", now), place).alias("_created"),
    )
    hit = F.col("_new").isNotNull()

    def column(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c == "created_at":
            return F.coalesce(F.col("created_at"), F.col("_created")).alias(c)
        if c == "updated_at":
            return (F.when(hit, now).otherwise(F.col("updated_at")) if touch else F.col(c)).alias(c)
        return F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c)

    return stored.join(latest, keys, "full_outer").select(*[column(c) for c in stored.columns])


def upsert_threads(stored: DataFrame, batch: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """Key thread_id; an absent or zero image count becomes the number of images."""
    given = F.nullif(F.col("image_count"), F.lit(0))
    count = F.coalesce(given, F.size(F.coalesce("images", F.array().cast("array<string>"))))
    return _upsert(stored, batch.withColumn("image_count", count.cast("int")), ["thread_id"], order, now, True)


def upsert_articles(stored: DataFrame, batch: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """Key article_id; the flag takes the new value, which may clear it."""
    flagged = batch.withColumn("images_downloaded", F.coalesce("images_downloaded", F.lit(False)))
    return _upsert(stored, flagged, ["article_id"], order, now, False)


def image_records(batch: DataFrame, now: Column) -> DataFrame:
    """Rows to append, with the defaults filled in."""
    return batch.select(
        "url",
        "save_path",
        F.coalesce("file_size", F.lit(0)).cast("bigint").alias("file_size"),
        F.coalesce("success", F.lit(True)).alias("success"),
        "metadata",
        F.coalesce("created_at", now).alias("created_at"),
    )


def save_checkpoints(stored: DataFrame, batch: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """C4: key (site, board)."""
    filled = (
        batch.withColumn("current_page", F.coalesce("current_page", F.lit(1)))
        .withColumn("status", F.coalesce("status", F.lit(RUNNING)))
        .withColumn("stats", F.coalesce("stats", F.create_map().cast("map<string,bigint>")))
    )
    return _upsert(stored, filled, ["site", "board"], order, now, True)


def load_checkpoints(stored: DataFrame) -> DataFrame:
    """C4: checkpoints as a crawl reads them, defaults applied."""
    return (
        stored.withColumn("current_page", F.coalesce(F.nullif(F.col("current_page"), F.lit(0)), F.lit(1)))
        .withColumn("status", F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit(RUNNING)))
        .withColumn("stats", F.coalesce("stats", F.create_map().cast("map<string,bigint>")))
    )


def delete_checkpoints(stored: DataFrame, targets: DataFrame) -> DataFrame:
    """C4: remove the checkpoints of the targets."""
    return stored.join(targets.select("site", "board").distinct(), ["site", "board"], "left_anti")


def existing_checkpoints(targets: DataFrame, stored: DataFrame) -> DataFrame:
    """C4: the targets that have a checkpoint."""
    return targets.join(stored.select("site", "board"), ["site", "board"], "left_semi")


def apply_transitions(stored: DataFrame, events: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """Mark checkpoints completed or failed.

    ``events`` has (site, board, kind, message, final_stats, order). Completion
    replaces the counters when it brings some (which also forgets earlier
    errors); an error adds one to ``error_count``. Targets without a checkpoint
    are left alone. Several events of one target count as if applied in order.
    """
    keys = ["site", "board"]
    at = F.col(order)
    brings = (F.col("kind") == COMPLETED) & F.coalesce(F.size("final_stats") > 0, F.lit(False))
    replaced = events.where(brings).groupBy(*keys).agg(
        F.max(order).alias("_replaced_at"), F.max_by("final_stats", at).alias("_final")
    )
    counts = (
        lookup(events, replaced, keys, salt_by=order)
        .groupBy(*keys)
        .agg(
            F.max_by("kind", at).alias("_kind"),
            F.first("_final", ignorenulls=True).alias("_final"),
            F.count_if(_error_after("_replaced_at", order)).alias("_errors"),
            F.max_by(F.when(_error_after("_replaced_at", order), F.col("message")),
                     F.when(_error_after("_replaced_at", order), at)).alias("_message"),
        )
    )
    hit = F.col("_kind").isNotNull()
    base = F.coalesce("_final", "stats", F.create_map().cast("map<string,bigint>"))
    before = F.coalesce(F.try_element_at(base, F.lit("error_count")), F.lit(0))
    others = F.map_filter(base, lambda k, _: k != "error_count")
    counted = F.map_concat(others, F.create_map(F.lit("error_count"), before + F.col("_errors")))
    new = {
        "stats": F.when(F.col("_errors") > 0, counted).when(hit, base).otherwise(F.col("stats")),
        "last_error": F.when(F.col("_errors") > 0, F.col("_message"))
        .when(F.col("_final").isNotNull(), F.lit(None))
        .otherwise(F.col("last_error")),
        "status": F.when(hit, F.col("_kind")).otherwise(F.col("status")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return stored.join(counts, keys, "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in stored.columns]
    )


def _error_after(mark: str, order: str) -> Column:
    later = F.col(mark).isNull() | (F.col(order) > F.col(mark))
    return (F.col("kind") == ERROR) & later


def thread_by_id(threads: DataFrame, thread_id: str) -> DataFrame:
    """Q3."""
    return threads.where(F.col("thread_id") == thread_id)


def threads_of_board(threads: DataFrame, board: str | None = None) -> DataFrame:
    """Q2: all threads, or those of one board."""
    return threads.where(F.col("board") == board) if board else threads
