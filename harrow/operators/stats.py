"""Counters over state and outcome tables; all partially aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import integer_key


def storage_statistics(threads: DataFrame, images: DataFrame) -> DataFrame:
    """A1: one row of totals over both tables."""
    t = threads.select(F.lit(1).alias("thread"), F.lit(None).cast("boolean").alias("success"))
    i = images.select(F.lit(0).alias("thread"), F.col("success").cast("boolean").alias("success"))
    return t.unionByName(i).agg(
        F.count_if(F.col("thread") == 1).alias("total_threads"),
        F.count_if(F.col("thread") == 0).alias("total_images"),
        F.count_if(F.col("success")).alias("successful_downloads"),
        F.count_if(~F.col("success")).alias("failed_downloads"),
    )


def board_counts(threads: DataFrame, board: str = "board") -> DataFrame:
    """A2: threads per board; missing and empty boards are left out."""
    return threads.where(F.col(board) != "").groupBy(board).agg(F.count("*").alias("n"))


def download_counters(outcomes: DataFrame, *by: str) -> DataFrame:
    """A3: total, success, failed and skipped downloads."""
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "success").alias("success"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    )


def crawl_counters(outcomes: DataFrame, *by: str) -> DataFrame:
    """A4: all counters of a run in one pass over (kind, outcome) rows.

    ``kind`` is page, thread, article or image; ``outcome`` ok, failed or duplicate.
    """
    def n(kind: str, outcome: str | None = None):
        hit = F.col("kind") == kind
        return F.count_if(hit if outcome is None else hit & (F.col("outcome") == outcome))

    return outcomes.groupBy(*by).agg(
        n("page", "ok").alias("pages_fetched"),
        n("page", "failed").alias("requests_failed"),
        n("thread", "ok").alias("threads_crawled"),
        n("article").alias("articles_found"),
        n("article", "ok").alias("articles_crawled"),
        n("article", "failed").alias("articles_failed"),
        n("image").alias("images_found"),
        n("image", "ok").alias("images_downloaded"),
        n("image", "failed").alias("images_failed"),
        n("image", "duplicate").alias("duplicates_skipped"),
    )


def entry_totals(entries: DataFrame, entry: str) -> DataFrame:
    """A5: articles, images, finished and failed tasks per entry, and a total line."""
    return (
        entries.rollup(entry)
        .agg(
            F.grouping_id().alias("_all"),
            F.sum("articles").alias("articles"),
            F.sum("images").alias("images"),
            F.count_if("ok").alias("tasks_ok"),
            F.count_if(~F.col("ok")).alias("tasks_failed"),
        )
        .withColumn("is_total", F.col("_all") == 1)
        .drop("_all")
    )


def task_outcomes(tasks: DataFrame, *by: str) -> DataFrame:
    """Task counts and the share of failures among the finished ones."""
    completed = F.count_if(F.col("status") == "completed")
    failed = F.count_if(F.col("status") == "failed")
    return tasks.groupBy(*by).agg(
        F.count("*").alias("total_tasks"),
        completed.alias("completed_tasks"),
        failed.alias("failed_tasks"),
        F.when(completed + failed > 0, failed / (completed + failed)).otherwise(F.lit(0.0)).alias("error_rate"),
    )


def recent_errors(tasks: DataFrame, order: str, item: str, keep: int = 100, width: int = 100) -> DataFrame:
    """The newest failures with a shortened item text."""
    return (
        tasks.where(F.col("status") == "failed")
        .orderBy(F.col(order).desc())
        .limit(keep)
        .withColumn(item, F.substring(F.col(item), 1, width))
    )


def completed_articles(image_tasks: DataFrame) -> DataFrame:
    """Articles all of whose image tasks ended, well or badly.

    A task that raised has outcome NULL and does not count; an article without
    images has no tasks and never completes.
    """
    return (
        image_tasks.groupBy("article_id")
        .agg(F.count("outcome").alias("processed"), F.max("total_count").alias("total_count"))
        .where(F.col("processed") >= F.col("total_count"))
    )


def id_range(articles: DataFrame, ids: str, *by: str) -> DataFrame:
    """Smallest and largest whole-number id, of any length, as it is written; other ids are ignored."""
    number = integer_key(F.col(ids))
    return articles.groupBy(*by).agg(
        F.min_by(ids, number).alias("min_article_id"),
        F.max_by(ids, number).alias("max_article_id"),
    )
