"""Page and file corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import urls as U

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages; a page that could not be fetched has NULL ``html``."""
    return spark.read.parquet(path)


def fetch_summary(pages: DataFrame) -> DataFrame:
    """How many pages of each host were fetched or are missing."""
    return pages.groupBy(U.host(F.col("url")).alias("host")).agg(
        F.count("html").alias("pages_fetched"),
        F.count_if(F.col("html").isNull()).alias("requests_failed"),
        F.sum(F.length("html")).alias("n_chars"),
    )


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder with its digest; unreadable files are left out."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .load(folder)
        .withColumn("content_hash", F.md5("content"))
    )


def thread_references(links: DataFrame, url: str = "url", name: Column | None = None, site_name: Column | None = None) -> DataFrame:
    """(url, thread_id, title, board) for a list of thread URLs."""
    tid = U.thread_id(F.col(url))
    title = F.concat(F.lit("Thread-"), tid)
    return links.select(
        F.col(url).alias("url"),
        tid.alias("thread_id"),
        (F.coalesce(F.nullif(name, F.lit("")), title) if name is not None else title).alias("title"),
        (site_name if site_name is not None else U.host(F.col(url))).alias("board"),
    )
