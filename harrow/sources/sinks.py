"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256


def write_table(df: DataFrame, path: str, *partition_by: str) -> str:
    """A whole table to a path of its own."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def append_table(df: DataFrame, path: str) -> str:
    """Rows added to an append-only table."""
    df.write.mode("append").parquet(path)
    return path


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Version ``n`` of a keyed table; writing it again replaces it."""
    return write_table(df, f"{root}/version={version}")


def with_bucket(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """A bounded partition column, as ids are too many to be directory names."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
