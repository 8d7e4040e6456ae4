"""A folder of binary files as a source that reads every file once.

A scan lists all files, which reads none, and compares path, size and time with
the table of the scan before. The digests of known files are carried over; content
is read of new and changed files only. Most of these are newer than all that is
known, and Spark skips the others by their time before it opens them; files that
came with an older time are read by their paths, some at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.session import materialized

# Paths that a read names at once.
PATHS = 10_000
STAMP = ["path", "length", "modified"]
FILES = "path string, length long, modified timestamp, content_hash string"


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        .load(paths).withColumnRenamed("modificationTime", "modified")
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of every file under a folder; no file is opened."""
    return _files(spark, folder).select(*STAMP)


def _in_parts(rows: Iterator, size: int) -> Iterator[list[str]]:
    while part := [r[0] for r in islice(rows, size)]:
        yield part


def scan_files(spark: SparkSession, folder: str, known: DataFrame | None = None, paths_at_once: int = PATHS) -> DataFrame:
    """(path, length, modified, content_hash, is_new) of every file under a folder.

    ``known`` is the result of an earlier scan. A file whose path, size and time are
    in it keeps its digest unread; all others are read, and ``is_new`` marks them.
    Files that are gone are left out, and so are files that cannot be read, which
    the next scan tries again, and empty files, which Spark passes over.
    """
    listed = materialized(list_files(spark, folder), "listed-files")
    digest = F.md5("content").alias("content_hash")
    if known is None or known.isEmpty():
        return materialized(_files(spark, folder).select(*STAMP, digest, F.lit(True).alias("is_new")), "files")
    known = known.select(*STAMP, "content_hash")
    same = listed.join(known, STAMP).withColumn("is_new", F.lit(False))
    changed = materialized(listed.join(known, STAMP, "left_anti"), "changed-files")
    newest = known.agg(F.max("modified")).first()[0]
    parts = [same]
    if not changed.where(F.col("modified") > F.lit(newest)).isEmpty():
        parts.append(_files(spark, folder).where(F.col("modified") > F.lit(newest)).select(*STAMP, digest))
    late = changed.where(F.col("modified") <= F.lit(newest)).select("path").toLocalIterator()
    for paths in _in_parts(late, paths_at_once):
        parts.append(materialized(_files(spark, paths).select(*STAMP, digest), "late-files"))
    out = parts[0]
    for part in parts[1:]:
        # A file that changed after it was listed is left to the next scan.
        out = out.unionByName(part.join(changed, STAMP, "left_semi").withColumn("is_new", F.lit(True)))
    return materialized(out, "files")
