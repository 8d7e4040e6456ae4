"""Files as a source, written from the documents: a hundred texts to a file, in two lots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators import dedup
from harrow.plans.registry import Tables, query
from harrow.session import shared_dir
from harrow.sources.files import scan_files
from harrow.sources.sinks import append_table, with_bucket, write_table, write_version

# The files of odd numbers come twice, the second time under a negative number.
_FILES = """files AS (
  SELECT f AS file, md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS content_hash
  FROM (SELECT *, doc_id // 100 AS f FROM documents UNION ALL SELECT *, -1 - doc_id // 100 FROM documents WHERE doc_id // 100 % 2 = 1) GROUP BY 1)"""


def _written(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The scans after the first and the second lot; copies of odd files come with the second."""
    folder = f"{shared_dir(t.spark, 'files')}/in"
    rows = t.documents.select(F.floor(F.col("doc_id") / 100).alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.unionByName(rows.where("file % 2 = 1").withColumn("file", -1 - F.col("file")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n")
    files = rows.groupBy("file").agg(joined.alias("value"))
    scans: list[DataFrame] = []
    for lot in ("file >= 0 AND file % 2 = 0", "file < 0 OR file % 2 = 1"):
        files.where(lot).write.mode("append").partitionBy("file").text(folder)
        scans.append(scan_files(t.spark, folder, scans[-1] if scans else None))
    number = F.regexp_extract("path", "file=(-?[0-9]+)", 1).cast("bigint")
    named = [s.where(~F.contains("path", F.lit("_SUCCESS"))).withColumn("file", number) for s in scans]
    return named[0], named[1]


@query(f"WITH {_FILES} SELECT file, content_hash, file < 0 OR file % 2 = 1 AS is_new FROM files")
def s6_files(t: Tables) -> DataFrame:
    """All files after both lots; those of the second are the new ones."""
    return _written(t)[1].select("file", "content_hash", "is_new")


@query(f"""WITH {_FILES}, fresh AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY file) AS n FROM files WHERE file < 0 OR file % 2 = 1)
SELECT file, CASE WHEN n > 1 OR content_hash IN (SELECT content_hash FROM files WHERE file >= 0 AND file % 2 = 0) THEN 'same_bytes' END AS reason FROM fresh""")
def s6_new_copies(t: Tables) -> DataFrame:
    """D5 over the new files, against those of the first scan."""
    before, after = _written(t)
    fresh = after.where("is_new").withColumn("phash", F.lit(None).cast("string"))
    return dedup.file_verdicts(fresh, "content_hash", "phash", "file", before.select("content_hash")).select("file", "reason")


@query("""
WITH o AS (SELECT o_orderstatus, count(*) AS n, sum(o_custkey) AS s FROM orders GROUP BY 1)
SELECT 'whole' AS kind, o_orderstatus AS part, n, s FROM o UNION ALL SELECT 'appended', o_orderstatus, 2 * n, 2 * s FROM o
UNION ALL SELECT 'version', o_orderstatus, n, s FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT 'bucketed', 'all', count(*), sum(o_custkey) FROM orders""")
def s7_written_tables(t: Tables) -> DataFrame:
    """What each way of writing gives back: whole tables, appended rows, a version written twice, buckets as folders."""
    root = shared_dir(t.spark, "sinks")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    append_table(rows, f"{root}/appended")
    for part in ("O", "F"):
        version = write_version(rows.where(F.col("o_orderstatus") == part), root, 3)
    written = {
        "whole": write_table(rows, f"{root}/whole", "o_orderstatus"), "appended": append_table(rows, f"{root}/appended"), "version": version,
        "bucketed": write_table(with_bucket(rows, "o_orderkey", 16).withColumn("o_orderstatus", F.lit("all")), f"{root}/bucketed", "bucket"),
    }
    out = None
    for kind, path in written.items():
        counted = t.spark.read.parquet(path).groupBy(F.col("o_orderstatus").cast("string").alias("part")).agg(
            F.count("*").alias("n"), F.sum("o_custkey").alias("s")).select(F.lit(kind).alias("kind"), "part", "n", "s")
        out = counted if out is None else out.unionByName(counted)
    return out
