"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and returns a table that is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of documents.

1. language: documents without a language (no text, or no letter) go.
2. near_duplicates: of each group of linked documents the one with the smallest
   id stays. Rows that share an id are one document, and the row whose text has
   the smallest hash stays; rows without an id all stay.
3. decontamination: documents with at least one word in twenty inside benchmark
   windows go.
4. secrets: every span is replaced by a mark, and ``n_chars`` follows; no
   document goes, and a NULL text stays NULL.
5. packing: the pieces of all documents with their place in sequences of 1,024
   tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import decontaminate, jaccard_join, language_id, packing, secret_scan
from harrow.llm.common import kept, residue


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = language_id.learn_profiles(docs, residue("doc_id", 3) != 1)
    found = language_id.identify(docs, learned, with_row=True)
    # Where no profile was learned every text is unknown; only texts without a letter go.
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) | F.col("row.text").rlike(r"\p{L}")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = kept(jaccard_join.near_duplicates(docs, share=75, width=5), "near-duplicates")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    repeated = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = kept(repeated, "repeated-ids")
    left_out = kept(gone.unionByName(repeated), "left-out")
    once = docs.join(left_out.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    first = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row"))).alias("first"))
    return once.unionByName(first.select("first.row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_passages(docs, benchmark, width=13, with_row=True)
    return found.where(~decontaminate.contaminated()).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(docs, with_row=True).withColumn("clean", secret_scan.redacted(F.col("text"), F.col("spans")))
    some = F.size("spans") > 0
    values = {
        "text": F.when(some, F.col("clean")).otherwise(F.col("row.text")),
        "n_chars": F.when(some, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return found.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("best_fit_packing", best_fit_packing),
]
# Token ids and packing are beyond SQL; tests/llm holds the stages against a plain loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
