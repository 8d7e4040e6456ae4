"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import (
    chat_tree, cover_tree, decontaminate, fill_middle, hmm, jaccard_join, language_id, neighbour_graph, oracles, packing, phrases, secret_scan, token_blocks, token_counts,
)
from harrow.llm.common import residue

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learned = language_id.learn_profiles(docs, residue("doc_id", 3) != 1)
    return language_id.identify(docs, learned).select(
        "doc_id", (residue("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "distance", "n_grams")


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents"), share=75, width=5)


def op2_jaccard_links(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.counted_links(table(spark, folder, "documents"), share=75, width=5)


def op3_chat_tree(spark: SparkSession, folder: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat_tree.read_conversations(chat_tree.build(rows)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), VOCABULARY, capacity=1024, end_id=2)


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secret_scan.BASE]))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"), secret_scan.span_list(F.col("spans")).alias("spans"))


def op6_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return token_blocks.read_blocks(token_blocks.write_blocks(table(spark, folder, "documents"), VOCABULARY, end_id=0))


def op7_cover_tree_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"), width=13)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op9_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score_documents(table(spark, folder, "documents"), residue("doc_id", 10) != 0)


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), VOCABULARY, limit=512)


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"), seed=1, rate=90, spm=20)
    output, form = F.col("output"), F.col("form")
    prefix_chars, middle_chars = fill_middle.part_chars(output, form)
    return made.select(
        "doc_id", "n", "form", prefix_chars.alias("prefix_chars"), middle_chars.alias("middle_chars"),
        F.sha2(output, 256).alias("output_sha256"), F.sha2(fill_middle.restored(output, form), 256).alias("restored_sha256"))


def op12_neighbour_graph(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_graph.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op13_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), least=10, max_words=3, share=50, first=2000)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_jaccard_join, op2_jaccard_links, op3_chat_tree, op4_best_fit_packing, op5_secret_scan, op6_token_blocks,
    op7_cover_tree_top_k, op8_decontamination, op9_hidden_markov, op10_token_counts, op11_fill_in_middle,
    op12_neighbour_graph, op13_phrase_mining,
)}
SQL = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
