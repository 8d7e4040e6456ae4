"""Small tables with the awkward cases, and the given tables as Python rows."""

from __future__ import annotations

import duckdb

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and some, more text." for i in range(30_000))
AWKWARD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", None, 5), (4, "123 !!! ###", None, "b", 11),
    (5, "the cat sat on the mat and the dog sat on the cat", "en", "b", 49), (6, "the cat sat on the mat and the dog sat on the cat", "en", "b", 49),
    (None, "no identity here at all, none whatever", "en", "b", 1), (7, LONG, "en", "c", len(LONG)),
    (8, "der Hund und die Katze <|endoftext|>  mit  　 Leerzeichen\r\n\x0b", "de", "c", 1), (8, "der zweite Text mit derselben Nummer", "de", "c", 1),
    (9, "x" * 5000, "fr", "d", 1), (10, "\U0001f600 émoji ça va? l'été", "fr", "d", 1), (10, "\U0001f600 émoji ça va? l'été", "fr", "d", 1),
    (11, "a", "fr", "d", 1), (12, "don't  won't I'll\n\n\nend ", "en", "d", 1),
]
# Columns that bear the names operators give their own.
CLASHING = ["score", "lang_pred", "row", "key", "kinds", "spans", "n_words", "n_hit", "items", "bin", "n_tokens", "start", "component_id"]


def awkward(spark):
    rows = spark.createDataFrame(AWKWARD, DOCS)
    from pyspark.sql import functions as F

    return rows.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def given(name: str) -> list[tuple]:
    return duckdb.execute(f"SELECT * FROM '{FOLDER}/{name}.parquet'").fetchall()


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
