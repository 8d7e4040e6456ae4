"""Fill-in-the-middle against a plain loop over units."""

from __future__ import annotations

import hashlib
import re

import data
from harrow.llm import fill_middle
from pyspark.sql import functions as F


def plain(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def made(df, **more):
    out = fill_middle.fill_in_middle(df, **more)
    chars = fill_middle.part_chars(F.col("output"), F.col("form"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "text", "n", "form", "output", chars[0].alias("p"), chars[1].alias("m"), back.alias("back")).collect()


def same(rows, **more):
    for r in rows:
        assert (r.n, r.form, r.output, r.p, r.m) == plain(r.doc_id, r.text, **more), r.doc_id
        assert r.back == r.text


def test_awkward_rows(spark):
    same(made(data.awkward(spark)))
    assert made(data.empty(spark)) == []


def test_many_places_and_marks_in_parts(spark):
    texts = ["<<P<S<M>>", "P>S>M> <", "a$1 \\ $2 b", "x<P>y", "<S>", "a\r\n b\u0085c", "\U0001f600a\U0001f600", "\u0000 a", "é" * 50, "One two, three! " * 9, ""]
    table = [(i, t) for i in range(60) for t in texts] + [(None, "no id"), (3, None)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    rows = made(df)
    assert len(rows) == len(table)
    same(rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    same(made(df, seed=9, rate=100, spm=50), seed=9, rate=100, spm=50)


def test_given_documents(spark):
    rows = made(spark.read.parquet(f"{data.FOLDER}/documents.parquet"))
    same(rows)


def test_long_texts_are_counted_in_chunks(spark):
    text = ("word " * 5 + "é,\U0001f600" + "x" * 37) * 40_000
    df = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    same(made(df))
    for chunk in (1, 2, 7, 64):
        counted = spark.createDataFrame([(t,) for t in ("", "a", "ab", "a b", "abc1de", "x" * 200, "é1 ab" * 30)], "t string")
        for t, n in counted.select("t", fill_middle.unit_count(F.col("t"), chunk)).collect():
            assert n == len(re.findall("[A-Za-z]+|[^A-Za-z]", t))


def test_rows_are_kept_whole(spark):
    df = data.awkward(spark)
    out = fill_middle.fill_in_middle(df, with_row=True)
    assert out.select("row.*").columns == df.columns
    assert data.rows(out.select("row.*")) == data.rows(df)
