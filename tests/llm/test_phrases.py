"""Phrase mining against a plain count over pieces."""

from __future__ import annotations

import re
from collections import Counter

import data
import pytest
from harrow.llm import phrases
from pyspark.sql import functions as F


def plain(table, least=10, max_words=3, share=50, first=2000):
    f, n = Counter(), Counter()
    for text, lang in table:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    inside = {}
    for p, a in candidates.items():
        for i in range(1, len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p) - 1:
                    key = (p[0], *p[i:j])
                    inside[key] = max(inside.get(key, 0), a)
    out = {}
    for p, a in candidates.items():
        if 100 * inside.get(p, 0) >= share * a:
            continue
        cuts = [(1_000_000 * a * a // (f[p[:k + 1]] * f[(p[0], *p[k + 1:])]), k, f[p[:k + 1]], f[(p[0], *p[k + 1:])]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    found = []
    for lang, own in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:first], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found, key=repr)


def mined(df, **more):
    return data.rows(phrases.collocations(df, **more))


SPOKEN = ["New York is big. new york, NEW YORK! the new\tyork times; the times of new york", "a b a b a b c a b. a b\nc a a a a", None, "", " \t ", "...",
          "one two three four five " * 40, "ça va bien ça va mal", "x" * 3000 + " y"]


@pytest.mark.parametrize("most", [2, 3, 5])
def test_all_phrases_as_counted_plainly(spark, most):
    table = [(t, lang) for i in range(6) for t, lang in zip(SPOKEN, ["en", None, "en", "en", "de", "fr", "en", "fr", "en"], strict=True)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in table], "text string, lang string, block string, id string")
    assert mined(df, max_words=most) == plain(table, max_words=most)
    assert mined(df, max_words=most, least=3, first=4) == plain(table, max_words=most, least=3, first=4)


def test_blocks_and_windows_may_end_anywhere(spark):
    table = [(" ".join(f"w{(i * i + j) % 7}" for i in range(400)) + (". " if j % 2 else ""), "en" if j % 3 else "de") for j in range(6)]
    df = spark.createDataFrame(table, "text string, lang string").coalesce(1)
    wanted = plain(table)
    for block, window in ((1, 5), (7, 40), (64, 1 << 20), (10_000, 33)):
        assert mined(df, block_words=block, window_bytes=window) == wanted


def test_long_texts_and_long_words(spark):
    text = "alpha beta gamma delta " * 60_000 + "z" * 100_000 + " end, of it"
    table = [(text, "en"), (text, None)]
    df = spark.createDataFrame(table, "text string, lang string")
    assert mined(df, window_bytes=4096, block_words=50_000) == plain(table)


def test_hot_phrase_over_many_blocks(spark):
    table = [("in the end the same words. " * 3, "en")] * 400 + [(f"rare{i} word{i}", "en") for i in range(400)]
    df = spark.createDataFrame(table, "text string, lang string").repartition(16)
    assert mined(df, block_words=20) == plain(table)


def test_empty_table_and_texts_without_words(spark):
    assert mined(data.empty(spark)) == []
    assert mined(spark.createDataFrame([(None, None), (" . ", "en")], "text string, lang string")) == []


def test_awkward_rows(spark):
    df = data.awkward(spark)
    table = [(r.text, r.lang) for r in df.collect()]
    assert mined(df) == plain(table)


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000
    row = spark.range(1).select(
        F.lit(1).alias("id"), F.lit("en").alias("lang"), F.lit("a b").alias("phrase"), F.lit(big - 3).alias("a"),
        F.array(F.lit(big), F.lit(big - 3)).alias("firsts"), F.array(F.lit(big - 1), F.lit(big - 3)).alias("lasts"))
    assert phrases._scored(row, 2).first().score == 1_000_000 * (big - 3) ** 2 // (big * (big - 1))
