"""Running values over ranges cut by rank, and whole numbers of any length."""

from __future__ import annotations

import random

import pytest
from harrow.functions.text import integer_key, integer_text
from harrow.operators import frontier, skew, stats
from pyspark.sql import functions as F


@pytest.fixture
def written(monkeypatch):
    """The tables that ``running`` writes."""
    tables = []
    plain = skew.materialized

    def noted(df, purpose):
        tables.append((purpose, plain(df, purpose)))
        return tables[-1][1]

    monkeypatch.setattr(skew, "materialized", noted)
    return tables


def test_an_outlier_does_not_gather_the_others(spark, written):
    n = 200_000
    df = spark.range(n).selectExpr("'k' by", "CASE WHEN id = 0 THEN 1000000000000000 ELSE id END AS at", "(id * 7919) % 100003 AS v")
    out = skew.running(df, ["by"], "at", [], F.col("v"), "top", block=10_000)
    ranges = dict(written)["ranges"].groupBy("_range").count().collect()
    assert len(ranges) > 10 and max(r["count"] for r in ranges) < 40_000
    got = out.where("at % 20011 = 5").orderBy("at").collect()
    for r in got:
        assert r.top == max(i * 7919 % 100003 for i in range(1, r["at"] + 1))


def test_one_hot_key_is_cut_like_all_others(spark, written):
    rows = [("hot", i, i % 977) for i in range(6000)] + [(f"s{i % 50}", i, i) for i in range(3000)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "site string, page int, v int")
    for strict in (False, True):
        got = {(r.site, r.page): r.m for r in skew.running(df, ["site"], "page", [], F.col("v"), "m", strict, 500).collect()}
        top = {}
        for site, page, v in sorted(rows):
            before = top.get(site)
            top[site] = v if before is None else max(before, v)
            assert got[(site, page)] == (before if strict else top[site])
    assert max(r["count"] for r in dict(written)["ranges"].groupBy("_range").count().collect()) < 2500


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 3), ("a", None, 9), ("a", 1, None)], "site string, page int, v int")
    assert {(r.site, r.page): r.m for r in skew.running(df, ["site"], "page", [], F.col("v"), "m", block=1).collect()} == {
        (None, 1): 5, (None, 2): 5, ("a", None): 9, ("a", 1): 9}
    assert skew.running(df.limit(0), ["site"], "page", [], F.col("v"), "m").collect() == []


NUMBERS = ["0", "-0", "7", "-7", " 12 ", "+5", "007", "9" * 18, "9" * 30, "-" + "9" * 30, "1" + "0" * 60, "-1" + "0" * 60, "9223372036854775808", "-12", "-21"]


def test_numbers_of_any_length(spark):
    df = spark.createDataFrame([(x,) for x in [*NUMBERS, "x", "", None, "1.5", "--1", "a1"]], "t string").withColumn("k", integer_key(F.col("t")))
    rows = df.where("k IS NOT NULL").orderBy("k").select("t", integer_text(F.col("k")).alias("plain")).collect()
    assert [int(r.t) for r in rows] == sorted(int(x) for x in NUMBERS)
    assert all(r.plain == str(int(r.t)) for r in rows)


def test_long_ids_are_not_lost(spark):
    ids = ["99999999999999999999", "5", "100000000000000000000", "x", "99999999999999999998", "100000000000000000001"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(ids)], "site string, page int, article_id string")
    rows = frontier.beyond_max(df, ["site"], "page", [], "article_id", F.lit(3), 2).orderBy("page").collect()
    assert [r.beyond_max for r in rows] == [True, False, True, False, False, True]
    assert [r.max_before for r in rows] == ["3", ids[0], ids[0], ids[2], ids[2], ids[2]]
    assert stats.id_range(df, "article_id", "site").first()[1:] == ("5", ids[5])


def test_last_new_entry_with_its_url(spark):
    df = spark.createDataFrame([("s", 1, 0, "a", "/a"), ("s", 2, 0, "a", "/other"), ("s", 2, 1, "b", "/b"), ("s", 3, 0, "b", "/x")],
                               "site string, page int, pos int, article_id string, article_url string")
    assert [tuple(r) for r in frontier.last_new_so_far(df, block=1).orderBy("page").collect()] == [
        ("s", 1, "a", "/a"), ("s", 2, "b", "/b"), ("s", 3, "b", "/b")]
