"""State tables in buckets: whole versions, untouched buckets, repeated batches."""

from __future__ import annotations

import glob
import shutil

import pytest
from harrow.operators import state
from harrow.sources.state_table import StateTable
from pyspark.sql import functions as F


@pytest.fixture
def now(spark):
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


def articles(spark, tmp_path, buckets=16):
    return StateTable(spark, f"file://{tmp_path}/articles", state.ARTICLES, ["article_id"], buckets)


def batch(spark, ids, title, done=True, seq=0):
    return spark.createDataFrame(
        [(i, f"/{i}", title, "s", "b", {"k": title}, None, done, seq) for i in ids], state.ARTICLES + ", seq int")


def titles(df):
    return {r.article_id: r.title for r in df.collect()}


def test_updates_equal_those_of_the_whole_table(spark, tmp_path, now):
    table = articles(spark, tmp_path)
    whole = spark.createDataFrame([], state.ARTICLES)
    for ids, title in ((range(0, 50), "a"), (range(40, 60, 3), "b"), ([7, 7, 99], "c"), ([], "d")):
        some = batch(spark, [str(i) for i in ids], title)
        step = lambda old, new: state.upsert_articles(old, new, now)
        assert table.update(some, step)
        whole = step(whole, some)
        assert sorted(map(str, table.snapshot().collect())) == sorted(map(str, whole.collect()))
    assert table.version() == 4


def test_untouched_buckets_are_not_read(spark, tmp_path, now):
    table = articles(spark, tmp_path)
    step = lambda old, new: state.upsert_articles(old, new, now)
    table.update(batch(spark, [str(i) for i in range(200)], "a"), step)
    touched = batch(spark, ["3"], "b").select(table.bucket()).first()[0]
    # Without their files, any read of the other buckets fails.
    aside = tmp_path / "aside"
    for folder in glob.glob(f"{tmp_path}/articles/data/1-*/_bucket=*"):
        home, name = folder.rsplit("/", 1)
        if name != f"_bucket={touched}":
            shutil.move(folder, aside / name)
    read = []

    def watched(old, new):
        read.extend(old.inputFiles())
        return step(old, new)

    assert table.update(batch(spark, ["3"], "b"), watched)
    assert {f.split("_bucket=")[1].split("/")[0] for f in read} == {str(touched)}
    assert titles(table.lookup(spark.createDataFrame([("3",)], "article_id string"))) == {"3": "b"}
    for folder in aside.iterdir():
        shutil.move(folder, f"{home}/{folder.name}")
    assert titles(table.snapshot()) == {str(i): "b" if i == 3 else "a" for i in range(200)}
    assert [f.rsplit("=", 1)[1] for f in glob.glob(f"{tmp_path}/articles/data/2-*/_bucket=*")] == [str(touched)]


def test_a_reader_keeps_its_version(spark, tmp_path, now):
    table = articles(spark, tmp_path, 4)
    step = lambda old, new: state.upsert_articles(old, new, now)
    assert table.snapshot().collect() == []
    table.update(batch(spark, ["1", "2"], "a"), step)
    early = table.snapshot()
    table.update(batch(spark, ["2", "3"], "b"), step)
    assert titles(early) == {"1": "a", "2": "a"}
    assert titles(table.snapshot(1)) == {"1": "a", "2": "a"}
    assert titles(table.snapshot()) == {"1": "a", "2": "b", "3": "b"}


def test_repeated_batches_and_dead_jobs(spark, tmp_path, now):
    table = articles(spark, tmp_path, 4)
    step = lambda old, new: state.upsert_articles(old, new, now)
    assert table.update(batch(spark, ["1"], "a"), step, "stream", 0)
    assert not table.update(batch(spark, ["1"], "again"), step, "stream", 0)

    def dies(old, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.update(batch(spark, ["1"], "b"), dies, "stream", 1)
    # A job that died after its data and before its manifest.
    batch(spark, ["9"], "left").drop("seq").withColumn("_bucket", table.bucket()).write.partitionBy("_bucket").parquet(f"{table.root}/data/2-dead")
    assert titles(table.snapshot()) == {"1": "a"}
    assert table.update(batch(spark, ["2"], "b"), step, "stream", 1)
    assert table.update(batch(spark, ["3"], "c"), step, "other", 0)
    assert titles(table.snapshot()) == {"1": "a", "2": "b", "3": "c"}
    assert table.clean() > 0
    assert not glob.glob(f"{tmp_path}/articles/data/2-dead/_bucket=*")
    assert titles(table.snapshot()) == {"1": "a", "2": "b", "3": "c"}


def test_rows_may_go_and_buckets_may_empty(spark, tmp_path, now):
    table = StateTable(spark, f"file://{tmp_path}/points", state.CHECKPOINTS, ["site", "board"], 8)
    rows = spark.createDataFrame(
        [(f"s{i}", "b", i, None, None, None, None, None, None, None, None, None, 0) for i in range(20)], state.CHECKPOINTS + ", seq int")
    table.update(rows, lambda old, new: state.save_checkpoints(old, new, now))
    events = spark.createDataFrame([("s3", "b", "error", "m", None, 1), ("none", "b", "completed", None, None, 1)],
                                   "site string, board string, kind string, message string, final_stats map<string,bigint>, seq int")
    table.update(events, lambda old, new: state.apply_transitions(old, new, now))
    s3 = table.lookup(spark.createDataFrame([("s3", "b")], "site string, board string")).first()
    assert (s3.status, s3.stats, s3.last_error) == ("error", {"error_count": 1}, "m")
    table.update(rows.where("site <> 's3'").select("site", "board"), state.delete_checkpoints)
    assert [r.site for r in table.snapshot().collect()] == ["s3"]
    assert table.clean(1) > 0
    assert [r.site for r in table.snapshot().collect()] == ["s3"]


def test_misuse_is_refused(spark, tmp_path, now):
    table = articles(spark, tmp_path, 4)
    step = lambda old, new: state.upsert_articles(old, new, now)
    table.update(batch(spark, ["1", "2", "3", "4", "5"], "a"), step)
    with pytest.raises(ValueError, match="buckets"):
        articles(spark, tmp_path, 8).snapshot()
    with pytest.raises(ValueError, match="other buckets"):
        table.update(batch(spark, ["1"], "b"), lambda old, new: old.withColumn("article_id", F.concat("article_id", F.lit("x"))).unionByName(
            batch(spark, [str(i) for i in range(50)], "z").drop("seq")))
    assert titles(table.snapshot()) == dict.fromkeys("12345", "a")
