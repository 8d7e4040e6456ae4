"""What streams remember: seen articles, open counters, batches already stored."""

from __future__ import annotations

import datetime as dt
import shutil

import pytest
from harrow.operators import state
from harrow.sources.state_table import StateTable
from harrow.streaming import crawl_stream as C
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

ENTRY = "site string, article_id string, page long, pos long, at timestamp"
TASK = "article_id string, outcome string, total_count int, at timestamp"
DAY = dt.datetime(2024, 1, 1)


def put(spark, rows, schema, folder):
    full = [r if len(r) == len(schema.split(",")) else (*r, DAY) for r in rows]
    spark.createDataFrame(full, schema).repartition(3).write.mode("append").parquet(folder)


def arriving(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def found(spark, out):
    return sorted((r.site, r.article_id, r.page, r.pos) for r in spark.read.parquet(out).collect())


def test_seen_articles_are_remembered_without_reading_output(spark, tmp_path):
    src, out, ck, gone = (str(tmp_path / n) for n in ("src", "out", "ck", "gone"))
    run = lambda: C.stream_new_articles(arriving(spark, src, ENTRY), ["page", "pos"], None, out, ck).awaitTermination()
    put(spark, [("s", "a", 2, 1), ("s", "a", 1, 9), ("s", "a", None, 0), ("s", "b", 1, 1), ("t", "a", 5, 5), (None, "a", 1, 1), ("s", None, 1, 1)], ENTRY, src)
    run()
    assert found(spark, out) == [("s", "a", 1, 9), ("s", "b", 1, 1), ("t", "a", 5, 5)]
    shutil.move(out, gone)
    put(spark, [("s", "a", 0, 0), ("s", "c", 3, 1), ("s", "c", 2, 8), ("t", "b", 1, 1)], ENTRY, src)
    run()
    assert found(spark, out) == [("s", "c", 2, 8), ("t", "b", 1, 1)]
    run()
    put(spark, [("s", "c", 0, 0), ("t", "a", 0, 0)], ENTRY, src)
    run()
    assert found(spark, out) == [("s", "c", 2, 8), ("t", "b", 1, 1)]


def test_a_batch_that_fails_is_repeated_alike(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put(spark, [("s", "a", 2, 1), ("s", "b", 1, 9)], ENTRY, src)
    fails = [True]

    def step(batch, _):
        if fails.pop() if fails else False:
            raise RuntimeError("lost")
        return batch

    for _ in range(2):
        try:
            C.ingest(C.first_seen(arriving(spark, src, ENTRY), ["page"]), step, out, ck, "update").awaitTermination()
        except StreamingQueryException:
            pass
    assert found(spark, out) == [("s", "a", 2, 1), ("s", "b", 1, 9)]


def test_bounded_memory_forgets(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for day, ids in ((0, "aab"), (1, "ac"), (40, "d"), (41, "e"), (42, "a")):
        put(spark, [("s", i, day, 0, DAY + dt.timedelta(days=day)) for i in ids], ENTRY, src)
        C.stream_new_articles(arriving(spark, src, ENTRY), ["page"], None, out, ck, "at", "10 days").awaitTermination()
    assert [f[1:3] for f in found(spark, out)] == [("a", 0), ("a", 42), ("b", 0), ("c", 1), ("d", 40), ("e", 41)]


def reported(spark, out):
    return sorted((r.article_id, r.processed, r.total_count) for r in spark.read.parquet(out).collect())


def test_articles_are_reported_once_over_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    parts = [[("a", "ok", 3), ("b", "ok", 1), ("h", None, 2)], [("a", "failed", 3), ("h", "ok", 2)], [("a", "ok", 3), ("c", "ok", 2), ("c", "ok", 2)], [("h", "ok", 2)]]
    hot = [("hot", "ok", 5000)] * 1250
    wanted = [[("b", 1, 1)], [], [("a", 3, 3), ("c", 2, 2)], [("h", 2, 2), ("hot", 5000, 5000)]]
    so_far = []
    for part, new in zip(parts, wanted, strict=True):
        put(spark, part + hot, TASK, src)
        C.stream_completions(arriving(spark, src, TASK), out, ck).awaitTermination()
        so_far += new
        assert reported(spark, out) == sorted(so_far)


def test_counters_go_after_a_while(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for day, ids in ((0, "a"), (60, "b"), (61, "c"), (62, "a"), (63, "bb")):
        put(spark, [(i, "ok", 2, DAY + dt.timedelta(days=day)) for i in ids], TASK, src)
        C.stream_completions(arriving(spark, src, TASK), out, ck, at="at", give_up="20 days").awaitTermination()
    # The first outcome of a is forgotten when the second one comes; that of b is not.
    assert [r[0] for r in reported(spark, out)] == ["b"]


def test_the_stored_flag_survives_a_replayed_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    now = F.lit(DAY).cast("timestamp")
    table = StateTable(spark, f"file://{tmp_path}/articles", state.ARTICLES, ["article_id"], 4)
    step = lambda old, new: state.upsert_articles(old, new, now)
    row = lambda i, flag: (i, "/u", i, "s", "b", None, None, flag, 0)
    schema = state.ARTICLES + ", seq int"
    table.update(spark.createDataFrame([row("a", False), row("b", False), row("x", False)], schema), step)
    snapshots = spark.createDataFrame([row(i, None) for i in "ab"], schema).drop("seq")
    store, deaths = C.recorder(table, snapshots, now, "images"), []

    def dies_once(done, number):
        store(done, number)
        if not deaths:
            deaths.append(table.version())
            raise RuntimeError("lost")

    put(spark, [("a", "ok", 1), ("b", "ok", 2)], TASK, src)
    with pytest.raises(StreamingQueryException):
        C.stream_completions(arriving(spark, src, TASK), out, ck, dies_once).awaitTermination()
    # Someone clears a flag in between: the replayed batch must not set it again.
    table.update(spark.createDataFrame([row("a", False)], schema), step)
    C.stream_completions(arriving(spark, src, TASK), out, ck, dies_once).awaitTermination()
    assert deaths == [2] and table.version() == 3
    put(spark, [("b", "ok", 2), ("unknown", "ok", 1)], TASK, src)
    C.stream_completions(arriving(spark, src, TASK), out, ck, dies_once).awaitTermination()
    assert {r.article_id: r.images_downloaded for r in table.snapshot().collect()} == {"a": False, "b": True, "x": False}
    assert reported(spark, out) == [("a", 1, 1), ("b", 2, 2), ("unknown", 1, 1)]
