import datetime as dt

from pyspark.sql import functions as F

from harrow.operators import state, stats

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 2)
META = ("张三", "x", 1, 2)


def now(t=T2):
    return F.lit(t).cast("timestamp")


def threads(spark, *rows):
    return spark.createDataFrame(list(rows), state.THREADS)


def test_thread_upsert(spark):
    stored = threads(
        spark, ("1", "old", "u", "b1", ["x"], 1, META, "c", T1, T1), ("2", "keep", "u2", "b2", None, 0, None, "", T1, T1)
    )
    batch = spark.createDataFrame(
        [
            ("1", "mid", "u", "b1", ["x", "y"], None, META, "c", None, None, 1),
            ("1", "new", "u9", "b9", ["x", "y", "z"], 0, None, None, None, None, 2),
            ("3", "fresh", "u3", "b1", None, 7, META, "c3", T1, None, 1),
            ("4", "late", "u4", "b1", None, None, META, "c4", None, None, 1),
        ],
        state.THREADS + ", seq int",
    )
    got = {r.thread_id: r for r in state.upsert_threads(stored, batch, now()).collect()}
    assert len(got) == 4
    assert (got["1"].title, got["1"].url, got["1"].board, got["1"].image_count, got["1"].metadata) == ("new", "u9", "b9", 3, None)
    assert (got["1"].created_at, got["1"].updated_at) == (T1, T2)
    assert (got["2"].title, got["2"].updated_at) == ("keep", T1)
    assert (got["3"].image_count, got["3"].created_at, got["3"].updated_at) == (7, T1, T2)
    assert (got["4"].image_count, got["4"].created_at) == (0, T2)


def test_upsert_twice_is_once(spark):
    stored = threads(spark)
    batch = spark.createDataFrame([("1", "t", "u", "b", ["a"], None, META, "c", None, None, 1)], state.THREADS + ", seq int")
    once = state.upsert_threads(stored, batch, now())
    assert state.upsert_threads(once, batch, now()).collect() == once.collect()


def test_article_flag_can_be_cleared(spark):
    stored = spark.createDataFrame([("a", "u", "t", "s", "b", {"k": "v"}, T1, True)], state.ARTICLES)
    batch = spark.createDataFrame(
        [("a", "u", "t2", "s", "b", None, None, None, 1), ("b", "u", "t", "s", "b", None, None, True, 1)], state.ARTICLES + ", seq int"
    )
    got = {r.article_id: r for r in state.upsert_articles(stored, batch, now()).collect()}
    assert (got["a"].images_downloaded, got["a"].title, got["a"].created_at) == (False, "t2", T1)
    assert (got["b"].images_downloaded, got["b"].created_at) == (True, T2)


def test_image_records(spark):
    batch = spark.createDataFrame([("u", None, None, None, None, None), ("v", "p", 5, False, {"a": "b"}, T1)], state.IMAGES)
    got = [tuple(r) for r in state.image_records(batch, now()).orderBy("url").collect()]
    assert got == [("u", None, 0, True, None, T2), ("v", "p", 5, False, {"a": "b"}, T1)]


def checkpoint(spark, *rows):
    return spark.createDataFrame(list(rows), state.CHECKPOINTS)


BASE = ("test.com", "board1", 3, "1003", "u", "running", {"crawled_count": 5}, None, "1001", "a1", T1, T1)


def test_checkpoints(spark):
    stored = checkpoint(spark, BASE, ("x.com", "all", 0, None, None, None, None, None, None, None, T1, T1))
    batch = spark.createDataFrame([("test.com", "board1", 4, "1004", "v", None, None, None, None, None, None, None, 1),
                                   ("new.com", "all", None, None, None, None, None, None, None, None, None, None, 1)], state.CHECKPOINTS + ", seq int")
    got = {r.site: r for r in state.save_checkpoints(stored, batch, now()).collect()}
    assert (got["test.com"].current_page, got["test.com"].status, got["test.com"].stats) == (4, "running", {})
    assert (got["test.com"].created_at, got["test.com"].updated_at) == (T1, T2)
    assert (got["new.com"].current_page, got["new.com"].created_at) == (1, T2)
    loaded = {r.site: r for r in state.load_checkpoints(stored).collect()}
    assert (loaded["x.com"].current_page, loaded["x.com"].status, loaded["x.com"].stats) == (1, "running", {})
    target = spark.createDataFrame([("test.com", "board1"), ("no.com", "all")], "site string, board string")
    assert [r.site for r in state.existing_checkpoints(target, stored).collect()] == ["test.com"]
    assert [r.site for r in state.delete_checkpoints(stored, target).collect()] == ["x.com"]


EVENTS = "site string, board string, kind string, message string, final_stats map<string,bigint>, seq int"


def transitions(spark, stored, *events):
    rows = [("test.com", "board1", *e, i) for i, e in enumerate(events)]
    df = spark.createDataFrame([*rows, ("nobody", "x", "error", "m", None, 9)], EVENTS)
    return state.apply_transitions(stored, df, now()).collect()


def test_transitions(spark):
    stored = checkpoint(spark, BASE)
    r = transitions(spark, stored, ("completed", None, None))
    assert len(r) == 1 and (r[0].status, r[0].stats, r[0].current_page, r[0].updated_at) == ("completed", {"crawled_count": 5}, 3, T2)
    r = transitions(spark, stored, ("error", "boom", None), ("error", "bang", None))[0]
    assert (r.status, r.stats, r.last_error) == ("error", {"crawled_count": 5, "error_count": 2}, "bang")
    r = transitions(spark, stored, ("error", "boom", None), ("completed", None, {"total": 1}))[0]
    assert (r.status, r.stats, r.last_error) == ("completed", {"total": 1}, None)
    r = transitions(spark, stored, ("completed", None, {"total": 1}), ("error", "e", None))[0]
    assert (r.status, r.stats, r.last_error) == ("error", {"total": 1, "error_count": 1}, "e")
    untouched = state.apply_transitions(stored, spark.createDataFrame([], EVENTS), now()).collect()
    assert untouched == stored.collect()


def test_thread_queries(spark):
    df = threads(spark, ("1", "t", "u", "b1", None, 0, None, "", T1, T1), ("2", "t", "u", "b2", None, 0, None, "", T1, T1))
    assert state.threads_of_board(df, "b1").count() == 1
    assert state.threads_of_board(df).count() == state.threads_of_board(df, "").count() == 2
    assert state.thread_by_id(df, "2").collect()[0].board == "b2"


def test_statistics(spark):
    df = threads(spark, *[(str(i), "t", "u", b, None, 0, None, "", T1, T1) for i, b in enumerate(["b1", "b1", "", None])])
    images = spark.createDataFrame([(True,), (False,), (True,), (None,)], "success boolean")
    assert tuple(stats.storage_statistics(df, images).collect()[0]) == (4, 4, 2, 1)
    assert [tuple(r) for r in stats.board_counts(df).collect()] == [("b1", 2)]


def test_tasks(spark):
    tasks = spark.createDataFrame([(i, "failed" if i < 2 else "completed", "x" * 300) for i in range(10)], "id int, status string, item string")
    r = stats.task_outcomes(tasks).collect()[0]
    assert (r.total_tasks, r.completed_tasks, r.failed_tasks, r.error_rate) == (10, 8, 2, 0.2)
    assert stats.task_outcomes(tasks.limit(0)).collect()[0].error_rate == 0.0
    assert [(r.id, len(r.item)) for r in stats.recent_errors(tasks, "id", "item").collect()] == [(1, 100), (0, 100)]


def test_completed_articles(spark):
    rows = [("a", "ok", 2), ("a", "failed", 2), ("b", "ok", 2), ("b", None, 2), ("c", "ok", 1)]
    df = spark.createDataFrame(rows, "article_id string, outcome string, total_count int")
    assert sorted(r.article_id for r in stats.completed_articles(df).collect()) == ["a", "c"]


def test_id_range(spark):
    df = spark.createDataFrame([("9",), ("10",), ("a1",)], "article_id string")
    assert tuple(stats.id_range(df, "article_id").collect()[0]) == ("9", "10")


def test_entry_totals(spark):
    df = spark.createDataFrame([("u", 2, 3, True), ("u", 1, 0, False), ("v", 4, 4, True)], "url string, articles int, images int, ok boolean")
    got = {r.url: r for r in stats.entry_totals(df, "url").collect()}
    assert (got[None].articles, got[None].images, got[None].tasks_ok, got[None].tasks_failed, got[None].is_total) == (7, 7, 2, 1, True)
    assert got["u"].articles == 3 and not got["u"].is_total


def test_crawl_counters(spark):
    df = spark.createDataFrame([("page", "ok"), ("page", "failed"), ("image", "ok"), ("image", "duplicate"), ("article", "ok")], "kind string, outcome string")
    r = stats.crawl_counters(df).collect()[0]
    assert (r.pages_fetched, r.requests_failed, r.images_found, r.images_downloaded, r.duplicates_skipped, r.articles_found) == (1, 1, 2, 1, 1, 1)
