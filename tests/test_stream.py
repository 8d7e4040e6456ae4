import datetime as dt

from pyspark.sql import functions as F

from harrow.operators import state
from harrow.session import materialized, shared_dir
from harrow.sources.sinks import append_table, with_bucket, write_table, write_version
from harrow.streaming import crawl_stream as C

ENTRY = "site string, page long, pos long, article_id string"


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_new_articles_over_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    first = [("s", 1, 0, "a"), ("s", 1, 1, "b"), ("s", 1, 2, "a"), ("s", 1, 3, "done")]
    second = [("s", 2, 0, "b"), ("s", 2, 1, "c"), ("t", 2, 2, "a")]
    third = [("s", 3, 0, "a"), ("s", 3, 1, "d"), ("s", 3, 2, "c")]
    finished = spark.createDataFrame([("done",)], "article_id string")
    run = lambda: C.stream_new_articles(stream(spark, src, ENTRY), ["page", "pos"], finished, out, ck).awaitTermination()
    put(spark, first, ENTRY, src)
    put(spark, second, ENTRY, src)
    run()
    put(spark, third, ENTRY, src)
    run()
    run()
    got = sorted((r.site, r.page, r.pos, r.article_id) for r in spark.read.parquet(out).collect())
    batch = C.new_entries(spark.createDataFrame(first + second + third, ENTRY), ["page", "pos"], finished)
    assert got == sorted((r.site, r.page, r.pos, r.article_id) for r in batch.collect())
    assert [g[3] for g in got] == ["a", "b", "c", "d", "a"]


def test_replayed_batch_replaces_itself(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    put(spark, [(1,), (2,)], "v int", src)
    for name in ("ck1", "ck2"):
        C.ingest(stream(spark, src, "v int"), lambda b, _: b, out, str(tmp_path / name)).awaitTermination()
    assert spark.read.parquet(out).count() == 2


TASK = "article_id string, outcome string, total_count int"


def test_completions(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    rows = [("a", "ok", 3), ("a", "failed", 3), ("b", "ok", 1), ("c", None, 1)], [("a", "ok", 3), ("d", "ok", 2), ("b", "ok", 1)]
    for part in rows:
        put(spark, part, TASK, src)
        C.stream_completions(stream(spark, src, TASK), out, ck).awaitTermination()
    done = C.finished_articles(spark.read.parquet(out))
    assert sorted(r.article_id for r in done.collect()) == ["a", "b"]
    static = C.completions(spark.createDataFrame(rows[0] + rows[1], TASK))
    assert sorted(r.article_id for r in static.collect()) == ["a", "b"]
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    snapshots = spark.createDataFrame([(a, "u", "t", "s", "news", None, None, None) for a in "abcd"], state.ARTICLES)
    stored = spark.createDataFrame([("b", "u", "t", "s", "news", None, dt.datetime(2020, 1, 1), False)], state.ARTICLES)
    saved = {r.article_id: (r.images_downloaded, r.created_at.year) for r in C.record_completions(stored, snapshots, done, now).collect()}
    assert saved == {"a": (True, 2024), "b": (True, 2020)}


def test_image_tasks(spark):
    df = spark.createDataFrame([("n.com", "7", ["https://c/a-10x10.jpg", "https://c/a.jpg", "https://c/x"]), ("n.com", "8", [])], "site string, article_id string, images array<string>")
    tasks = C.image_tasks(df, F.lit("d"))
    rows = tasks.collect()
    assert [r.total_count for r in rows] == [3, 3, 3]
    assert rows[0].save_path == "d/n.com/7_a.jpg"
    assert [(r.save_path, r.n_images) for r in C.name_collisions(tasks).collect()] == [("d/n.com/7_a.jpg", 2)]


def test_sinks(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "cast(id % 2 as string) board")
    assert spark.read.parquet(write_table(df, str(tmp_path / "t"), "board")).where("board = '1'").count() == 5
    append_table(df, str(tmp_path / "a"))
    assert spark.read.parquet(append_table(df, str(tmp_path / "a"))).count() == 20
    for _ in range(2):
        path = write_version(df, str(tmp_path / "v"), 3)
    assert spark.read.parquet(path).count() == 10
    assert with_bucket(df, "id", 4).agg(F.max("bucket")).collect()[0][0] < 4


def test_shared_dir_follows_the_cluster(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a != b and a.startswith(root)
    table = materialized(spark.range(5), "five")
    assert table.count() == 5 and table.inputFiles()[0].split("file://")[-1].startswith(root)
