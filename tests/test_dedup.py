import random

import pytest
from pyspark.sql import functions as F

from harrow.operators import dedup, skew
from harrow.operators.skew import first_flags, hot_keys, running, without_known


def test_url_twice(spark):
    df = spark.createDataFrame([(1, "u"), (2, "u")], "seq int, url string")
    checked = dedup.url_duplicates(df, "url", "seq")
    assert [r.is_duplicate for r in checked.orderBy("seq").collect()] == [False, True]
    r = dedup.dedup_statistics(checked).collect()[0]
    assert (r.total_checked, r.duplicates_found, r.unique_images, r.duplicate_rate) == (2, 1, 1, 0.5)


def test_nothing_checked(spark):
    df = spark.createDataFrame([], "seq int, url string")
    r = dedup.dedup_statistics(dedup.url_duplicates(df, "url", "seq")).collect()[0]
    assert (r.total_checked, r.duplicate_rate) == (0, 0.0)


def test_same_bytes_and_unreadable(spark):
    df = spark.createDataFrame(
        [(1, b"a"), (2, b"a"), (3, None), (4, None)], "seq int, content binary"
    )
    got = dedup.content_duplicates(df, "content", "seq").orderBy("seq").collect()
    assert [r.is_duplicate for r in got] == [False, True, False, False]


def sequential(files, known_content=(), known_pictures=()):
    """The order-dependent rule as a loop: bytes first, then the picture."""
    contents, pictures, out = set(known_content), set(known_pictures), {}
    for seq, content, picture in files:
        if content is None:
            out[seq] = None
        elif content in contents:
            out[seq] = "same_bytes"
        else:
            contents.add(content)
            if picture is not None and picture in pictures:
                out[seq] = "same_picture"
            else:
                out[seq] = None
                pictures.add(picture)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_verdicts_like_the_loop(spark, seed):
    rnd = random.Random(seed)
    picture_of = {f"c{i}": rnd.choice([None, "p1", "p2", "p3", "p4"]) for i in range(12)}
    files = []
    for seq in range(60):
        content = rnd.choice([None, *picture_of])
        files.append((seq, content, picture_of.get(content)))
    shuffled = rnd.sample(files, len(files))
    df = spark.createDataFrame(shuffled, "seq int, content string, picture string")
    got = {r.seq: r.reason for r in dedup.file_verdicts(df, "content", "picture", "seq").collect()}
    assert got == sequential(files)
    known_c = rnd.sample(sorted(picture_of), 3)
    known_p = [p for p in {picture_of[c] for c in known_c} if p]
    kc = spark.createDataFrame([(c,) for c in known_c], "c string")
    kp = spark.createDataFrame([(p,) for p in known_p] or [(None,)], "p string")
    verdicts = dedup.file_verdicts(df, "content", "picture", "seq", kc, kp)
    assert {r.seq: r.reason for r in verdicts.collect()} == sequential(files, known_c, known_p)
    assert dedup.kept_files(verdicts).count() + dedup.removal_list(verdicts).count() == 60
    s = dedup.file_statistics(verdicts).collect()[0]
    assert s.files_checked == 60 and s.files_kept + s.same_bytes + s.same_picture == 60


def test_difference_hash(spark):
    grid = [float((i * 37) % 11) for i in range(72)]
    bits = "".join(
        "1" if grid[r * 9 + c + 1] > grid[r * 9 + c] else "0" for r in range(8) for c in range(8)
    )
    df = spark.createDataFrame([(grid,), ([],)], "g array<double>")
    got = [r[0] for r in df.select(dedup.difference_hash(F.col("g"), 9)).collect()]
    assert got == [f"{int(bits, 2):016x}", None]


def test_hot_key_rows_spread(spark):
    """Half of all rows share one key, yet no task of the join gets most of them."""
    df = spark.range(40000).selectExpr("id seq", "if(id % 2 = 0, 'hot', concat('k', id)) key")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        flagged = first_flags(df, "key", "seq")
        assert flagged.where("is_first").count() == 20001
        sizes = [r["count"] for r in flagged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 15000


def test_without_known_salted(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id seq", "if(id % 3 = 0, 'a', concat('k', id % 50)) key")
    known = spark.createDataFrame([("a",), ("a",), ("k1",), (None,)], "key string")
    plain = without_known(df, known, "key").count()
    want = df.where("key NOT IN ('a', 'k1')").count()
    assert plain == want
    hot = [r.key for r in hot_keys(df, ["key"], 500).collect()]
    assert hot == ["a"]
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (500,))
    assert without_known(df, known, "key", salt_by="seq").count() == want


def test_lookup(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id seq", "if(id % 3 = 0, 'a', concat('k', id % 50)) key")
    table = spark.createDataFrame([("a", 1), ("k1", 2), ("zz", 3)], "key string, v int")
    small = {(r.seq, r.v) for r in skew.lookup(df, table, "key", "seq").collect()}
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (500,))
    monkeypatch.setattr(skew.fits_broadcast, "__defaults__", (2,))
    large = [(r.seq, r.v) for r in skew.lookup(df, table, "key", "seq").collect()]
    assert len(large) == 3000 and set(large) == small
    assert sum(v == 1 for _, v in large) == 1000


@pytest.mark.parametrize("strict", [False, True])
def test_running_maximum_over_blocks(spark, strict):
    rnd = random.Random(3)
    rows = [(s, p, q, rnd.choice([None, rnd.randrange(1000)])) for s in "ab" for p in range(40) for q in range(3)]
    df = spark.createDataFrame(rows, "site string, page int, pos int, v int")
    for block in (1, 7, 1000):
        got = {(r.site, r.page, r.pos): r.m for r in running(df, ["site"], "page", ["pos"], F.col("v"), "m", strict, block).collect()}
        for site in "ab":
            best = None
            for s, p, q, v in rows:
                if s != site:
                    continue
                before = best
                if v is not None:
                    best = v if best is None else max(best, v)
                assert got[(s, p, q)] == (before if strict else best)
