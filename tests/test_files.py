"""Files are read once: what is known by path, size and time keeps its digest."""

from __future__ import annotations

import hashlib
import os

from harrow.sources.files import list_files, scan_files


def put(folder, name, content, at=None):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    if at is not None:
        os.utime(path, (at, at))


def scanned(df, folder):
    return {r.path.split(f"{folder}/")[1]: (r.content_hash, r.is_new) for r in df.collect()}


def md5(content):
    return hashlib.md5(content).hexdigest()


def test_known_files_are_not_read_again(spark, tmp_path):
    put(tmp_path, "a/one.bin", b"first", 1_700_000_000)
    put(tmp_path, "two.bin", b"second", 1_700_000_100)
    first = scan_files(spark, str(tmp_path))
    assert scanned(first, tmp_path) == {"a/one.bin": (md5(b"first"), True), "two.bin": (md5(b"second"), True)}
    # Other bytes under the same size and time: a scan that read the file would see them.
    put(tmp_path, "a/one.bin", b"FIRST", 1_700_000_000)
    put(tmp_path, "two.bin", b"longer than before", 1_700_000_100)
    put(tmp_path, "b/new.bin", b"new", 1_700_000_200)
    put(tmp_path, "b/late.bin", b"late", 1_600_000_000)
    put(tmp_path, "b/empty.bin", b"", 1_700_000_300)
    second = scan_files(spark, str(tmp_path), first, paths_at_once=1)
    assert scanned(second, tmp_path) == {
        "a/one.bin": (md5(b"first"), False), "two.bin": (md5(b"longer than before"), True), "b/new.bin": (md5(b"new"), True),
        "b/late.bin": (md5(b"late"), True)}  # the empty file is passed over
    os.remove(tmp_path / "b/new.bin")
    third = scan_files(spark, str(tmp_path), second)
    assert scanned(third, tmp_path) == {k: (v[0], False) for k, v in scanned(second, tmp_path).items() if k != "b/new.bin"}


def test_a_scan_of_an_empty_table_of_known_files(spark, tmp_path):
    put(tmp_path, "x", b"x")
    first = scan_files(spark, str(tmp_path))
    assert scanned(scan_files(spark, str(tmp_path), first.limit(0)), tmp_path) == {"x": (md5(b"x"), True)}


def test_listing_opens_no_file(spark, tmp_path):
    put(tmp_path, "x", b"x" * 10)
    plan = list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
