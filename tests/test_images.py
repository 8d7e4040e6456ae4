import struct

import pytest
from pyspark.sql import functions as F

from harrow.operators import images as I
from harrow.sources.pages import read_files


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", w, h) + b"\x08\x06\0\0\0"


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h)


def bmp(w, h):
    return b"BM" + b"\0" * 16 + struct.pack("<ii", w, h)


def jpeg(w, h):
    big = b"\xff\xe1" + struct.pack(">H", 60000) + b"\xff\xc0" * 29999
    return b"\xff\xd8" + big + b"\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, h, w)


def webp(kind, body):
    return b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + body


def lossy(w, h):
    return webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", w | 0x4000, h | 0x8000))


def lossless(w, h):
    return webp(b"VP8L", b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14))


def extended(w, h):
    return webp(b"VP8X", b"\0\0\0\0" + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"))


CASES = [
    (png(640, 480), ("png", 640, 480)), (gif(300, 1000), ("gif", 300, 1000)), (bmp(10, 20), ("bmp", 10, 20)),
    (jpeg(4000, 3000), ("jpeg", 4000, 3000)), (lossy(800, 601), ("webp", 800, 601)),
    (lossless(16000, 9000), ("webp", 16000, 9000)), (extended(70000, 5), ("webp", 70000, 5)),
    (b"\xff\xd8\xff\xe0 broken", ("jpeg", None, None)), (b"not an image", None), (b"", None), (None, None),
]


@pytest.mark.parametrize("content, want", CASES)
def test_header(spark, content, want):
    df = spark.createDataFrame([(content,)], "content binary")
    got = df.select(I.image_header(F.col("content")).alias("h")).collect()[0]["h"]
    assert (None if got is None else tuple(got)) == want


def test_reject_reasons(spark):
    pad = b"\0" * 20000
    files = [
        ("small file", png(500, 500), "too_few_bytes"), ("good", png(200, 200) + pad, None),
        ("narrow", png(199, 500) + pad, "too_small"), ("bmp", bmp(500, 500) + pad, "format"),
        ("text", b"x" * 20000, "unreadable"), ("jpeg", jpeg(300, 300) + pad, None),
    ]
    df = spark.createDataFrame([(n, c) for n, c, _ in files], "name string, content binary")
    got = {r["name"]: r.reject_reason for r in I.checked_images(df).collect()}
    assert got == {n: r for n, _, r in files}
    limits = {r["name"]: r.reject_reason for r in I.checked_images(df, min_bytes=0, max_bytes=20010, min_width=600).collect()}
    assert limits["good"] == "too_many_bytes" and limits["small file"] == "too_small"


def test_file_scan(spark, tmp_path):
    (tmp_path / "b" / "c").mkdir(parents=True)
    (tmp_path / "1.bin").write_bytes(b"same")
    (tmp_path / "b" / "c" / "2.bin").write_bytes(b"same")
    (tmp_path / "b" / "3.bin").write_bytes(b"other")
    got = read_files(spark, str(tmp_path))
    assert got.count() == 3 and got.select("content_hash").distinct().count() == 2
