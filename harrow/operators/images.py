"""Q1: size, dimensions and format of images, read from their header bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default limits, all inclusive.
MIN_WIDTH, MIN_HEIGHT = 200, 200
MIN_BYTES, MAX_BYTES = 10240, 20 * 1024 * 1024
ALLOWED_FORMATS = ["jpg", "jpeg", "png", "gif", "webp"]

_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def _uint(content: Column, at: int, size: int, little: bool = False) -> Column:
    """Unsigned integer at byte ``at`` (from 1)."""
    parts = [F.substring(content, at + i, 1) for i in range(size)]
    ordered = parts[::-1] if little else parts
    return F.conv(F.concat(*[F.hex(p) for p in ordered]), 16, 10).try_cast("int")


def _starts(content: Column, hex_text: str, at: int = 1) -> Column:
    return F.hex(F.substring(content, at, len(hex_text) // 2)) == hex_text


@F.pandas_udf(_SIZE)
def _jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Dimensions from the first frame header of a JPEG; NULL when there is none."""

    def size(data) -> tuple[int | None, int | None]:
        at = 2
        while data is not None and at + 9 <= len(data):
            if data[at] != 0xFF:
                break
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
                at += 2
            else:
                at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return None, None

    frame = pd.DataFrame([size(d) for d in content], columns=["width", "height"])
    return frame.astype("Int32")


def image_header(content: Column) -> Column:
    """Format, width and height; NULL format when the bytes are no known image.

    Only JPEG needs a scan over its segments; other rows send NULL to Python.
    """
    png = _starts(content, "89504E470D0A1A0A")
    gif = _starts(content, "474946383761") | _starts(content, "474946383961")
    bmp = _starts(content, "424D")
    webp = _starts(content, "52494646") & _starts(content, "57454250", 9)
    jpeg = _starts(content, "FFD8FF")
    lossy, lossless = _starts(content, "56503820", 13), _starts(content, "5650384C", 13)
    b1, b2, b3, b4 = [_uint(content, 22 + i, 1) for i in range(4)]
    scanned = _jpeg_size(F.when(jpeg, content))
    sizes = {
        "png": (png, _uint(content, 17, 4), _uint(content, 21, 4)),
        "gif": (gif, _uint(content, 7, 2, True), _uint(content, 9, 2, True)),
        "bmp": (bmp, _uint(content, 19, 4, True), _uint(content, 23, 4, True)),
        "webp": (
            webp,
            F.when(lossy, _uint(content, 27, 2, True).bitwiseAND(0x3FFF))
            .when(lossless, b1 + F.shiftleft(b2.bitwiseAND(0x3F), 8) + 1)
            .otherwise(_uint(content, 25, 3, True) + 1),
            F.when(lossy, _uint(content, 29, 2, True).bitwiseAND(0x3FFF))
            .when(
                lossless,
                F.shiftright(b2, 6) + F.shiftleft(b3, 2) + F.shiftleft(b4.bitwiseAND(0x0F), 10) + 1,
            )
            .otherwise(_uint(content, 28, 3, True) + 1),
        ),
        "jpeg": (jpeg, scanned["width"], scanned["height"]),
    }
    found = F.lit(None).cast("struct<format:string,width:int,height:int>")
    for name, (test, width, height) in sizes.items():
        found = F.when(
            test, F.struct(F.lit(name).alias("format"), width.alias("width"), height.alias("height"))
        ).otherwise(found)
    return found


def reject_reason(
    size: Column,
    width: Column,
    height: Column,
    image_format: Column,
    min_width: int = MIN_WIDTH,
    min_height: int = MIN_HEIGHT,
    min_bytes: int = MIN_BYTES,
    max_bytes: int = MAX_BYTES,
    formats: list[str] | None = None,
) -> Column:
    """Q1: why an image is refused, NULL when it is good; the cheap tests come first."""
    return (
        F.when(size < min_bytes, "too_few_bytes")
        .when(size > max_bytes, "too_many_bytes")
        .when(image_format.isNull() | width.isNull() | height.isNull(), "unreadable")
        .when((width < min_width) | (height < min_height), "too_small")
        .when(~image_format.isin(formats or ALLOWED_FORMATS), "format")
    )


def checked_images(files, content: str = "content", **limits):
    """Q1 on a table of files: adds length, header fields and ``reject_reason``.

    Content outside the byte limits is not looked at.
    """
    size = F.length(content)
    in_range = (size >= limits.get("min_bytes", MIN_BYTES)) & (size <= limits.get("max_bytes", MAX_BYTES))
    return (
        files.withColumn("n_bytes", size)
        .withColumn("header", image_header(F.when(in_range, F.col(content))))
        .withColumn(
            "reject_reason",
            reject_reason(F.col("n_bytes"), F.col("header.width"), F.col("header.height"), F.col("header.format"), **limits),
        )
    )
