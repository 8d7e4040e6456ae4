"""Keep-first duplicate removal by URL, by bytes and by picture hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.skew import earliest, first_flags, join_marks, without_known
from harrow.session import materialized


def url_duplicates(df: DataFrame, url: str, order: str | list[str]) -> DataFrame:
    """Every check of a URL after the first one is a duplicate."""
    return _duplicates(df.withColumn("url_hash", F.md5(F.col(url))), "url_hash", order)


def content_hashes(df: DataFrame, content: str, *keep: str) -> DataFrame:
    """Digest of every content next to the columns named, as a table of its own.

    Later steps read the digests several times and the content never again.
    """
    return materialized(df.select(*keep, F.md5(F.col(content)).alias("content_hash")), "content-hashes")


def content_duplicates(df: DataFrame, content: str, order: str | list[str]) -> DataFrame:
    """Equal bytes seen before; unreadable content (NULL) is never a duplicate.

    Gives position, digest and verdict; the content itself is not carried along.
    """
    orders = [order] if isinstance(order, str) else list(order)
    return _duplicates(content_hashes(df, content, *orders), "content_hash", orders)


def picture_duplicates(df: DataFrame, picture_hash: str, order: str | list[str]) -> DataFrame:
    """D3: an equal picture hash seen before; a failed hash (NULL) is never a duplicate."""
    return _duplicates(df, picture_hash, order)


def _duplicates(df: DataFrame, key: str, order: str | list[str]) -> DataFrame:
    return first_flags(df, key, order).withColumn("is_duplicate", ~F.col("is_first")).drop("is_first")


def file_verdicts(
    df: DataFrame,
    content_hash: str,
    picture_hash: str,
    order: str | list[str],
    known_content: DataFrame | None = None,
    known_pictures: DataFrame | None = None,
) -> DataFrame:
    """``reason`` is NULL for a kept file, else what it repeats.

    Only first copies go on to the picture check, as an exact copy has the same
    picture. Known hashes (of files stored earlier) count as seen before; a file
    that cannot be read (NULL content hash) is never a duplicate. Each step is a
    partially aggregated minimum, and only positions are joined back.
    """
    orders = [order] if isinstance(order, str) else list(order)
    unique = (
        df.where(F.col(content_hash).isNotNull())
        .groupBy(content_hash).agg(earliest(orders, F.col(picture_hash).alias("_picture")).alias("_first"))
        .select(content_hash, "_first.*")
    )
    if known_content is not None:
        unique = _unless_known(unique, known_content, content_hash)
    kept = (
        unique.where(F.col("_picture").isNotNull())
        .groupBy("_picture").agg(earliest(orders).alias("_first"))
        .select("_picture", "_first.*")
    )
    if known_pictures is not None:
        kept = _unless_known(kept, known_pictures, "_picture")
    seen = unique.select(*orders, F.lit(True).alias("_unique"))
    good = kept.select(*orders, F.lit(True).alias("_kept"))
    keep = F.col(content_hash).isNull() | (F.col("_unique") & (F.col(picture_hash).isNull() | F.col("_kept")))
    reason = F.when(keep, F.lit(None)).when(F.col("_unique"), "same_picture").otherwise("same_bytes")
    return (
        join_marks(join_marks(df, seen, [], orders), good, [], orders)
        .withColumn("reason", reason)
        .drop("_unique", "_kept")
    )


def _unless_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Each key is left once at this point, so no key is hot here."""
    return without_known(df, known.where(F.col(known.columns[0]).isNotNull()).toDF(key), key)


def kept_files(verdicts: DataFrame) -> DataFrame:
    """The files that stay."""
    return verdicts.where(F.col("reason").isNull()).drop("reason")


def removal_list(verdicts: DataFrame) -> DataFrame:
    """The files to delete, with the reason; nothing is deleted here."""
    return verdicts.where(F.col("reason").isNotNull())


def dedup_statistics(checked: DataFrame) -> DataFrame:
    """Counters over the result of the URL check."""
    duplicate = F.count_if("is_duplicate")
    total = F.count("*")
    return checked.agg(
        total.alias("total_checked"),
        duplicate.alias("duplicates_found"),
        (total - duplicate).alias("unique_images"),
        F.when(total > 0, duplicate / total).otherwise(F.lit(0.0)).alias("duplicate_rate"),
    )


def url_statistics(df: DataFrame, url: str) -> DataFrame:
    """D6 straight from the checks: a URL is new once, a NULL one every time."""
    total = F.count("*")
    unique = F.count_distinct(F.md5(F.col(url))) + F.count_if(F.col(url).isNull())
    return df.agg(total.alias("_total"), unique.alias("_unique")).select(
        F.col("_total").alias("total_checked"),
        (F.col("_total") - F.col("_unique")).alias("duplicates_found"),
        F.col("_unique").alias("unique_images"),
        F.when(F.col("_total") > 0, (F.col("_total") - F.col("_unique")) / F.col("_total")).otherwise(F.lit(0.0)).alias("duplicate_rate"),
    )


def file_statistics(verdicts: DataFrame) -> DataFrame:
    """The same counts for the file checks, split by reason."""
    return verdicts.agg(
        F.count("*").alias("files_checked"),
        F.count_if(F.col("reason") == "same_bytes").alias("same_bytes"),
        F.count_if(F.col("reason") == "same_picture").alias("same_picture"),
        F.count_if(F.col("reason").isNull()).alias("files_kept"),
    )


def unvisited(df: DataFrame, url: str = "url") -> DataFrame:
    """Every URL once; which of the equal rows stays does not matter."""
    return df.dropDuplicates([url])


def difference_hash(grid: Column, width: int) -> Column:
    """D3: hash of a luminance grid given row by row: is each right neighbour brighter?

    Bits run row by row and are written as hex digits, so equal pictures give
    equal text. A grid with more than 64 bits needs several ``conv`` words and is
    written word by word.
    """
    right = F.slice(grid, F.lit(2), F.size(grid) - 1)
    left = F.slice(grid, F.lit(1), F.size(grid) - 1)
    bits = F.zip_with(left, right, lambda a, b: F.when(b > a, "1").otherwise("0"))
    inner = F.filter(bits, lambda _, i: (i + 1) % width != 0)
    text = F.array_join(inner, "")
    words = F.regexp_extract_all(text, F.lit(r"[01]{1,64}"), F.lit(0))
    hexed = F.transform(
        words,
        lambda w: F.lower(F.lpad(F.conv(w, 2, 16), F.ceil(F.length(w) / 4).cast("int"), F.lit("0"))),
    )
    return F.when(F.size(grid) >= width, F.array_join(hexed, ""))
