"""Semi-joins that leave wide rows where they are.

Pages are far wider than their keys, so a join that shuffles them costs the whole
corpus. A filter of bounded size is made of the wanted keys instead, sent to every
task, and the pages that pass it go on; about one in a hundred of these is not
wanted and falls out of the exact join of the narrow rows that come of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of one piece of the filter (fixed by Spark's bitmap functions), and pieces at most: 32 MB.
PIECE_BITS = 32_768
MOST_PIECES = 8_192
BITS_PER_KEY = 16
HASHES = 5


def _piece(key: Column, pieces: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int")


def _places(key: Column) -> list[Column]:
    """Bits of a key within its piece."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(PIECE_BITS)).cast("int") for i in range(1, HASHES + 1)]


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(piece, pieces, bits): a Bloom filter of a column in pieces of 4 KB, a key's bits all in one piece.

    It has as many pieces as the number of keys asks for, ``MOST_PIECES`` at most;
    with more keys it lets more others pass. The bits of a piece are joined by
    partial aggregation. A row for each piece that has any key.
    """
    wanted = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"))
    n = wanted.agg(F.approx_count_distinct("_key")).first()[0]
    pieces = min(MOST_PIECES, max(1, -(-n * BITS_PER_KEY // PIECE_BITS)))
    bits = wanted.select(_piece(F.col("_key"), pieces).alias("piece"), F.explode(F.array(*_places(F.col("_key")))).alias("place"))
    return bits.groupBy("piece").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits")).select("piece", F.lit(pieces).alias("pieces"), "bits")


def _has(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def passing(wide: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``wide`` whose key is in ``keys``, and a few others; no row of ``wide`` is moved.

    The pieces are broadcast: 32 MB at most, whatever the number of keys.
    """
    filter_ = key_filter(keys, key)
    first = filter_.select("pieces").first()
    if first is None:
        return wide.limit(0)
    # A piece is as wide as a short page; its row is broadcast, so Spark joins without a shuffle.
    pieces = filter_.select(F.col("piece").alias("_piece"), F.col("bits").alias("_bits"))
    hit = F.lit(True)
    for place in _places(F.col(key)):
        hit = hit & _has(F.col("_bits"), place)
    return wide.withColumn("_piece", _piece(F.col(key), first[0])).join(F.broadcast(pieces), "_piece").where(
        F.col(key).isNotNull() & hit).select(*wide.columns)
