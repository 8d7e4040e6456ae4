"""Building blocks that stay balanced when one key holds much of the data.

None of them gathers a key's rows into one task: firsts come from partially
aggregated minima, running values from a scan in two levels (inside blocks of
bounded size, then over one row per block), and look-ups treat hot keys apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.session import materialized

BLOCK = 4096
# Rows of a range of a running value.
RANGE_ROWS = 1 << 20
HOT_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
# Rows of a look-up table that is broadcast though only its file tells its size.
BROADCAST_ROWS = 1 << 14
NULL_SALTS = 256


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def earliest(orders: Sequence[str], *more: Column) -> Column:
    """Aggregate: the row that comes first by ``orders`` as a struct, NULL after all values."""
    if len(orders) == 1 and not more:
        # One number is aggregated by hashing; a struct of several needs a sort.
        return F.struct(F.min(orders[0]).alias(orders[0]))
    parts = [x for o in orders for x in (F.col(o).isNull().alias(f"_null_{o}"), F.col(o))]
    first = F.min(F.struct(*parts, *more))
    return first.dropFields(*[f"_null_{o}" for o in orders])


def join_marks(df: DataFrame, marks: DataFrame, keys: Sequence[str], orders: Sequence[str]) -> DataFrame:
    """Left join on equal keys and on orders that are equal or both NULL; adds the other columns of ``marks``."""
    orders = [o for o in orders if o not in keys]
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"_d.{k}") == F.col(f"_m.{k}"))
    for o in orders:
        on = on & F.col(f"_d.{o}").eqNullSafe(F.col(f"_m.{o}"))
    added = [c for c in marks.columns if c not in (*keys, *orders)]
    return df.alias("_d").join(marks.alias("_m"), on, "left").select(
        *[F.col(f"_d.`{c}`") for c in df.columns], *[F.col(f"_m.{c}") for c in added])


def first_flags(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], flag: str = "is_first") -> DataFrame:
    """Mark the first row of every key; ``key + order`` must identify a row.

    The minimum is combined on the map side, and the join back is on key AND
    order, so even the rows of a hot key spread over all tasks. A row whose key
    is NULL has nothing to be equal to and counts as first; NULL in an order
    column comes after all values.
    """
    keys, orders = _names(key), _names(order)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    firsts = (
        df.where(known).groupBy(*keys).agg(earliest(orders).alias("_first"))
        .select(*keys, *[F.col(f"_first.{o}") for o in orders if o not in keys], F.lit(True).alias("_hit"))
    )
    return (
        join_marks(df, firsts, keys, orders)
        .withColumn(flag, F.coalesce(F.col("_hit"), ~known))
        .drop("_hit")
        .select(*df.columns, flag)
    )


def keep_first(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """Only the first row of every key."""
    return first_flags(df, key, order, "_keep").where("_keep").drop("_keep")


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``hot_rows`` rows, and over how many tasks to spread each."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_rows)
    return counted.select(*keys, (F.ceil(F.col("_n") / hot_rows) * 4).cast("int").alias("_salts"))


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a look-up table is small enough to send to every executor, by the size Spark expects."""
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size) <= limit


def _salted_join(df: DataFrame, table: DataFrame, keys: list[str], salt_by: str, how: str, hot_rows: int | None = None) -> DataFrame:
    """Join ``df`` to ``table``, the rows of hot keys spread over as many tasks as their number asks for.

    Only the rows of hot keys are repeated in ``table``. A NULL key meets
    nothing, so its rows are spread too. The list of hot keys is written first,
    so Spark knows its size and broadcasts it only while it is small.
    """
    hot = materialized(hot_keys(df, keys, hot_rows) if hot_rows else hot_keys(df, keys), "hot-keys")
    hot = F.broadcast(hot) if fits_broadcast(hot) else hot
    spread = table.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    salts = F.when(missing, NULL_SALTS).otherwise(F.coalesce("_salts", F.lit(1)))
    return (
        df.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_by), salts).cast("int"))
        .join(spread, [*keys, "_salt"], how)
        .drop("_salt", "_salts")
    )


def lookup(df: DataFrame, table: DataFrame, key: str | Sequence[str], salt_by: str, hot_rows: int | None = None) -> DataFrame:
    """Left join to a table with one row per key.

    A table that Spark knows to be small is broadcast, so ``df`` is not shuffled
    at all. Of others Spark may not know the size, as of rows that the driver
    gave; they are written, and broadcast if they turn out to be small. A larger
    one is joined with the hot keys of ``df`` salted by the column ``salt_by``;
    for wide rows give a smaller ``hot_rows``.
    """
    keys = _names(key)
    if fits_broadcast(table):
        return df.join(F.broadcast(table), keys, "left")
    table = materialized(table, "look-up")
    if fits_broadcast(table) and table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), keys, "left")
    return _salted_join(df, table, keys, salt_by, "left", hot_rows)


def without_known(df: DataFrame, known: DataFrame, key: str | Sequence[str], salt_by: str | None = None) -> DataFrame:
    """Rows whose key is not in ``known``.

    Nothing stands between the shuffles and the join, so Spark's skew join can
    split a hot key's rows over several tasks. Where the rows of one key must be
    spread in any case, give ``salt_by``, a column that differs between them.
    """
    keys = _names(key)
    wanted = known.select(*keys)
    if salt_by is None:
        kept = df.join(wanted, keys, "left_anti")
    else:
        kept = _salted_join(df, wanted, keys, salt_by, "left_anti")
    return kept.select(*df.columns)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    ties: Sequence[str],
    value: Column,
    name: str,
    strict: bool = False,
    block: int = RANGE_ROWS,
) -> DataFrame:
    """Running maximum of ``value`` per ``by`` in the order ``order, *ties``.

    A scan in two passes. The rows are sorted into ranges of about ``block`` rows by
    (by, order, ties), cut where the rows lie and not where the values lie, so neither
    a hot key nor values far apart make one range larger than another; only rows equal
    in all of these stay together. The first pass takes the maximum of each key's part
    of each range; one row for each such part then carries the maximum of the parts
    before it into the second pass. The table is written first and its rows are
    counted, so this starts jobs. ``strict`` leaves the current row out. The value may
    be a struct, so "last non-null" is the maximum of (order, value).
    """
    places = [*by, order, *ties]
    valued = materialized(df.withColumn("_v", value), "values")
    ranges = max(1, -(-valued.count() // block))
    ranged = materialized(valued.repartitionByRange(ranges, *places).withColumn("_range", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = ranged.groupBy(*by, "_range").agg(F.max("_v").alias("_m")).withColumn("_carry", F.max("_m").over(before)).drop("_m")
    inside = W.partitionBy(*by, "_range").orderBy(order, *ties)
    inside = inside.rowsBetween(W.unboundedPreceding, -1 if strict else W.currentRow)
    scanned = ranged.withColumn("_here", F.max("_v").over(inside))
    return join_marks(scanned, carry, [], [*by, "_range"]).withColumn(
        name, F.array_max(F.array("_here", "_carry"))).select(*df.columns, name)
