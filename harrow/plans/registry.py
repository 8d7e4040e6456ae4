"""Named queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harrow.operators import dom
from harrow.session import configure
from harrow.sources.pages import TABLES, table


class Tables:
    """The tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.folder, name)

    def parsed(self, pages: DataFrame | None = None) -> DataFrame:
        """The page table (or a rewriting of it) as arrays of nodes."""
        return dom.parse_pages(spread(self.pages if pages is None else pages))


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for a plain scan of fewer splits than there are cores.

    The given page table is one small file. A large table has more splits than
    the cluster has cores and is left alone, so its pages are never shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


_queries: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a function of ``Tables``; without SQL only its rows are checked."""

    def add(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in _queries:
            raise ValueError(f"query {fn.__name__} is registered twice")
        _queries[fn.__name__] = (fn, sql)
        return fn

    return add


def _load() -> None:
    from harrow.plans import (  # noqa: F401
        queries_dedup, queries_extract, queries_files, queries_frontier, queries_profile, queries_rules, queries_runs, queries_state, queries_stream, queries_text, queries_walk,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Tables(configure(spark), str(folder)))

    return {name: bind(fn) for name, (fn, _) in _queries.items()}


def all_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _queries.items() if sql}
