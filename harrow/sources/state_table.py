"""State tables in buckets: a batch reads and rewrites only the buckets its keys fall into.

A table is a folder with ``data/<change>/_bucket=b``, never changed once written,
and ``manifest/version=v``, one row for each bucket with the change that wrote
it. A change writes the touched buckets below a folder of its own and then the new
manifest; Spark moves its one file into place last, so readers see either the old
or the new version, whole, and a job that dies leaves nothing that is read. The
functions of ``operators.state`` (old rows + batch -> new rows) are the steps.

A step must keep keys in the table and may drop rows. One writer at a time: of
two, the later one is refused. A writer that names itself and numbers
its batches may repeat one, as a stream does after a failure; it is then skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.session import discard, materialized

Step = Callable[[DataFrame, DataFrame], DataFrame]

MANIFEST = "bucket int, held string, writer string, batch long, buckets int"


class StateTable:
    """A keyed table below ``root``. ``buckets`` is fixed when the table is made: one task writes a bucket."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.schema = StructType.fromDDL(schema)

    def bucket(self) -> Column:
        """The bucket of a row, by its keys."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The latest version; 0 before the first change."""
        try:
            versions = self.spark.read.schema(f"{MANIFEST}, version long").parquet(f"{self.root}/manifest")
        except AnalysisException:  # no such folder yet
            return 0
        return versions.agg(F.max("version")).first()[0] or 0

    def _manifest(self, version: int) -> tuple[dict[int, str], dict[str, int]]:
        """(change that wrote each bucket, last batch of each writer): a row for each bucket and writer."""
        if not version:
            return {}, {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={version}").collect()
        if any(r.buckets != self.buckets for r in rows):
            raise ValueError(f"{self.root} has {rows[0].buckets} buckets")
        return {r.bucket: r.held for r in rows if r.held is not None}, {r.writer: r.batch for r in rows if r.writer is not None}

    def _rows(self, held: dict[int, str]) -> DataFrame:
        paths = [f"{self.root}/data/{v}/_bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the latest by default; later changes do not show."""
        return self._rows(self._manifest(self.version() if version is None else version)[0])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose keys are in ``keys``, from the buckets these fall into."""
        held, _ = self._manifest(self.version())
        touched = {r[0] for r in keys.select(self.bucket()).distinct().collect()}
        return self._rows({b: v for b, v in held.items() if b in touched}).join(keys.select(*self.keys), self.keys, "left_semi")

    def update(self, batch: DataFrame, step: Step, writer: str | None = None, number: int | None = None) -> bool:
        """Replace the buckets of the batch's keys by ``step(their rows, batch)``.

        False if this writer's batch of that number, or a later one, is in the table already.
        """
        version = self.version()
        held, writers = self._manifest(version)
        if writer is not None and number is not None and writers.get(writer, -1) >= number:
            return False
        own = materialized(batch, "batch")
        touched = sorted(r[0] for r in own.select(self.bucket()).distinct().collect())
        new = step(self._rows({b: held[b] for b in touched if b in held}), own).select(*self.schema.names)
        change = f"{version + 1}-{uuid.uuid4().hex[:12]}"
        new.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/data/{change}")
        written = self._below(f"{self.root}/data/{change}", "_bucket=")
        written = {int(b) for b in written}
        strangers = written - set(touched)
        if strangers:
            raise ValueError(f"the step made rows of other buckets: {sorted(strangers)[:5]}")
        after = {**{b: v for b, v in held.items() if b not in touched}, **dict.fromkeys(written, change)}
        if writer is not None:
            writers = {**writers, writer: number}
        rows = [(b, v, None, None, self.buckets) for b, v in sorted(after.items())] + [(None, None, w, n, self.buckets) for w, n in sorted(writers.items())]
        manifest = self.spark.createDataFrame(rows or [(None, None, None, None, self.buckets)], MANIFEST)
        manifest.coalesce(1).write.mode("error").parquet(f"{self.root}/manifest/version={version + 1}")
        discard(own)
        return True

    def clean(self, keep: int = 2) -> int:
        """Delete what none of the last ``keep`` versions holds, dead jobs' folders too; the number of folders deleted."""
        version = self.version()
        kept = {(v, str(b)) for old in range(max(1, version - keep + 1), version + 1) for b, v in self._manifest(old)[0].items()}
        gone = 0
        for change in self._below(f"{self.root}/data"):
            buckets = self._below(f"{self.root}/data/{change}", "_bucket=")
            for b in buckets:
                if (change, b) not in kept:
                    gone += self._delete(f"{self.root}/data/{change}/_bucket={b}")
        for v in self._below(f"{self.root}/manifest", "version="):
            if int(v) <= version - keep:
                gone += self._delete(f"{self.root}/manifest/version={v}")
        return gone

    def _folder(self, path: str) -> tuple:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _below(self, path: str, prefix: str = "") -> set[str]:
        store, place = self._folder(path)
        names = [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
        return {n.removeprefix(prefix) for n in names if n.startswith(prefix)}

    def _delete(self, path: str) -> bool:
        store, place = self._folder(path)
        return store.delete(place, True)
