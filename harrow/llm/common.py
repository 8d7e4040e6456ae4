"""Helpers shared by the operators: Arrow stages, shared folders, document keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.session import shared_dir

# Text held by one step of an Arrow stage at most, unless a single text is longer.
STEP_BYTES = 8 << 20
# Rows that Spark sends to a worker at once come to about this size.
BATCH_BYTES = 8 << 20


def residue(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of bounded size, whose worker gives memory back as soon as Arrow frees it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that is free inside this worker to the system; workers outlive their tasks."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library of Linux has it
        trim(0)


def kept(df: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so later steps start from files."""
    path = shared_dir(df.sparkSession, purpose)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return reread(df.sparkSession, path, df)


def reread(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table written by ``kept`` that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        forget_folder(df.sparkSession, folder)


def forget_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables that hold about ``limit`` bytes of one column.

    Small batches are put together, large ones are cut between rows, so the
    memory of a step depends on neither the number of rows nor the batch size.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(byte_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start = stop
            if size >= limit or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def byte_lengths(values: pa.Array) -> np.ndarray:
    """Bytes of each text or binary value; 0 for NULL."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each text starts.

    NULL is the empty text. The second array has one more entry than there are texts.
    """
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]: at[-1]], at - at[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of all runs one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def carried(docs: DataFrame, doc_id: str, text: str, whole: bool) -> tuple[DataFrame, str]:
    """(row, text): the id alone or all columns as a struct beside the text, and the struct's type.

    A struct keeps columns of any name apart from those that an operator adds.
    """
    id_ = F.col(doc_id).cast("long").alias("doc_id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if whole else F.struct(id_)
    rows = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    return rows, rows.schema["row"].dataType.simpleString()


def save_bytes(path: str, content: bytes) -> None:
    """Write a file of the shared folder under an own name, then move it to its place."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    folder, name = at.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    own = f"{folder}/_{uuid.uuid4().hex}-{name}"
    with store.open_output_stream(own) as out:
        out.write(content)
    store.move(own, at)


def load_bytes(path: str) -> bytes:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return f.read()
