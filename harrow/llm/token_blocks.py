"""Token ids of a corpus in binary files of patched frame-of-reference blocks.

File format (little endian). A file holds the ids of whole documents:

    header     magic (8 bytes), block size u32, blocks u32, ids u64, documents u64,
               byte position of the document table u64, of the block index u64
    blocks     for each block of 1,024 ids: the low ``width`` bits of id - minimum, in 32
               lanes of u32 words (id number r * 32 + l is entry r of lane l); then the
               exceptions, whose differences need more bits: places u16, differences u32
    documents  doc_id i64, NULL flag u8, number of ids i64 (three columns)
    index      for each block: byte position u64, minimum u32, exceptions u16, width u8, 0 u8

``width`` is the number of bits that a percentile of the block's differences
needs, the one of a few percentiles that makes the block smallest. The index gives any block without reading the ones before it.

Documents are dealt by ranges of (doc_id, hash of the text), so files follow
one another in ascending doc_id order; a file is written under a name of its
attempt and then moved, so a task that is run again replaces its own files. The
manifest, a table with a row for each file, says where in the corpus each file
begins; the sums are taken per partition first.

Defined results: a NULL or empty text is one end id; a NULL id comes first and
stays NULL; documents with one id follow each other by the hash of their text;
repeated rows are written repeatedly; other columns are not read; an empty
table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.common import STEP_BYTES, arrow_map, kept, load_bytes, save_bytes, steps
from harrow.llm.encoding import shared_encoder
from harrow.session import shared_dir

MAGIC = b"PFORIDS1"
BLOCK = 1024
LANES = 32
HEADER = "<8sIIQQQQ"
HEADER_SIZE = struct.calcsize(HEADER)
INDEX = np.dtype([("at", "<u8"), ("minimum", "<u4"), ("exceptions", "<u2"), ("width", "u1"), ("zero", "u1")])
MANIFEST = "part int, file int, path string, n_ids long, n_docs long"


# --- blocks -------------------------------------------------------------

def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that unsigned values need."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks of differences (n, BLOCK), below 2**width each, to words (n, width, LANES)."""
    rows = values.reshape(len(values), BLOCK // LANES, LANES)
    words = np.zeros((len(values), width, LANES), np.uint32)
    for r in range(BLOCK // LANES):
        word, shift = divmod(r * width, 32)
        if width:
            words[:, word] |= rows[:, r] << np.uint32(shift)
        if shift + width > 32:
            words[:, word + 1] |= rows[:, r] >> np.uint32(32 - shift)
    return words


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The differences that ``pack`` was given."""
    values = np.zeros((len(words), BLOCK // LANES, LANES), np.uint32)
    if width:
        mask = np.uint32((1 << width) - 1)
        for r in range(BLOCK // LANES):
            word, shift = divmod(r * width, 32)
            part = words[:, word] >> np.uint32(shift)
            if shift + width > 32:
                part = part | (words[:, word + 1] << np.uint32(32 - shift))
            values[:, r] = part & mask
    return values.reshape(len(words), BLOCK)


# Percentiles of a block's differences whose widths are tried.
PERCENTILES = (0.85, 0.92, 0.97, 1.0)


def encode_blocks(ids: np.ndarray, percentiles: tuple[float, ...] = PERCENTILES) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each block and the index, whose positions count from 0.

    A block's width is that of the percentile that makes the block smallest.
    """
    n = -(-len(ids) // BLOCK)
    values = np.zeros(n * BLOCK, np.uint32)
    values[: len(ids)] = ids
    if len(ids) < len(values):
        values[len(ids):] = ids[-1]
    values = values.reshape(n, BLOCK)
    index = np.zeros(n, INDEX)
    if not n:
        return [], index
    index["minimum"] = values.min(axis=1)
    values = values - index["minimum"][:, None]
    places = sorted({int(p * (BLOCK - 1)) for p in percentiles})
    widths = np.stack([_bits(x) for x in np.partition(values, places, axis=1)[:, places].T])

    def beyond(width: np.ndarray) -> np.ndarray:
        return (values >> np.minimum(width, 31)[:, None].astype(np.uint32) != 0) & (width < 32)[:, None]

    sizes = np.stack([w * (LANES * 4) + 6 * beyond(w).sum(axis=1) for w in widths])
    index["width"] = widths[sizes.argmin(axis=0), np.arange(n)]
    over = beyond(index["width"].astype(np.int64))
    index["exceptions"] = over.sum(axis=1)
    block, place = np.nonzero(over)
    patch, place = values[block, place], place.astype("<u2")
    ends = np.cumsum(index["exceptions"], dtype=np.int64)
    payload: list[bytes] = [b""] * n
    for width in np.unique(index["width"]):
        rows = np.flatnonzero(index["width"] == width)
        mask = np.uint32((1 << int(width)) - 1)
        words = pack(values[rows] & mask, int(width))
        for i, row in enumerate(rows):
            b, a = ends[row], ends[row] - index["exceptions"][row]
            payload[row] = words[i].astype("<u4").tobytes() + place[a:b].tobytes() + patch[a:b].astype("<u4").tobytes()
    index["at"] = np.cumsum([0, *map(len, payload[:-1])])
    return payload, index


def decode_blocks(data: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Ids of the blocks that ``index`` lists, padding included; ``data`` holds the whole file."""
    out = np.zeros((len(index), BLOCK), np.uint32)
    for width in np.unique(index["width"]):
        rows = np.flatnonzero(index["width"] == width)
        size = int(width) * LANES * 4
        words = np.empty((len(rows), int(width), LANES), np.uint32)
        for i, row in enumerate(rows):
            at = int(index["at"][row])
            words[i] = data[at: at + size].view("<u4").reshape(int(width), LANES)
        out[rows] = unpack(words, int(width))
    for row in np.flatnonzero(index["exceptions"]):
        n = int(index["exceptions"][row])
        at = int(index["at"][row]) + int(index["width"][row]) * LANES * 4
        places = np.frombuffer(data[at: at + 2 * n].tobytes(), "<u2")
        out[row, places] = np.frombuffer(data[at + 2 * n: at + 6 * n].tobytes(), "<u4")
    return out + index["minimum"][:, None]


# --- files --------------------------------------------------------------

def file_bytes(ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray, percentiles: tuple[float, ...] = PERCENTILES) -> bytes:
    """One file; ``doc_ids`` may hold NULL."""
    payload, index = encode_blocks(ids, percentiles)
    index["at"] += HEADER_SIZE
    table_at = HEADER_SIZE + sum(map(len, payload))
    nulls = np.asarray(doc_ids.is_null().to_numpy(zero_copy_only=False), np.uint8)
    table = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + nulls.tobytes() + lengths.astype("<i8").tobytes()
    header = struct.pack(HEADER, MAGIC, BLOCK, len(index), len(ids), len(lengths), table_at, table_at + len(table))
    return b"".join([header, *payload, table, index.tobytes()])


class BlockFile:
    """A file's bytes, read."""

    def __init__(self, content: bytes) -> None:
        magic, block, n_blocks, self.n_ids, n_docs, table_at, index_at = struct.unpack_from(HEADER, content)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a file of id blocks")
        self.data = np.frombuffer(content, np.uint8)
        self.index = np.frombuffer(content, INDEX, n_blocks, index_at)
        ids = np.frombuffer(content, "<i8", n_docs, table_at)
        nulls = np.frombuffer(content, np.uint8, n_docs, table_at + 8 * n_docs).astype(bool)
        self.doc_ids = pa.array(ids, pa.int64(), mask=nulls)
        self.lengths = np.frombuffer(content, "<i8", n_docs, table_at + 9 * n_docs)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the file; only their blocks are decoded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        found = decode_blocks(self.data, self.index[first:last]).reshape(-1)
        return found[start - first * BLOCK: stop - first * BLOCK]


# --- corpora ------------------------------------------------------------

def write_blocks(
    docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0, percentiles: tuple[float, ...] = PERCENTILES,
    doc_id: str = "doc_id", text: str = "text", step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns the manifest.

    ``folder`` is a URI that executors can write to by pyarrow's file systems;
    by default a new folder below ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "id-blocks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), shared_encoder(vocabulary)
        for number, step in enumerate(steps(batches, "text", step_bytes)):
            ids, at = encoder.encode(step.column("text"))
            n = len(at) - 1
            full = np.full(len(ids) + n, end_id, np.uint32)
            inside = np.ones(len(full), bool)
            inside[at[1:] + np.arange(n)] = False
            full[inside] = ids
            path = f"{folder}/part-{part:06d}-{number:06d}.ids"
            save_bytes(path, file_bytes(full, step.column("doc_id").combine_chunks(), np.diff(at) + 1, percentiles))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([path]),
                 pa.array([len(full)], pa.int64()), pa.array([n], pa.int64())],
                ["part", "file", "path", "n_ids", "n_docs"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    files = kept(arrow_map(ordered, write, MANIFEST), "id-manifest")
    # Where each partition begins: one row for each partition meets in one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).select(
        "part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(parts, "part").select(
        "part", "file", "path", "n_ids", "n_docs",
        (F.col("part_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("start"),
    )


def read_blocks(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files."""
    spark: SparkSession = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = BlockFile(load_bytes(path))
                ids = file.ids().astype("<u4")
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a: 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [file.doc_ids, pa.array(starts + start), pa.array(file.lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    # A row is a whole file, so the rows are dealt out one by one.
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return arrow_map(
        manifest.select("path", "start").repartition(tasks), read,
        "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""),
    )
