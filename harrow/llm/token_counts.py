"""Number of tokens of every document.

The texts of an Arrow stage are regrouped into steps of about equal bytes; a
longer text is cut at safe boundaries into pieces of that size. Only lengths
leave the stage. There is no shuffle: every row is answered where it is read.

Defined results: a NULL or empty text has 0 bytes and 0 tokens; a NULL id stays
NULL; repeated rows give repeated rows; columns besides the id and the text are
not read, so their names do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import STEP_BYTES, arrow_map, byte_lengths, steps, text_bytes
from harrow.llm.encoding import safe_boundaries, shared_encoder


class _Pieces:
    """Whole texts for a sentencepiece model file, with the interface of ``Encoder``."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(self, column) -> np.ndarray:
        found = self.model.encode([x or "" for x in column.to_pylist()], num_threads=1)
        return np.fromiter(map(len, found), np.int64, len(found))


def library(path: str):
    """The encoder for a vocabulary file: sentencepiece for ``.model``, else tokenizers."""
    return _Pieces(path) if path.endswith(".model") else shared_encoder(path)


def long_length(encoder, text: pa.ChunkedArray, limit: int) -> int:
    """Tokens of one long text, encoded in pieces of about ``limit`` bytes."""
    data, _ = text_bytes(text)
    places = np.sort(safe_boundaries(data))
    total, start = 0, 0
    while start < len(data):
        k = int(np.searchsorted(places, start + limit))
        stop = int(places[k]) if k < len(places) else len(data)
        total += int(encoder.lengths(pa.array([data[start:stop].tobytes().decode()], pa.large_string()))[0])
        start = stop
    return total


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text",
    step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``vocabulary`` is a file that every executor can open; no special tokens
    are added, and nothing is cut off or filled up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library(vocabulary)
        for step in steps(batches, "text", step_bytes):
            column = step.column("text")
            n_bytes = np.concatenate([byte_lengths(c) for c in column.chunks])
            if len(column) == 1 and n_bytes[0] > step_bytes and not isinstance(encoder, _Pieces):
                n_tokens = np.array([long_length(encoder, column, step_bytes)])
            else:
                n_tokens = encoder.lengths(column)
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id").combine_chunks(), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
