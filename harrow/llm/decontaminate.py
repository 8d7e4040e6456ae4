"""Benchmark passages in documents: Wu-Manber search for many word sequences at once.

A pattern is a window of ``width`` consecutive words of a benchmark item, or all
words of a shorter item. For each pattern length there is a shift table over
blocks of two words, which tells how far the end of a window can move without
missing an occurrence, and buckets of patterns by their last block. Where the
shift is 0 the first word and then the spelled words are compared. Documents
are cut into lanes of window ends; all lanes of a step move on together.

The patterns are the stated query set: they are read in blocks of at most
``block_bytes`` of benchmark text, each written to the shared folder, and a task
holds one block at a time. Documents are read once and not shuffled.

Defined results: a NULL or empty text, or one without words, has no words and
no hit; an item without words has no window; an item with a NULL id marks words
but is not listed; rows with the same item id are one item; repeated documents
give repeated rows; an empty benchmark hits nothing; other columns are not
looked at and, with ``with_row``, kept as they are in the struct ``row``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import common
from harrow.llm.common import arrow_map, load_bytes, ragged, save_bytes, steps, text_bytes
from harrow.llm.words import ALPHANUMERIC, Words, mix, words
from harrow.session import shared_dir

LANE = 512
# Word arrays take some thirty bytes for each byte of text.
STEP_BYTES = 3 << 20


def _key(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    """Table entry of a block of two word hashes."""
    return (mix(first * np.uint64(3) + second) >> np.uint64(shift)).astype(np.int64)


class Patterns:
    """Patterns of one length with their tables."""

    def __init__(self, hashes: np.ndarray, spelled: list[bytes], items: list[tuple[int, ...]]) -> None:
        n, self.m = hashes.shape
        self.block = min(2, self.m)
        bits = int(np.clip(np.ceil(np.log2(32 * n * max(1, self.m - 1))), 12, 24))
        self.shift_bits = 64 - bits
        self.jump = np.full(1 << bits, self.m - self.block + 1, np.uint16 if self.m < 65_000 else np.int64)
        for end in range(self.block, self.m + 1):  # words before the end of the block
            key = _key(hashes[:, end - self.block], hashes[:, end - 1], self.shift_bits)
            np.minimum.at(self.jump, key, self.m - end)
        last = _key(hashes[:, self.m - self.block], hashes[:, self.m - 1], self.shift_bits)
        order = np.argsort(last, kind="stable")
        self.bucket_keys, self.bucket_starts = np.unique(last[order], return_index=True)
        self.bucket_starts = np.append(self.bucket_starts, n)
        self.first_word = hashes[order, 0]
        self.spelled = [spelled[i] for i in order]
        self.items = [items[i] for i in order]

    def occurrences(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, number of its first word) of every occurrence."""
        h, m = text.hashes, self.m
        begin, stop = text.of_text[:-1] + m - 1, text.of_text[1:]
        n_lanes = np.maximum(0, -(-(stop - begin) // LANE))
        at = np.repeat(begin, n_lanes) + LANE * (np.arange(int(n_lanes.sum())) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes))
        end = np.minimum(np.repeat(stop, n_lanes), at + LANE)
        patterns, places = [], []
        while len(at):
            key = _key(h[at - self.block + 1], h[at], self.shift_bits)
            jump = self.jump[key].astype(np.int64)
            here = np.flatnonzero(jump == 0)
            if len(here):
                bucket = np.searchsorted(self.bucket_keys, key[here])
                sizes = self.bucket_starts[bucket + 1] - self.bucket_starts[bucket]
                pattern = ragged(self.bucket_starts[bucket], sizes)
                first = np.repeat(at[here] - m + 1, sizes)
                same = self.first_word[pattern] == h[first]
                for p, f in zip(pattern[same].tolist(), first[same].tolist(), strict=True):
                    if text.spelled(f, f + m) == self.spelled[p]:
                        patterns.append(p)
                        places.append(f)
                jump[here] = 1
            at = at + jump
            more = at < end
            at, end = at[more], end[more]
        return np.array(patterns, np.int64), np.array(places, np.int64)


def windows(rows: list[tuple[int | None, str | None]], width: int) -> list[Patterns]:
    """Tables for the windows of some items, one for each pattern length."""
    data, at = text_bytes(pa.array([t for _, t in rows], pa.large_string()))
    text = words(data, at, ALPHANUMERIC)
    found: dict[int, dict[bytes, tuple[int, set]]] = {}
    for k, (item, _) in enumerate(rows):
        a, b = int(text.of_text[k]), int(text.of_text[k + 1])
        m = min(width, b - a)
        for first in range(a, b - m + 1) if m else ():
            own = found.setdefault(m, {}).setdefault(text.spelled(first, first + m), (first, set()))
            if item is not None:
                own[1].add(item)
    return [
        Patterns(np.stack([text.hashes[first: first + m] for first, _ in own.values()]), list(own), [tuple(sorted(x)) for _, x in own.values()])
        for m, own in sorted(found.items())
    ]


def pattern_files(benchmark: DataFrame, width: int, item_id: str, text: str, block_bytes: int) -> list[str]:
    """Pattern tables of blocks of the benchmark, written to the shared folder."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    folder = shared_dir(benchmark.sparkSession, "patterns")
    paths = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        tables = windows([(r.item_id, r.text) for r in rows], width)
        if tables:
            paths.append(f"{folder}/block-{k:06d}")
            save_bytes(paths[-1], pickle.dumps(tables))
    return paths


def find_passages(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20, with_row: bool = False,
    step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """(doc_id or row, n_words, n_hit, hit_ranges, items) of every document.

    ``hit_ranges`` are ranges of word numbers (end exclusive) in which every
    word lies in some occurrence, ``items`` the ids of the items that occur.
    """
    paths = pattern_files(benchmark, width, item_id, item_text, block_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pickle.loads(load_bytes(p)) for p in paths[:1]]
        for step in steps(batches, "text", step_bytes):
            found = words(*text_bytes(step.column("text")), ALPHANUMERIC)
            n_words = np.diff(found.of_text)
            change = np.zeros(len(found.hashes) + 1, np.int64)
            items: list[set] = [set() for _ in n_words]
            for k, path in enumerate(paths):
                block = tables[0] if k == 0 else pickle.loads(load_bytes(path))
                for table in block:
                    pattern, first = table.occurrences(found)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + table.m, -1)
                    of = np.searchsorted(found.of_text, first, side="right") - 1
                    for p, d in set(zip(pattern.tolist(), of.tolist(), strict=True)):
                        items[d].update(table.items[p])
            hit = np.cumsum(change[:-1]) > 0
            upto = np.concatenate(([0], np.cumsum(hit)))
            # Ranges of hit words; a range also ends where its text ends.
            edge = np.zeros(len(hit) + 1, bool)
            edge[found.of_text] = True
            starts = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1]))[: len(hit)]))
            ends = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False]))[: len(hit)])) + 1
            of = np.searchsorted(found.of_text, starts, side="right") - 1
            base = found.of_text[of]
            ranges = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n_words) + 1)).astype(np.int32)), ranges)
            yield pa.RecordBatch.from_arrays(
                [step.column("row").combine_chunks(), pa.array(n_words), pa.array(np.diff(upto[found.of_text])), lists,
                 pa.array([sorted(x) for x in items], pa.list_(pa.int64()))],
                ["row", "n_words", "n_hit", "hit_ranges", "items"],
            )

    rows, kind = common.carried(docs, doc_id, text, with_row)
    out = arrow_map(rows, search, f"row {kind}, n_words long, n_hit long, hit_ranges array<struct<start:long,end:long>>, items array<long>")
    return out if with_row else out.select("row.doc_id", "n_words", "n_hit", "hit_ranges", "items")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20) -> F.Column:
    """At least one hit word, and at least one word in ``share`` is hit."""
    return (F.col(n_hit) > 0) & (share * F.col(n_hit) >= F.col(n_words))
