"""Language of a text by rank-order n-gram profiles.

A text becomes its lower-cased letters, with one blank around every word. Its
n-grams of 1 to 3 characters that hold a letter and have no blank inside are
counted; ties go to the n-gram that sorts first. A language's profile is the
ranks of its ``size`` most frequent n-grams over all its training texts. The
distance of a text to a profile sums, over the text's own ``size`` most
frequent n-grams, how far each is out of place, ``size`` for one that the
profile lacks; the nearest profile wins, ties by name.

Training counts are summed per step of a task, then by Spark. The profiles have
at most ``size`` rows for each language and are all that reaches the driver;
more than ``max_languages`` labels raise an error rather than being cut off.
Predictions use no shuffle.

Defined results: a NULL text, or one without a letter, is ``und`` with score 0,
as is every text when there is nothing to learn from; rows without a label are
not learned from, a NULL id counts as the empty text in ``residue``; repeated
rows count repeatedly; other columns are not looked at and, with ``with_row``,
kept as they are in the struct ``row``; an empty table gives no row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import arrow_map, carried, steps

UNKNOWN = "und"
BLANK = 32
# Characters are below 2**21, so three of them fit into one integer that sorts like the text.
BITS = 21
# The n-grams of a step take some fifty bytes for each byte of text.
STEP_BYTES = 2 << 20
# Different n-grams that a task holds before it passes their counts on.
HELD = 1 << 20


_table: np.ndarray | None = None


def _shared_letters() -> np.ndarray:
    """The table of this worker process, which outlives a task."""
    import harrow.llm.language_id as own  # a function sent to a worker has globals of its own

    if own._table is None:
        own._table = own._letters()
    return own._table


def _letters() -> np.ndarray:
    """For each character: the lower-case letter, or a blank."""
    table = np.full(sys.maxunicode + 1, BLANK, np.int32)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _stream(text: str) -> np.ndarray:
    """Letters of a text with one blank before, between and after the words."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _shared_letters()[codes].astype(np.int64)
    blank = out == BLANK
    return out[~(blank & np.concatenate(([False], blank[:-1])))]


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text."""
    c = _stream(text)
    if len(c) < 2:
        return np.zeros(0, np.int64)
    letter = c != BLANK
    one = c[letter] << (2 * BITS)
    two = (c[:-1] << (2 * BITS)) | (c[1:] << BITS)
    if len(c) < 3:
        return np.concatenate((one, two))
    three = ((c[:-2] << (2 * BITS)) | (c[1:-1] << BITS) | c[2:])[letter[1:-1]]
    return np.concatenate((one, two, three))


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    codes = np.sort(codes)
    new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[new], np.diff(np.append(new, len(codes)))


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of two lists of distinct codes together."""
    found, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return found, np.bincount(at, np.concatenate((a[1], b[1])), len(found)).astype(np.int64)


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties in order of the code."""
    if not len(codes):
        return codes
    found, counts = _counts(codes)
    if len(found) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        chosen = counts >= least
        found, counts = found[chosen], counts[chosen]
    return found[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(
    docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", size: int = 300, step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """(lang, gram, rank) of the most frequent n-grams of each language, ranks from 0."""

    def passed_on(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for name, (found, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(counts)], ["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for step in steps(batches, "text", step_bytes):
            by_lang: dict[str, list[np.ndarray]] = {}
            for name, value in zip(step.column("lang").to_pylist(), step.column("text").to_pylist(), strict=True):
                by_lang.setdefault(name, []).append(ngrams(value))
            for name, parts in by_lang.items():
                own = _counts(np.concatenate(parts))
                held[name] = _added(held[name], own) if name in held else own
            if sum(len(found) for found, _ in held.values()) > HELD:
                yield from passed_on(held)
                held = {}
        yield from passed_on(held)

    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    totals = arrow_map(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # Spark keeps the first rows of each language before it shuffles them.
    first = totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return first.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """Ranks of all profiles as one table."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.names = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        # A last row stands for n-grams that no profile has; -1: not in this profile.
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        column = {n: i for i, n in enumerate(self.names)}
        for name, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), column[name]] = rank

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a text's ranked n-grams to each language."""
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = len(self.grams) - 1
        row = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[row]
        away = np.abs(ranks - np.arange(len(own))[:, None])
        return np.where(ranks < 0, self.size, np.minimum(away, self.size)).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float, int, int]:
        """Language, score, distance, and number of n-grams compared."""
        own = ranked(ngrams(text), self.size) if text and self.names else ()
        if not len(own):
            return UNKNOWN, 0.0, 0, 0
        found = self.distances(own)
        best = int(np.argmin(found))
        distance = int(found[best])
        return self.names[best], 1.0 - distance / (self.size * len(own)), distance, len(own)


def identify(
    docs: DataFrame, profiles: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 300,
    max_languages: int = 2_000, with_row: bool = False, step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """(doc_id or row, lang_pred, score, distance, n_grams) of every document."""
    rows = profiles.select("lang", "gram", "rank").limit(max_languages * size + 1).collect()
    if len({r[0] for r in rows}) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    shared = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in rows], size))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for step in steps(batches, "text", step_bytes):
            found = [known.predict(t) for t in step.column("text").to_pylist()]
            lang, score, distance, n = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [step.column("row").combine_chunks(), pa.array(lang), pa.array(score, pa.float64()),
                 pa.array(distance, pa.int64()), pa.array(n, pa.int64())],
                ["row", "lang_pred", "score", "distance", "n_grams"],
            )

    rows, kind = carried(docs, doc_id, text, with_row)
    out = arrow_map(rows, predict, f"row {kind}, lang_pred string, score double, distance long, n_grams long")
    return out if with_row else out.select("row.doc_id", "lang_pred", "score", "distance", "n_grams")
