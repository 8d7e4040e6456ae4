"""Phrase collocations by SETM: occurrence relations, joined with themselves to grow.

The relation R1 says which word stands at which place of which piece of text; Rk
does so for the frequent phrases of k words. A step joins Rk with itself on piece
and next place, counts the groups, and keeps (semi-joins) the occurrences of
phrases that reach ``least``; these are R(k+1). Every relation is written, sorted
by place, before the next step reads it.

A relation is stored in blocks of about ``BLOCK_WORDS`` places: an array with the
number of the phrase that begins at each place (-1: none, or the end of a piece),
and the id of each number. Both sides of the merge join lie in one block in one
order, so it is a comparison of the array with itself one place on and moves no
rows. What Spark shuffles is one row for each block and distinct phrase: sorted by
phrase, their sum is the frequency, and the rows of a frequent phrase go back to
their blocks with its id. A phrase is known as frequent after ``least``
occurrences, so a phrase's rows are never gathered, however many blocks have it. A
piece longer than a block goes on in the next one, which repeats the last words
and counts only phrases that end after them.

Frequencies are per language. A phrase of several words is scored at each cut;
the lowest score counts. All arithmetic is on integers of up to 38 digits.

Defined results: a NULL text has no words, a NULL language is ``und``; repeated
rows count each; ids are not read, and neither are other columns, so their names
cannot clash; ties end with the phrase itself, so ranks are unique; an empty table
gives an empty one. Texts are read in windows, so a very long text, or a long
piece without any separator, takes no more memory than others, but for a single
word, which is held whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import arrow_map, forget, kept, ragged, steps, text_bytes
from harrow.llm.words import mix, words

BLOCK_WORDS = 1 << 20
WINDOW_BYTES = 1 << 20
# Parts in which the phrases of a language are ranked first.
RANKED_APART = 64
# Rows of one Arrow batch of an operator's output.
OUT_ROWS = 1 << 16
# What ends a piece, and what lies between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACES = b"\x20\x09"
SCALE = 1_000_000

ENDS = np.zeros(256, bool)
ENDS[list(PIECE_ENDS)] = True
INSIDE = ~ENDS
INSIDE[list(SPACES)] = False

RELATION = "block long, own int, n_codes int, places int, seq binary, ids binary"


# --- the first relation ---------------------------------------------------

def packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpacked(content: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(content, n * np.dtype(kind).itemsize, codec="zstd"), kind)


def windows(data: np.ndarray, at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that cut no word; ``at``: where texts begin, and the end."""
    start = 0
    while start < len(data):
        stop = min(len(data), start + limit)
        if stop < len(data):
            outside = np.flatnonzero(~INSIDE[data[start:stop]])
            best = max(start + int(outside[-1]) + 1 if len(outside) else start, int(at[np.searchsorted(at, stop, side="right") - 1]))
            if best <= start:  # one word fills the window and goes on
                text_end, best = int(at[np.searchsorted(at, start, side="right")]), stop
                while best < text_end and INSIDE[data[best]]:
                    ahead = np.flatnonzero(~INSIDE[data[best: min(text_end, best + limit)]])
                    best = best + int(ahead[0]) if len(ahead) else min(text_end, best + limit)
            stop = best
        yield start, stop
        start = stop


class Block:
    """Places and vocabulary of one block while it is filled."""

    def __init__(self, context: int) -> None:
        self.context, self.places, self.own = context, 0, 0
        self.codes: list[np.ndarray] = []  # numbers within the window, -1 at the end of a piece
        self.hashes: list[np.ndarray] = []  # of the distinct (language, word) of each window
        self.spelled: list[pa.Array] = []
        self.langs: list[pa.Array] = []

    def add(self, codes: np.ndarray, hashes: np.ndarray, spelled: pa.Array, langs: pa.Array) -> None:
        base = sum(map(len, self.hashes))
        self.codes.append(np.where(codes >= 0, codes + base, -1).astype(np.int32))
        self.hashes.append(hashes)
        self.spelled.append(spelled)
        self.langs.append(langs)
        self.places += len(codes)

    def closed(self) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray, pa.Array, np.ndarray]:
        """(places as numbers of words, hashes, words, languages, occurrences of each behind the context)."""
        hashes, first, number = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        codes = np.concatenate(self.codes)
        seq = np.append(number, -1)[codes].astype(np.int32)
        own = seq[self.own:]
        n = np.bincount(own[own >= 0], minlength=len(hashes))
        take = pa.array(first)
        return seq, hashes, pa.concat_arrays(self.spelled).take(take), pa.concat_arrays(self.langs).take(take), n

    def following(self, seq: np.ndarray, hashes: np.ndarray, spelled: pa.Array, langs: pa.Array) -> Block:
        """The next block, which begins with the last words of the piece that goes on."""
        block = Block(self.context)
        tail = seq[max(0, len(seq) - self.context):]
        ends = np.flatnonzero(tail < 0)
        tail = tail[ends[-1] + 1:] if len(ends) else tail
        if len(tail):
            some, codes = np.unique(tail, return_inverse=True)
            block.add(codes, hashes[some], spelled.take(pa.array(some)), langs.take(pa.array(some)))
            block.own = len(tail)
        return block


def _windowed(data: np.ndarray, at: np.ndarray, langs: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """(numbers, hashes, words, languages) of each window; ``langs``: language of each text."""
    lang_hash = np.array([hash_of(x) for x in langs.to_pylist()], np.uint64)
    for start, stop in windows(data, at, limit):
        part = data[start:stop]
        texts = np.unique(at[(at > start) & (at < stop)])
        ends = [np.flatnonzero(ENDS[part]), texts - start, [stop - start] if at[np.searchsorted(at, stop)] == stop else []]
        ends = np.concatenate(ends).astype(np.int64)
        bounds = np.unique(np.concatenate(([0], ends, [stop - start])))
        found = words(part, bounds, INSIDE)
        n_words = len(found.hashes)
        before = lambda places: found.of_text[np.searchsorted(bounds, places)]  # noqa: E731, B023
        # Where a piece ends, -1 stands before the next word.
        breaks = np.unique(before(ends))
        numbers = np.full(n_words + len(breaks), -1, np.int64)
        if not n_words:
            yield numbers, np.zeros(0, np.uint64), pa.array([], pa.large_string()), langs.slice(0, 0)
            continue
        first_word = np.concatenate(([0], before(texts - start), [n_words]))
        text = np.repeat(np.searchsorted(at, np.concatenate(([start], texts)), side="right") - 1, np.diff(first_word))
        hashes, first, number = np.unique(mix(found.hashes + lang_hash[text]), return_index=True, return_inverse=True)
        every = np.arange(n_words)
        numbers[every + np.searchsorted(breaks, every, side="right")] = number
        sizes = np.diff(found.starts)[first]
        letters = found.letters[ragged(found.starts[:-1][first], sizes)]
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
        spelled = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
        yield numbers, hashes, spelled, langs.take(pa.array(text[first]))


def hash_of(lang: str) -> int:
    """64-bit number of a language's name."""
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode())


def _first_relation(docs: DataFrame, lang: str, text: str, context: int, block_words: int, window_bytes: int) -> DataFrame:
    """Rows of two kinds: a block with its places, and one row for each distinct word of a block."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), itertools.count()

        def written(block: Block) -> Iterator[pa.RecordBatch]:
            seq, hashes, spelled, langs, n = made = block.closed()
            name = (task << 32) + next(number)
            size = len(hashes)
            yield pa.RecordBatch.from_pylist(
                [{"block": name, "own": block.own, "n_codes": size, "places": len(seq), "seq": packed(seq)}], SCHEMA_FIRST)
            for a in range(0, size, OUT_ROWS):
                m = min(OUT_ROWS, size - a)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, name)), *[pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary())],
                    pa.array(np.arange(a, a + m, dtype=np.int32)), langs.slice(a, m).cast(pa.string()), spelled.slice(a, m).cast(pa.string()),
                    pa.array(n[a: a + m].astype(np.int64))], schema=SCHEMA_FIRST)
            return made[:4]

        block = Block(context)
        for table in steps(batches, "text"):
            data, at = text_bytes(table.column("text"))
            langs = table.column("lang").combine_chunks()
            langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
            for found in _windowed(data, at, langs, window_bytes):
                block.add(*found)
                if block.places >= block_words:
                    last = yield from written(block)
                    block = block.following(*last)
        if block.places > block.own:
            yield from written(block)

    return arrow_map(rows, run, FIRST)


FIRST = "block long, own int, n_codes int, places int, seq binary, code int, lang string, word string, n long"
SCHEMA_FIRST = pa.schema([
    ("block", pa.int64()), ("own", pa.int32()), ("n_codes", pa.int32()), ("places", pa.int32()), ("seq", pa.binary()),
    ("code", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


# --- counting groups ------------------------------------------------------

def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Phrases of at least ``least`` occurrences, and the block rows that have them.

    ``rows`` has the keys, block, code and n. The result has the keys, ``f`` and
    ``id`` for each phrase (block is NULL), and block, code and id for each row of it.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {"lang": pa.string(), "word": pa.string()}
    schema = pa.schema([(k, kinds.get(k, pa.int64())) for k in keys] + [
        ("f", pa.int64()), ("id", pa.int64()), ("block", pa.int64()), ("code", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        if task >= tasks:
            raise RuntimeError("more tasks than spark.sql.shuffle.partitions")
        ids = itertools.count()
        new_id = lambda: next(ids) * tasks + task + 1

        def phrases(values: list[pa.Array], f: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            m = len(f)
            return pa.RecordBatch.from_arrays([*values, pa.array(f), pa.array(own), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], schema=schema)

        def hits(own: np.ndarray, block: pa.Array, code: pa.Array) -> pa.RecordBatch:
            m = len(own)
            return pa.RecordBatch.from_arrays([*[pa.nulls(m, kinds.get(k, pa.int64())) for k in keys], pa.nulls(m, pa.int64()), pa.array(own), block, code], schema=schema)

        key: list = []  # of the run that the last batch ended with
        f, own, waiting = 0, 0, []  # its occurrences, its id once it is frequent, its rows until then

        def end() -> Iterator[pa.RecordBatch]:
            if own:
                yield phrases([pa.array([v], kinds.get(k, pa.int64())) for k, v in zip(keys, key, strict=True)], np.array([f]), np.array([own]))

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            columns = [batch.column(k) for k in keys]
            changed = reduce(pc.or_, [pc.not_equal(c.slice(1), c.slice(0, m - 1)) for c in columns])
            starts = np.concatenate(([0], np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1))
            sums = np.add.reduceat(batch.column("n").to_numpy(), starts)
            block, code = batch.column("block"), batch.column("code")
            first = [c[0].as_py() for c in columns]
            head = 0
            if key and first == key:
                head = 1
            elif key:
                yield from end()
                key, f, own, waiting = [], 0, 0, []
            last = len(starts) - 1
            # Runs that begin and end in this batch.
            inner = np.arange(head, last)
            good = inner[sums[inner] >= least]
            if head:
                stop = int(starts[1]) if last else m
                f += int(sums[0])
                waiting.append((block.slice(0, stop), code.slice(0, stop)))
                if f >= least and not own:
                    own = new_id()
                if own:
                    for b, c in waiting:
                        yield hits(np.full(len(b), own), b, c)
                    waiting = []
                if last:
                    yield from end()
                    key, f, own, waiting = [], 0, 0, []
            if len(good):
                numbers = np.array([new_id() for _ in range(len(good))])
                sizes = np.diff(np.append(starts, m))[good]
                rows_of = pa.array(ragged(starts[good], sizes))
                yield phrases([c.take(pa.array(starts[good])) for c in columns], sums[good], numbers)
                yield hits(np.repeat(numbers, sizes), block.take(rows_of), code.take(rows_of))
            if last >= head:
                at = int(starts[last])
                key, f = [c[at].as_py() for c in columns], int(sums[last])
                waiting = [(block.slice(at), code.slice(at))]
                own = new_id() if f >= least else 0
                if own:
                    yield hits(np.full(m - at, own), *waiting[0])
                    waiting = []
        if key:
            yield from end()

    types = ", ".join(f"{k} {'string' if k in kinds else 'long'}" for k in keys)
    dealt = rows.select(*keys, "block", "code", "n").repartition(*keys).sortWithinPartitions(*keys)
    return arrow_map(dealt, run, f"{types}, f long, id long, block long, code int")


# --- extending -------------------------------------------------------------

def joined(seq: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rk joined with itself one place on: (places, number at each, distinct pairs, their occurrences)."""
    left, right = seq[:-1], seq[1:]
    # Number -1 takes the last entry, which is no phrase.
    known = np.append(ids, 0)
    at = np.flatnonzero((known[left] > 0) & (known[right] > 0))
    pairs, number = np.unique(left[at].astype(np.int64) * len(known) + right[at], return_inverse=True)
    counted = number[at + k >= own]
    return at, number, pairs, np.bincount(counted, minlength=len(pairs))


def _relation(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return unpacked(row["seq"], row["places"], np.int32), unpacked(row["ids"], row["n_codes"], np.int64)


def _pairs(relation: DataFrame, k: int) -> DataFrame:
    """(left, right, block, code, n) of the phrases of k + 1 words in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seq, ids = _relation(row)
                _, _, pairs, n = joined(seq, ids, row["own"], k)
                left, right = ids[pairs // (len(ids) + 1)], ids[pairs % (len(ids) + 1)]
                for a in range(0, len(pairs), OUT_ROWS):
                    some = slice(a, a + OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(left[some]), pa.array(right[some]), pa.array(np.full(len(left[some]), row["block"])),
                        pa.array(np.arange(a, a + len(left[some]), dtype=np.int32)), pa.array(n[some].astype(np.int64))],
                        ["left", "right", "block", "code", "n"])

    return arrow_map(relation, run, "left long, right long, block long, code int, n long")


RELATION_SCHEMA = pa.schema([
    ("block", pa.int64()), ("own", pa.int32()), ("n_codes", pa.int32()), ("places", pa.int32()), ("seq", pa.binary()), ("ids", pa.binary())])


def _extended(relation: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """R(k+1): the occurrences in Rk joined with itself whose phrase is frequent; k = 0 gives R1 its ids."""

    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist() if found.num_rows else []:
            if k:
                seq, ids = _relation(row)
                at, number, pairs, _ = joined(seq, ids, row["own"], k)
                size = len(pairs)
            else:
                seq, size = unpacked(row["seq"], row["places"], np.int32), row["n_codes"]
            ids = np.zeros(size, np.int64)
            ids[found.column("code").to_numpy()] = found.column("id").to_numpy()
            # Frequent phrases get numbers of their own, all others -1.
            some = np.flatnonzero(ids)
            renamed = np.full(size + 1, -1, np.int32)
            renamed[some] = np.arange(len(some), dtype=np.int32)
            if k:
                new = np.full(len(seq), -1, np.int32)
                new[at] = renamed[number]
            else:
                new = renamed[seq]
            out.append({"block": row["block"], "own": row["own"], "n_codes": len(some), "places": len(new), "seq": packed(new), "ids": packed(ids[some])})
        return pa.Table.from_pylist(out, RELATION_SCHEMA)

    return relation.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(run, RELATION)


# --- phrases ---------------------------------------------------------------

def _named(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases of one word more, with the frequencies of what begins and what ends them."""
    left = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), "firsts")
    right = shorter.select(F.col("id").alias("right"), "last", "lasts")
    f = F.array("f")
    return found.join(left, "left").join(right, "right").select(
        "id", "left", "right", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", F.col("f").alias("a"),
        F.concat("firsts", f).alias("firsts"), F.concat("lasts", f).alias("lasts"))


def _scored(phrases: DataFrame, size: int) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut, the earliest of equal ones."""
    def whole(c: Column | int) -> Column:
        return (c if isinstance(c, Column) else F.lit(c)).cast("decimal(19,0)")

    def cut(k: int) -> Column:
        first, rest = F.col("firsts")[k - 1], F.col("lasts")[size - k - 1]
        score = F.call_function("div", whole(F.col("a")) * whole(F.col("a")) * whole(SCALE), whole(first) * whole(rest))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), first.alias("l"), rest.alias("r"))

    best = F.array_min(F.array(*[cut(k) for k in range(1, size)]))
    return phrases.withColumn("best", best).select("id", "lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(
    docs: DataFrame, least: int = 10, max_words: int = 3, share: int = 50, first: int = 2000, lang: str = "lang", text: str = "text",
    block_words: int = BLOCK_WORDS, window_bytes: int = WINDOW_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` best phrases of each language.

    A phrase of two to ``max_words`` words with a frequency of ``least`` or more
    is a candidate, unless ``share`` percent of its occurrences or more lie in one longer candidate.
    """
    rows = kept(_first_relation(docs, lang, text, max_words - 1, block_words, window_bytes), "words")
    vocabulary = rows.where("code IS NOT NULL").select("block", "code", "lang", "word", "n")
    totals = kept(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counted = kept(_frequent(vocabulary, ["lang", "word"], least), "groups")
    phrases = counted.where("block IS NULL").select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("f").alias("a"),
        F.array("f").alias("firsts"), F.array("f").alias("lasts"))
    relation, old = rows.where("seq IS NOT NULL").select("block", "own", "n_codes", "places", "seq"), rows
    levels, before = [], counted
    for k in range(1, max_words):
        relation = kept(_extended(relation, counted.where("block IS NOT NULL").select("block", "code", "id"), k - 1), "relation")
        forget(old)
        old = relation
        pairs = _pairs(relation, k)
        if k < max_words - 1:
            counted = kept(_frequent(pairs, ["left", "right"], least), "groups")
            found = counted.where("block IS NULL").select("left", "right", "f", "id")
        else:  # no relation follows, so no row goes back to a block
            found = pairs.groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
            found = found.withColumn("id", F.lit(None).cast("long"))
        phrases = kept(_named(found, phrases), "phrases")
        levels.append(phrases)
        forget(before)
        before = counted
    forget(old)
    kept_phrases = []
    for k, here in enumerate(levels):
        scored = _scored(here, k + 2)
        if k + 1 < len(levels):
            # The most frequent phrase of one word more covers all longer ones.
            longer = levels[k + 1]
            around = longer.select(F.col("left").alias("id"), "a").unionByName(longer.select(F.col("right").alias("id"), "a"))
            most = around.groupBy("id").agg(F.max("a").alias("most"))
            scored = scored.join(most, "id", "left").where(100 * F.coalesce("most", F.lit(0)) < share * F.col("a"))
        kept_phrases.append(scored.select("lang", "phrase", "a", "l", "r", "score"))
    every = reduce(DataFrame.unionByName, kept_phrases).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
    # One language may hold most phrases: the best of each part are ranked once more.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    apart = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    best = every.withColumn("rank", apart).where(F.col("rank") <= first).drop("part")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
