"""A hidden Markov language model over the words of a corpus.

The vocabulary is open and grows with the corpus; the states emit words and the
end of a text. A word that training has not seen has the share of all such words.
A state's share of a word is its expected count + 0.1 / states, over the state's
total. The first shares are those of the unigram model, with noise from a table
of ``CLASSES`` rows that a hash of the word picks; nothing learned goes by it.

Work is dealt in blocks of documents. A block's texts, as numbers of its distinct
words, are written to the shared folder once and move no more; counts are summed
over the blocks by word in one shuffle, and those of words that several blocks
have go back to the blocks as numbers.
Each Baum-Welch round reads the blocks and sends the expected counts of their
words, packed by buckets of words, to one task for each bucket, which adds them
up in the order of blocks and sends the sums back to the blocks; the counts of
words that no other block has stay with the block. Only totals by
state reach the driver: first states, moves, and the sums of emissions.

Training and scores run over whole texts. Those too long to be run through at
once are cut into segments of ``SEGMENT`` tokens: the forward pass keeps its state
at the cuts, the backward pass goes from the last segment to the first and carries
its state over. Forward and backward values are brought back to a sum of 1 after
every ``EVEN`` steps, not after each; expected counts are evened out at the end.

Defined results: a NULL or empty text is the end alone; a NULL id counts as the
empty text in ``residue``; repeated rows count repeatedly; other columns are not
read; without training text every word has the same share; an empty table gives
no row.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from harrow.llm.common import arrow_map, forget, forget_folder, kept, load_bytes, ragged, save_bytes, steps, text_bytes
from harrow.llm.words import NOT_SPACE, mix, words
from harrow.session import shared_dir

# Bits of a block's number within its task, and of a word's number within its block.
BLOCK_BITS, PLACE_BITS = 12, 31
CLASS_BITS = 16
CLASSES = 1 << CLASS_BITS
END = CLASSES
# Tokens of lanes that are run through between two cuts, at most, unless a single step has more.
SEGMENT = 1 << 18
# Steps after which values are brought back to a sum of 1. A step takes a sum down by the least
# move at most, if the emissions of each word are level; moves are smoothed, so none is near 0.
EVEN = 8
# Bytes of text in a block, and in the part of it that is taken apart at once.
BLOCK_BYTES = 12 << 20
STEP_BYTES = 3 << 20
# Tokens of the sequences that are run through together.
LANES_TOKENS = 1 << 18
# Words of all blocks in one bucket, about, and tasks of a round at most.
BUCKET_WORDS = 1 << 18
TASKS = 8192
ADDED = 0.1


# --- blocks -------------------------------------------------------------

def _squeeze(*arrays: np.ndarray) -> list[bytes]:
    return [pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True) for a in arrays]


def _open(value: bytes, size: int, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.frombuffer(pa.decompress(value, size * kind.itemsize, "zstd", asbytes=True), kind)


def _packed(*arrays: np.ndarray) -> list[tuple[str, int, bytes]]:
    return [(a.dtype.str, len(a), _squeeze(a)[0]) for a in arrays]


BLOCKS = "block long, word string, place int, n long, path string"


def blocks(docs: DataFrame, training: Column, doc_id: str, text: str, block_bytes: int, folder: str) -> DataFrame:
    """For each block a row with the path of its texts as word numbers, and a row for each distinct word."""

    def finish(block: int, held: list) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([x[0] for x in held])
        train = np.concatenate([x[1] for x in held])
        lengths = np.concatenate([np.diff(x[2].of_text) for x in held])
        hashes = np.concatenate([x[2].hashes for x in held])
        letters = np.concatenate([x[2].letters for x in held])
        base = np.cumsum([0] + [len(x[2].letters) for x in held])
        starts = np.concatenate([x[2].starts[:-1] + b for x, b in zip(held, base, strict=False)] + [base[-1:]])
        held.clear()
        spelled = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(letters))
        coded = spelled.dictionary_encode()
        del letters, starts, spelled
        tokens = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        n = len(coded.dictionary)
        first = np.zeros(n, np.int64)
        first[tokens[::-1]] = np.arange(len(tokens))[::-1]
        classes = (mix(hashes[first]) >> np.uint64(64 - CLASS_BITS)).astype(np.int32)
        counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=n)
        # An attempt of the task that comes to nothing leaves a file that no row names.
        path = f"{folder}/texts-{block}-{uuid.uuid4().hex}"
        save_bytes(path, pickle.dumps((ids.to_pylist(), _packed(train, lengths.astype(np.int32), tokens, classes))))
        yield _rows({"block": pa.array([block]), "path": pa.array([path])}, 1)
        for i in range(0, n, 1 << 16):
            m = min(n - i, 1 << 16)
            yield _rows({"block": pa.array(np.full(m, block)), "word": coded.dictionary.slice(i, m).cast(pa.string()),
                         "place": pa.array(np.arange(i, i + m, dtype=np.int32)),
                         "n": pa.array(counts[i: i + m])}, m)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << BLOCK_BITS, [], 0
        for step in steps(batches, "text", STEP_BYTES):
            data, at = text_bytes(step.column("text"))
            train = step.column("training").to_numpy().astype(bool)
            held.append((step.column("doc_id").combine_chunks(), train, words(data, at, NOT_SPACE)))
            size += len(data)
            if size >= block_bytes:
                yield from finish(block, held)
                block, size = block + 1, 0
        if held:
            yield from finish(block, held)

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), training.alias("training"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return arrow_map(rows, build, BLOCKS)


_TYPES = {"block": pa.int64(), "word": pa.string(), "place": pa.int32(), "n": pa.int64(), "path": pa.string()}


def _rows(columns: dict, n: int) -> pa.RecordBatch:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, _TYPES[c])) for c in names], names)


@dataclass
class Block:
    """A block's texts, read back."""

    doc_ids: pa.Array
    training: np.ndarray
    lengths: np.ndarray  # tokens of each text, without the end
    tokens: np.ndarray  # number of the word
    classes: np.ndarray  # of each distinct word: its row of the first noise
    counts: np.ndarray  # of each distinct word in all training texts
    words: np.ndarray  # number of each distinct word that is the same in all blocks; -1 for a word of this block alone
    shared: np.ndarray | None  # places of words that training has seen and other blocks have, by number

    @classmethod
    def of(cls, path: str, counts: np.ndarray | None, names: np.ndarray | None, shared: np.ndarray | None) -> Block:
        """The texts of a file; counts are the block's own and no word has a number if none are given."""
        ids, arrays = pickle.loads(load_bytes(path))
        training, lengths, tokens, classes = [_open(value, n, kind) for kind, n, value in arrays]
        lengths, words_ = lengths.astype(np.int64), np.full(len(classes), -1, np.int64)
        if counts is None:
            counts = np.bincount(tokens[np.repeat(training, lengths)], minlength=len(classes))
        else:
            words_[shared] = names
        return cls(pa.array(ids, pa.int64()), training, lengths, tokens, classes, counts, words_, shared)

    def numbered(self, numbers: pa.Table) -> None:
        """Take over counts and numbers of the words that other blocks have."""
        place = numbers.column("place").to_numpy()
        self.counts[place], self.words[place] = numbers.column("c").to_numpy(), numbers.column("id").to_numpy()
        some = np.flatnonzero((self.counts > 0) & (self.words >= 0))
        self.shared = some[np.argsort(self.words[some])]

    def save(self, path: str, texts: str) -> None:
        """Write what is not in the file of the texts."""
        names = np.diff(self.words[self.shared], prepend=0)
        save_bytes(path, pickle.dumps((texts, _packed(self.counts, names, self.shared))))

    @classmethod
    def load(cls, path: str) -> Block:
        texts, arrays = pickle.loads(load_bytes(path))
        counts, names, shared = [_open(value, n, kind) for kind, n, value in arrays]
        return cls.of(texts, counts, np.cumsum(names), shared)

    def observed(self, docs: np.ndarray) -> np.ndarray:
        """Numbers of the words of some texts, each text followed by the end, which has the last number."""
        begins = np.cumsum(self.lengths) - self.lengths
        lengths = self.lengths[docs]
        out = np.full(int(lengths.sum()) + len(docs), len(self.classes), np.int32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        out[inside] = self.tokens[ragged(begins[docs], lengths)]
        return out


# --- the model ----------------------------------------------------------

@dataclass
class Model:
    first: np.ndarray  # (states,) where a text begins
    again: np.ndarray  # (states,) where a sequence continues another
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (words or classes, and the end; states)
    level: np.ndarray | None = None  # log10 of what the emissions of each word have been divided by

    def levelled(self) -> Model:
        """The same model with 1 as the largest emission of each word: expected counts do not change by it."""
        largest = self.emit.max(axis=1)
        return Model(self.first, self.again, self.move, self.emit / largest[:, None], np.log10(largest) + (0 if self.level is None else self.level))


def initial(states: int, share: np.ndarray, seed: int = 7) -> Model:
    """States that stay and differ a little in their words."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(0.5 * rng.standard_normal((len(share), states)))
    even = np.full(states, 1 / states)
    stay = 0.9 if states > 1 else 1.0
    move = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(move, stay)
    return Model(even, even.copy(), move, emit / emit.sum(axis=0))


class Lanes:
    """Sequences run through together, ordered by time, the longest in the first lanes."""

    def __init__(self, observed: np.ndarray, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        begins = (np.cumsum(lengths) - lengths)[self.order]
        # active[t]: lanes that have a token at time t.
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, int(sizes[0]) + 1))
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        self.last = self.at[sizes - 1] + np.arange(len(sizes))
        self.lane = ragged(np.zeros_like(self.active), self.active)
        self.observed = observed[begins[self.lane] + np.repeat(np.arange(len(self.active)), self.active)]

    def forward(self, model: Model, start: np.ndarray, cut: tuple[int, int], alpha: np.ndarray | None) -> tuple:
        """Emissions and forward probabilities of every token between two times, and the sums that lanes were divided by."""
        low, high = cut
        at = (self.at[low: high + 1] - self.at[low]).tolist()
        emitted = model.emit.take(self.observed[self.at[low]: self.at[high]], axis=0)
        all_alpha, sums, ones = np.empty_like(emitted), [], np.ones_like(model.move)
        for t, a, b in zip(range(low, high), at, at[1:], strict=False):
            now = all_alpha[a:b]
            if alpha is None:
                now[:] = start
            else:
                np.matmul(alpha[: b - a], model.move, out=now)
            now *= emitted[a:b]
            if t % EVEN == EVEN - 1:
                total = now @ ones  # in every column, as rows are short
                now /= total
                sums.append(total[:, 0])
            alpha = now
        return emitted, all_alpha, sums

    def cuts(self) -> list[tuple[int, int]]:
        """Times between which lanes are run through at once."""
        out, low, every = [], 0, len(self.active)
        while low < every:
            high = max(low + 1, int(np.searchsorted(self.at, self.at[low] + SEGMENT, side="right")) - 1)
            out.append((low, high))
            low = high
        return out

    def entering(self, cut: tuple[int, int], all_alpha: np.ndarray) -> np.ndarray:
        """The forward probabilities of the last time before a cut's end."""
        return all_alpha[self.at[cut[1] - 1] - self.at[cut[0]]:].copy()

    def log10_likelihood(self, model: Model) -> np.ndarray:
        """Of each sequence, in the order given."""
        start, alpha = model.first, None
        total = np.zeros(len(self.order))
        if model.level is not None:
            total += np.bincount(self.lane, model.level[self.observed], len(total))
        for cut in self.cuts():
            _, all_alpha, sums = self.forward(model, start, cut, alpha)
            for x in sums:
                total[: len(x)] += np.log10(x)
            base, end = self.at[cut[0]], self.at[cut[1]]
            ended = np.flatnonzero((self.last >= base) & (self.last < end))
            total[ended] += np.log10(all_alpha[self.last[ended] - base].sum(axis=1))
            alpha = self.entering(cut, all_alpha)
        out = np.empty(len(self.order))
        out[self.order] = total
        return out

    def expected(self, model: Model, continued: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts: first states, states of continued sequences, moves, emissions."""
        later = continued[self.order]
        start = np.where(later[:, None], model.again, model.first)
        cuts, entering = self.cuts(), [None]
        for cut in cuts[:-1]:
            entering.append(self.entering(cut, self.forward(model, start, cut, entering[-1])[1]))
        moves, emits, after = np.zeros_like(model.move), np.zeros(model.emit.shape[::-1]), None
        back, ones = np.ascontiguousarray(model.move.T), np.ones_like(model.move)
        for cut, alpha in zip(cuts[::-1], entering[::-1], strict=True):
            low, high = cut
            at = self.at[low: high + 1] - self.at[low]
            weighted, alpha, _ = self.forward(model, start, cut, alpha)  # weighted becomes emission * beta
            beta, later_cut, places = np.ones_like(alpha), after, at.tolist()
            for t in range(high - 1, low - 1, -1):
                a, b = places[t - low], places[t - low + 1]
                if after is not None:
                    np.matmul(after, back, out=beta[a: a + len(after)])
                after = weighted[a:b]
                after *= beta[a:b]
                if t % EVEN == 0:
                    after /= after @ ones
            states = np.multiply(alpha, beta, out=beta)
            total = states @ ones
            states /= total
            alpha /= total
            if later_cut is not None:
                moves += alpha[at[-2]: at[-2] + len(later_cut)].T @ later_cut
            if high - low > 1:
                moves += alpha.take(ragged(at[:-2], self.active[low + 1: high]), axis=0).T @ weighted[at[1]:]
            seen = self.observed[self.at[low]: self.at[high]]
            for k in range(len(emits)):
                emits[k] += np.bincount(seen, states[:, k], emits.shape[1])
        begun = states[: self.active[0]]
        return begun[~later].sum(axis=0), begun[later].sum(axis=0), model.move * moves, emits.T


def grouped(lengths: np.ndarray, limit: int = LANES_TOKENS) -> Iterator[np.ndarray]:
    """Sequences of like length in groups of about ``limit`` tokens, longest first."""
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order])
    start = 0
    while start < len(order):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield order[start:stop]
        start = stop


def segments(lengths: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the segments of sequences, and whether each continues one."""
    n = -(-lengths // size)
    of = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(size, lengths[of] - number * size), number > 0


def block_expected(block: Block, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of a block's training texts: first states, moves, and emissions of its words and the end."""
    docs = np.flatnonzero(block.training)
    model = model.levelled()
    first, moves, emits = np.zeros_like(model.first), np.zeros_like(model.move), np.zeros(model.emit.shape[::-1])
    observed, lengths = block.observed(docs), block.lengths[docs] + 1
    begins = np.cumsum(lengths) - lengths
    for group in grouped(lengths):
        lanes = Lanes(observed[ragged(begins[group], lengths[group])], lengths[group])
        one, _, two, three = lanes.expected(model, np.zeros(len(group), bool))
        first += one
        moves += two
        emits += three.T
    return first, moves, np.ascontiguousarray(emits.T)


@dataclass
class Round:
    """What all blocks share in a round; the words' shares come with the blocks."""

    first: np.ndarray
    move: np.ndarray
    noise: np.ndarray | None  # the first round's shares of classes and end, by state
    size: np.ndarray | None  # and the counts of the classes
    total: np.ndarray | None  # later rounds: counts of each state with what is added
    end: np.ndarray | None  # and its counts of the end
    buckets: int
    folder: str  # where blocks keep the counts of the words that no other block has

    def model(self, block: Block, path: str, sums: pa.Table) -> Model:
        """The model over the words of a block, from the sums of expected counts of its words and the counts of its own words."""
        states = len(self.first)
        if self.total is None:
            emit = self.noise[block.classes] * ((block.counts + ADDED) / self.size[block.classes])[:, None]
            end = self.noise[END]
        else:
            counts = np.zeros((len(block.counts), states))
            places, of = _buckets(block, self.buckets)
            alone = _alone(block)
            if len(alone):
                counts[alone] = _open(load_bytes(f"{self.folder}/{path.rsplit('/', 1)[1]}"), len(alone) * states, np.float32).reshape(-1, states)
            for bucket, data in zip(sums.column("bucket").to_pylist(), sums.column("data").to_pylist(), strict=True):
                own = places[of[bucket]: of[bucket + 1]]
                counts[own] = _open(data, len(own) * states, np.float32).reshape(-1, states)
            emit, end = (counts + ADDED / states) / self.total, (self.end + ADDED / states) / self.total
        return Model(self.first, self.first, self.move, np.concatenate((emit, end[None])))


def _buckets(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that training has seen and other blocks have, by bucket and number, and where each bucket begins."""
    places = block.shared
    bucket = (mix(block.words[places].astype(np.uint64)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return places[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _alone(block: Block) -> np.ndarray:
    """Places of the words that training has seen in this block alone."""
    return np.flatnonzero((block.counts > 0) & (block.words < 0))


EXPECTED = "block long, bucket int, size int, words binary, data binary"
SUMS = "block long, bucket int, data binary"


# The bucket of the totals of blocks.
TOTALS = -1


def with_sums(index: DataFrame, sums: DataFrame | None) -> PandasCogroupedOps:
    """Each block's path with its sums, a task for each block as far as Spark may have so many."""
    spark = index.sparkSession
    parts = min(max(1, index.count()), TASKS)
    given = sums.where(F.col("bucket") != TOTALS) if sums is not None else spark.createDataFrame([], SUMS)
    return index.repartition(parts, "block").groupBy("block").cogroup(given.repartition(parts, "block").groupBy("block"))


def baum_welch_round(index: DataFrame, sums: DataFrame | None, now: Round, words_: int) -> tuple[DataFrame, Round]:
    """One round over all blocks: the sums of expected counts by word for each block, and what all blocks share."""
    states, buckets = len(now.first), now.buckets
    spark = index.sparkSession
    folder = shared_dir(spark, "own-words")
    shared = spark.sparkContext.broadcast(now)

    def expect(paths: pa.Table, given: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        block = Block.load(paths.column("path")[0].as_py())
        number = paths.column("block")[0].as_py()
        path = paths.column("path")[0].as_py()
        first, moves, emits = block_expected(block, shared.value.model(block, path, given))
        alone = _alone(block)
        if len(alone):
            save_bytes(f"{folder}/{path.rsplit('/', 1)[1]}", _squeeze(emits[alone].astype(np.float32))[0])
        places, of = _buckets(block, buckets)
        rows = [(number, TOTALS, None, None, np.concatenate((first, moves.ravel(), emits[:-1].sum(axis=0), emits[-1])).tobytes())]
        for k in range(buckets):
            own = places[of[k]: of[k + 1]]
            if len(own):
                names = np.diff(block.words[own], prepend=0)
                rows.append((number, k, len(own), *_squeeze(names, emits[own].astype(np.float32))))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(EXPECTED.split(", "), zip(*rows, strict=True), kinds, strict=True)})

    def add(parts: pa.Table) -> pa.Table:
        if parts.column("bucket")[0].as_py() == TOTALS:
            return parts.select(["block", "bucket", "data"])
        parts = parts.sort_by("block")
        sizes = parts.column("size").to_numpy()
        names = np.concatenate([np.cumsum(_open(v, n, np.int64)) for v, n in zip(parts.column("words").to_pylist(), sizes.tolist(), strict=True)])
        data = np.concatenate([_open(v, n * states, np.float32) for v, n in zip(parts.column("data").to_pylist(), sizes.tolist(), strict=True)]).reshape(-1, states)
        _, at = np.unique(names, return_inverse=True)
        whole = np.stack([np.bincount(at, data[:, k]) for k in range(states)], axis=1)
        whole = whole.astype(np.float32)
        back = [_squeeze(whole[x])[0] for x in np.split(at, np.cumsum(sizes)[:-1])]
        return pa.table({"block": parts.column("block"), "bucket": parts.column("bucket"), "data": pa.array(back, pa.binary())})

    found = with_sums(index, sums).applyInArrow(expect, EXPECTED)
    after = kept(found.repartition(min(buckets, TASKS) + 1, "bucket").groupBy("bucket").applyInArrow(add, SUMS), "word-sums")
    parts = after.where(F.col("bucket") == TOTALS).select("block", "data").collect()  # a short row for each block
    if sums is not None:
        forget(sums)
    if now.folder:
        forget_folder(spark, now.folder)
    # Lets Spark remove the shuffle files of rounds that are done.
    spark.sparkContext._jvm.System.gc()
    shared.destroy()
    # In the order of blocks, so that the sum is the same in every run.
    total = np.sum([np.frombuffer(r.data) for r in sorted(parts, key=lambda r: r.block)], axis=0)
    first, moves, words_total, end = np.split(total, np.cumsum([states, states * states, states]))
    # ``words_`` different words and the end were seen; all other words count as one.
    return after, Round(
        _even(first + 1 / states), np.stack([_even(x + 1 / states) for x in moves.reshape(states, states)]), None, None,
        words_total + end + ADDED / states * (words_ + 2), end, buckets, folder)


def _even(x: np.ndarray) -> np.ndarray:
    return x / x.sum()


# --- corpora ------------------------------------------------------------

def word_counts(words_: DataFrame) -> DataFrame:
    """(block, place, c, id, first) of each word of each block that other blocks have too: how often the corpus has it, its number, and where it is first."""
    by_word = Window.partitionBy("word")
    spot = F.shiftleft("block", PLACE_BITS).bitwiseOR(F.col("place").cast("long"))
    least = F.min(spot).over(by_word)
    return words_.select(
        "block", "place", F.sum("n").over(by_word).alias("c"), least.alias("id"), (least == spot).alias("first"), F.count("*").over(by_word).alias("many"),
    ).where("many > 1").drop("many")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_documents(
    docs: DataFrame, training: Column, states: int = 4, rounds: int = 5, doc_id: str = "doc_id", text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``base_score`` is the add-0.1 unigram model, ``score`` the hidden Markov
    model; both are log10 probabilities of the words and the end.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "blocks")
    taken = kept(blocks(docs, training, doc_id, text, block_bytes, folder), "word-blocks")
    corpus = kept(taken.where("word is null").select("block", "path"), "block-texts")
    counts = kept(word_counts(taken.where("word is not null").select("block", "word", "place", "n")), "word-counts")
    forget(taken)
    # Lets Spark remove the shuffle files of the words.
    spark.sparkContext._jvm.System.gc()

    def prepare(texts: pa.Table, numbers: pa.Table) -> pa.Table:
        """Write a block with its counts; its path, and the counts of words by class that it is the first to have."""
        pa.set_memory_pool(pa.system_memory_pool())
        given, number = texts.column("path")[0].as_py(), texts.column("block")[0].as_py()
        block, path = Block.of(given, None, None, None), f"{folder}/block-{number}"
        block.numbered(numbers)
        block.save(path, given)
        own = np.ones(len(block.words), bool)
        own[numbers.column("place").to_numpy()] = numbers.column("first").to_numpy(zero_copy_only=False)
        own &= block.counts > 0
        tokens = np.bincount(block.classes[own], block.counts[own], CLASSES).astype(np.int64)
        many = np.bincount(block.classes[own], minlength=CLASSES)
        some = np.flatnonzero(many)
        return pa.table({"block": [number], "path": [path], "seen": pa.array([len(block.shared)]), "class": pa.array([some.tolist()], pa.list_(pa.int64())),
                         "n": pa.array([tokens[some].tolist()], pa.list_(pa.int64())), "v": pa.array([many[some].tolist()], pa.list_(pa.int64()))})

    index = kept(corpus.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        prepare, "block long, path string, seen long, class array<long>, n array<long>, v array<long>"), "block-index")
    # The size of each class of the first noise: a table of one row for each class.
    per_class = index.select(F.explode(F.arrays_zip("class", "n", "v")).alias("x")).groupBy("x.class").agg(F.sum("x.n").alias("n"), F.sum("x.v").alias("v")).collect()
    tokens, different = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in per_class:
        tokens[r[0]], different[r[0]] = r[1], r[2]
    seen = index.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    n_docs = docs.select(F.count_if(training)).first()[0]
    words_ = int(different.sum())
    tokens[END], different[END] = n_docs, n_docs > 0
    n, v = int(tokens.sum()), int(different.sum())
    size = tokens + ADDED * (different + 1)

    begun = initial(states, size / size.sum())
    now, sums = Round(begun.first, begun.move, begun.emit, size, None, None, int(seen // BUCKET_WORDS) + 1, ""), None
    index = index.select("block", "path")
    forget(counts)
    spark.sparkContext._jvm.System.gc()
    for _ in range(rounds if n_docs else 0):
        sums, now = baum_welch_round(index, sums, now, words_)
    shared = spark.sparkContext.broadcast(now)
    unit = n + ADDED * (v + 1)
    end_base = np.log10((n_docs + ADDED) / unit)

    def score(paths: pa.Table, given: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        block = Block.load(paths.column("path")[0].as_py())
        own, c = shared.value.model(block, paths.column("path")[0].as_py(), given), block.counts
        of = np.repeat(np.arange(len(block.lengths)), block.lengths)
        total = lambda values: np.bincount(of, values[block.tokens], len(block.lengths))
        own, paths_ = own.levelled(), np.empty(len(block.lengths))
        for group in grouped(block.lengths + 1):
            paths_[group] = Lanes(block.observed(group), block.lengths[group] + 1).log10_likelihood(own)
        known = total((c > 0).astype(np.float64)).astype(np.int64) + (n_docs > 0)
        return pa.table({
            "doc_id": block.doc_ids, "held_out": pa.array(~block.training), "n_tokens": pa.array(block.lengths + 1),
            "n_known": pa.array(known), "base_score": pa.array(total(np.log10(c + ADDED) - np.log10(unit)) + end_base), "score": pa.array(paths_),
        })

    scored = with_sums(index, sums).applyInArrow(score, RESULT)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
