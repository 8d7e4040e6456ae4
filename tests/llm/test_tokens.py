"""Token counts, id blocks and packing against plain loops over the tokenizer."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from data import AWKWARD, FOLDER, awkward, empty, given, rows
from hypothesis import given as forall
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harrow.llm import packing, queries, token_blocks, token_counts
from harrow.llm.encoding import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@forall(st.lists(st.text(alphabet=st.sampled_from(list("ab'sé .,!?<|>\n\t 　\u0085 \x1c日Ǡ\U0001f60012")), max_size=40), max_size=5))
def test_parts_give_the_ids_of_the_whole(texts):
    texts = [*texts, "a<|endoftext|>b <|endoftext|>", None]
    ids, at = ENCODER.encode(pa.array(texts, pa.string()))
    assert [list(ids[a:b]) for a, b in zip(at, at[1:])] == [ids_of(t) for t in texts]
    assert list(ENCODER.lengths(pa.array(texts, pa.string()))) == list(np.diff(at))


ENCODER = Encoder(PATH)


def counted(table):
    return sorted(((d, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 512) for d, t, *_ in table), key=repr)


def test_counts(spark):
    assert rows(queries.op10_token_counts(spark, FOLDER)) == counted(given("documents"))


@pytest.mark.parametrize("step", [1, 3000, 1 << 24])
def test_counts_of_awkward_rows(spark, step):
    got = token_counts.token_counts(awkward(spark), PATH, step_bytes=step)
    assert rows(got) == counted(AWKWARD)
    assert rows(token_counts.token_counts(empty(spark), PATH)) == []


def test_counts_with_a_sentencepiece_model(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(awkward(spark), path)
    assert sorted((r.n_tokens for r in got.collect())) == sorted(len(model.encode(t or "")) for _, t, *_ in AWKWARD)


@settings(max_examples=60, deadline=None)
@forall(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.integers(0, 2**32 - 1))
def test_block_round_trip(values, fill):
    ids = np.array(values + [fill] * 700, np.uint32)
    file = token_blocks.BlockFile(token_blocks.file_bytes(ids, pa.array([None, 4], pa.int64()), np.array([0, len(ids)])))
    assert np.array_equal(file.ids(), ids)
    assert np.array_equal(file.ids(600, 1100), ids[600:1100])
    assert file.doc_ids.to_pylist() == [None, 4]


def test_blocks_store_outliers_apart():
    ids = np.full(1024, 1000, np.uint32) + np.arange(1024, dtype=np.uint32) % 8
    ids[[5, 700]] = 2**31
    payload, index = token_blocks.encode_blocks(ids)
    assert (index["width"][0], index["exceptions"][0], index["minimum"][0]) == (3, 2, 1000)
    assert len(payload[0]) == 3 * 128 + 2 * 6


def test_id_blocks(spark):
    want, start = [], 0
    for d, t, *_ in sorted(given("documents")):
        ids = [*ids_of(t), 0]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows(queries.op6_token_blocks(spark, FOLDER)) == sorted(want, key=repr)


def test_id_blocks_of_awkward_rows(spark):
    docs = awkward(spark).repartition(3)
    manifest = token_blocks.write_blocks(docs, PATH, step_bytes=4000)
    got = token_blocks.read_blocks(manifest, with_ids=True).orderBy("start").collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == sorted(((d, [*ids_of(t), 0]) for d, t, *_ in AWKWARD), key=repr)
    assert [r.doc_id or 0 for r in got] == sorted(d or 0 for d, *_ in AWKWARD)
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got[:-1]]]))
    assert all(r.ids_crc32 == crc(r.ids) for r in got)
    assert rows(token_blocks.read_blocks(token_blocks.write_blocks(empty(spark), PATH))) == []


def check_packing(packed, table, capacity, end_id):
    """Every document is there whole, in pieces, and every sequence is gapless."""
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    want = {}
    for d, t, *_ in table:
        ids = [*ids_of(t), end_id]
        n = -(-len(ids) // capacity)
        first = len(ids) - (n - 1) * capacity
        starts = [0, *range(first, len(ids), capacity)] if n > 1 else [0]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.setdefault(d, []).append((k, a, b - a, crc(ids[a:b])))
    assert {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) for d, own in by_doc.items()} == {d: sorted(x) for d, x in want.items()}
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in packed)


@pytest.mark.parametrize("parts", [1, 7, 70])
def test_packing(spark, parts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(parts)
    packed = packing.pack_documents(docs, PATH, fan_in=4).collect()
    n, tokens = check_packing(packed, given("documents"), 1024, 2)
    lengths = [r.length for r in packed]
    whole = len(packing.best_fit(np.array(lengths), 1024)[2])
    assert n >= -(-tokens // 1024)
    # Bins are not opened again on the way up; here a partition has a few dozen pieces only.
    assert n <= 1.05 * whole + 1


def test_pieces_of_any_two_tasks_meet(spark):
    # One task has only pieces that fill a bin to three fifths, the other only what fits on top of them.
    table = [(i, "a " * (38 if i < 400 else 24)) for i in range(800)]
    docs = spark.range(0, 800, numPartitions=2).selectExpr("id AS doc_id", "repeat('a ', if(id < 400, 38, 24)) AS text")
    lengths = [len(ids_of(t)) + 1 for _, t in table]
    assert lengths[0] * 2 > 70 >= lengths[0] + lengths[-1]
    n, _ = check_packing(packing.pack_documents(docs, PATH, capacity=70).collect(), table, 70, 2)
    assert n == 400


@settings(max_examples=100, deadline=None)
@forall(st.lists(st.integers(1, 50), max_size=300))
def test_runs_are_the_bins_of_best_fit(sizes):
    counts = Counter(sizes)
    filled = {}
    for length, first, last, to_bin, per_bin, room in packing.best_fit_runs(counts, 50):
        counts[length] -= last - first + 1
        for k in range(last - first + 1):
            at = 50 - room + k % per_bin * length
            assert at == filled.get(to_bin + k // per_bin, 0)
            filled[to_bin + k // per_bin] = at + length
    assert not any(counts.values())
    assert sorted(filled.values()) == sorted(packing.best_fit(np.array(sizes, np.int64), 50)[2])


def test_packing_query(spark):
    check_packing(queries.op4_best_fit_packing(spark, FOLDER).collect(), given("documents"), 1024, 2)


def test_packing_of_awkward_rows(spark):
    packed = packing.pack_documents(awkward(spark), PATH, capacity=64, with_ids=True, step_bytes=1000)
    check_packing(packed.collect(), AWKWARD, 64, 2)
    whole = packing.sequences(packed).collect()
    assert sum(r.n_tokens for r in whole) == sum(len(ids_of(t)) + 1 for _, t, *_ in AWKWARD)
    assert all(len(r.ids) == r.n_tokens <= 64 for r in whole)
    assert rows(packing.pack_documents(empty(spark), PATH)) == []


@settings(max_examples=100, deadline=None)
@forall(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_keeps_one_bin_half_empty_at_most(sizes):
    bins, places, fills = packing.best_fit(np.array(sizes, np.int64), 50)
    assert np.array_equal(np.bincount(bins, sizes, len(fills)), fills) and (fills <= 50).all()
    assert (fills <= 25).sum() <= 1
    for b in range(len(fills)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(places[own])]
        assert list(places[own]) == list(np.cumsum([0, *np.array(sizes)[own][:-1]]))
