"""Baum-Welch over words in blocks against a plain loop over whole texts."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from harrow.llm import hmm
from harrow.llm.words import NOT_SPACE, mix, words


def class_of(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(mix(words(data, np.array([0, len(data)]), NOT_SPACE).hashes[:1])[0] >> np.uint64(64 - hmm.CLASS_BITS))


def same_class():
    """Two words with the same hash class."""
    known = {}
    for i in range(5000):
        if (c := class_of(f"w{i}")) in known:
            return known[c], f"w{i}"
        known[c] = f"w{i}"


def forward(model, o):
    alpha, scale = np.empty((len(o), len(model.first))), np.empty(len(o))
    for t, x in enumerate(o):
        now = (alpha[t - 1] @ model.move if t else model.first) * model.emit[x]
        scale[t] = now.sum()
        alpha[t] = now / scale[t]
    return alpha, scale


def plain_scores(docs, states, rounds):
    """log10 probability of each text under the model learned from those with an odd id."""
    train = [(*t.split(), None) for d, t in docs if d % 2]
    counts = Counter(w for t in train for w in t if w)
    names = {w: i for i, w in enumerate(counts)} | {None: len(counts)}
    classes = np.array([class_of(w) for w in counts])
    size = np.zeros(hmm.CLASSES + 1)
    for w, c in zip(counts, classes, strict=True):
        size[c] += counts[w] + 0.1
    size[-1] = len(train) + 0.1
    size += 0.1
    model = hmm.initial(states, size / size.sum())
    shares = np.array([counts[w] + 0.1 for w in counts]) / size[classes]
    model.emit = np.concatenate((model.emit[classes] * shares[:, None], model.emit[-1:], np.zeros((1, states))))
    for _ in range(rounds):
        first, moves, emits = np.full(states, 1 / states), np.full((states, states), 1 / states), np.zeros_like(model.emit)
        for t in train:
            o = [names[w] for w in t]
            alpha, scale = forward(model, o)
            beta = np.ones(states)
            for k in range(len(o) - 1, -1, -1):
                own = alpha[k] * beta / (alpha[k] * beta).sum()
                emits[o[k]] += own
                after = model.emit[o[k]] * beta / scale[k]
                if k:
                    moves += model.move * np.outer(alpha[k - 1], after)
                beta = model.move @ after
            first += own
        emits += 0.1 / states
        model.first, model.emit = first / first.sum(), emits / emits.sum(axis=0)
        model.move = moves / moves.sum(axis=1, keepdims=True)
    return {d: np.log10(forward(model, [names.get(w, len(names)) for w in [*t.split(), None]])[1]).sum() for d, t in docs}


def test_states_emit_words(spark):
    one, two = same_class()
    rng = np.random.default_rng(4)
    docs = []
    for d in range(40):
        # Each of the two words keeps company of its own.
        own, word = (["a", "b", one], ["c", "d", two])[d // 2 % 2], [f"r{d}", "e"]
        docs.append((d, " ".join(rng.choice(own + word, 60 if d else 2600))))
    docs[1] = (1, " ".join(rng.choice(["a", "b", one, "c"], 2600)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = hmm.score_documents(df, F.col("doc_id") % 2 == 1, states=3, rounds=3, block_bytes=1000)
    want = plain_scores(docs, 3, 3)
    for r in got.collect():
        assert np.isclose(r.score, want[r.doc_id], rtol=1e-7), r


def test_texts_and_words_of_one_block_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b only"), (2, "b a other")], "doc_id long, text string").repartitionByRange(2, "doc_id")
    taken = hmm.blocks(docs, F.lit(True), "doc_id", "text", 1, str(tmp_path)).localCheckpoint()
    assert set(taken.columns) == {"block", "word", "place", "n", "path"}
    words_ = taken.where("word is not null").select("block", "word", "place", "n")
    found = hmm.word_counts(words_).join(words_, ["block", "place"]).collect()
    assert sorted((r.word, r.c) for r in found) == [("a", 2), ("a", 2), ("b", 3), ("b", 3)]
    assert sum(r["first"] for r in found) == 2


def test_segments_carry_over(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 17, 8, 9])
    model = hmm.initial(3, np.ones(10) / 10)
    model.move, model.emit = rng.dirichlet(np.ones(3), 3), rng.random((10, 3))
    lanes = hmm.Lanes(rng.integers(0, 10, lengths.sum()).astype(np.int32), lengths)
    whole = [*lanes.expected(model, np.zeros(5, bool)), lanes.log10_likelihood(model)]
    assert np.isclose(whole[2].sum(), (lengths - 1).sum()) and np.isclose(whole[3].sum(), lengths.sum())
    for size in (1, 2, 4, 8):
        monkeypatch.setattr(hmm, "SEGMENT", size)
        for x, y in zip(whole, [*lanes.expected(model, np.zeros(5, bool)), lanes.log10_likelihood(model)], strict=True):
            assert np.allclose(x, y)


def test_texts_of_a_group_run_forward_once(monkeypatch):
    rng = np.random.default_rng(2)
    lengths = np.array([2600, 2100, 1030, 7])
    model = hmm.initial(3, np.ones(10) / 10)
    lanes, runs, forward_ = hmm.Lanes(rng.integers(0, 10, lengths.sum()).astype(np.int32), lengths), [], hmm.Lanes.forward
    monkeypatch.setattr(hmm.Lanes, "forward", lambda *x: runs.append(x) or forward_(*x))
    lanes.expected(model, np.zeros(4, bool))
    assert len(runs) == 1
    lanes.log10_likelihood(model)
    assert len(runs) == 2


def test_values_between_even_steps_stay_in_range():
    rng = np.random.default_rng(3)
    lengths, least = np.array([400, 37, 1]), 1e-13
    model = hmm.initial(2, np.ones(6) / 6)
    # The states hardly ever change, and each word all but belongs to the other state than the word before.
    model.move = np.array([[1 - least, least], [least, 1 - least]])
    model.emit = np.array([[1e-3, 1e-14], [1e-14, 1e-9]] * 3)
    seen = np.concatenate([np.arange(n) % 6 for n in lengths]).astype(np.int32)
    lanes, at = hmm.Lanes(seen, lengths), np.cumsum([0, *lengths])
    want = [np.log10(forward(model, seen[a:b])[1]).sum() for a, b in zip(at, at[1:], strict=False)]
    assert np.allclose(lanes.log10_likelihood(model.levelled()), want, rtol=1e-12)
    found = lanes.expected(model.levelled(), np.zeros(3, bool))
    assert np.isclose(found[2].sum(), (lengths - 1).sum()) and np.isclose(found[3].sum(), lengths.sum())
    assert np.allclose(found[3].sum(axis=1), np.bincount(seen, minlength=6))
