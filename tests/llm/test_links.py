"""All links of the Jaccard join against a comparison of all pairs."""

import itertools
from collections import Counter

import numpy as np
import pytest
from data import AWKWARD, FOLDER, awkward, empty, given, rows
from test_text import check_components, family, grouped, shingles

from harrow.llm import jaccard_join, queries


def all_links(docs, share=75):
    """Links of different sets as pairs of their smallest ids, and the number of links of each (id, set)."""
    ids = {}
    for d, t in docs:
        if d is not None and (s := shingles(t)):
            ids.setdefault(s, set()).add(d)
    pairs, number = [], Counter({s: len(x) - 1 for s, x in ids.items()})
    for x, y in itertools.combinations(ids, 2):
        if 100 * len(x & y) >= share * len(x | y):
            pairs.append(tuple(sorted((min(ids[x]), min(ids[y])))))
            number[x] += len(ids[y])
            number[y] += len(ids[x])
    return sorted(pairs), number


def check_links(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    pairs, number = all_links(docs)
    assert sorted((r.a, r.b) for r in jaccard_join.link_pairs(df).collect()) == pairs
    want = grouped(docs)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.counted_links(df).collect()]
    assert sorted(got, key=repr) == sorted(
        ((d, len(s := shingles(t)), want.get(d), number[s] if d is not None else 0) for d, t in docs), key=repr)
    return pairs


@pytest.mark.parametrize("chunks", [1, 32])
def test_links_inside_a_component(spark, monkeypatch, chunks):
    """More near copies than a region compares at once, of sizes that vary, and exact copies among them."""
    monkeypatch.setattr(jaccard_join, "CHUNKS", chunks)
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 100)
    rng = np.random.default_rng(8)
    docs = family(rng, 70, 100, 2)
    docs += [(200 + i, " ".join(docs[0][1].split()[: 100 - i])) for i in range(60)]
    docs += [(1000 + d, t.upper()) for d, t in docs[::9]] + family(rng, 5, 50, 1, base=3000)
    docs += [(None, docs[0][1]), (5000, ""), (5001, None)]
    assert len(check_links(spark, docs)) > 1000


def test_links_of_awkward_rows(spark):
    got = rows(jaccard_join.counted_links(awkward(spark)))
    assert len(got) == len(AWKWARD)
    _, number = all_links([(d, t) for d, t, *_ in AWKWARD])
    assert sorted(n for d, _, _, n in got if d is not None) == sorted(number[shingles(t)] for d, t, *_ in AWKWARD if d is not None)
    assert rows(jaccard_join.counted_links(empty(spark))) == [] == rows(jaccard_join.link_pairs(empty(spark)))


def test_links_query(spark):
    docs = [(d, t) for d, t, *_ in given("documents")]
    _, number = all_links(docs)
    assert {r.doc_id: r.n_links for r in queries.op2_jaccard_links(spark, FOLDER).collect()} == {d: number[shingles(t)] for d, t in docs}


def test_repeated_rows_do_not_cancel(spark, monkeypatch):
    """The same part twice, in other tasks: regions keep the names of their documents."""
    rng = np.random.default_rng(9)
    docs = family(rng, 50, 90, 0, own=40) + family(rng, 30, 150, 4, base=1000) + family(rng, 20, 60, 1, base=2000)
    table = lambda times: spark.createDataFrame(spark.sparkContext.parallelize(times * docs, times), "doc_id long, text string")
    once, twice = table(1), table(2)
    none = np.zeros(0, np.uint64)
    names = lambda df: sorted((r.r1, r.r2, r.size, r.doc_id, r.pivot) for r in jaccard_join.regions(df, none, 5, 75).collect())
    want = names(once)
    assert len({x[:2] for x in want}) > 3
    assert names(twice) == want
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    found = [tuple(r) for r in jaccard_join.near_duplicates(twice).collect()]
    components = grouped(docs)
    assert sorted(found) == sorted(2 * [(d, len(shingles(t)), components[d]) for d, t in docs])


def test_texts_that_share_an_id_in_large_regions(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    rng = np.random.default_rng(10)
    docs = family(rng, 40, 90, 0, own=40) + family(rng, 40, 90, 5, base=1000)
    # Ids of the first group also have a text of the second, and some have another of the first.
    docs += [(i, docs[40 + 3 * i][1]) for i in range(0, 12, 2)] + [(i, docs[i + 9][1] + " end") for i in range(5)]
    check_components(spark, docs)
    check_components(spark, docs[::-1] + docs[:60])
