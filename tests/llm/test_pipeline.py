"""The whole pipeline against plain loops over its stages."""

import corpus_pipeline
import pytest
from data import AWKWARD, CLASHING, DOCS, FOLDER, given, rows
from pyspark.sql import functions as F
from test_text import SECRETS, grouped, passages, shingles
from test_tokens import check_packing

from harrow.llm import secret_scan

import re


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The given documents with awkward rows, benchmark passages, copies and secrets among them."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs, bench = given("documents"), given("benchmark")
    texts = {d: t for d, t, *_ in docs}
    more = [(1000 + d if d is not None else None, *rest) for d, *rest in AWKWARD]
    more += [(2000 + i, f"before {t} after", "en", "x", 1) for i, t in bench[:6]]
    more += [(3000 + d, t, "en", "x", 1) for d, t in list(texts.items())[:9]]
    more += [(4000 + i, f"plain words number {i} " * 3 + t, "en", "x", 1) for i, t in enumerate(SECRETS)]
    table = docs + more
    spark.createDataFrame(table, DOCS).withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, table, bench


def expected(spark, table, bench):
    """What each stage keeps, as (id, text)."""
    kept = [(d, t) for d, t, *_ in table if any(c.isalpha() for c in t or "")]
    yield kept
    groups = grouped(kept)
    hashes = dict(spark.createDataFrame([(t,) for t in {t for _, t in kept}], "t string").select("t", F.xxhash64("t")).collect())
    firsts = {}
    for d, t in kept:
        if d is not None and groups[d] == d and (d not in firsts or hashes[t] < hashes[firsts[d]]):
            firsts[d] = t
    kept = [(d, t) for d, t in kept if d is None] + list(firsts.items())
    yield kept
    hit = {(d, n): h for (d, _), (d2, n, h, _) in ((x, passages([x], bench)[0]) for x in kept)}
    kept = [(d, t) for d, t in kept if not ((f := passages([(d, t)], bench)[0])[2] > 0 and 20 * f[2] >= f[1])]
    assert hit
    yield kept
    clean = []
    for d, t in kept:
        spans = sorted((m.start(), m.end()) for r in secret_scan.RULES for m in re.finditer(r.pattern, t, re.A) if len(m[r.group]) >= r.least)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        clean.append((d, out + t[at:]))
    yield clean


def test_stages(spark, folder):
    path, table, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected(spark, table, bench), strict=False):
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        out = f"{path}/after-{name}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted(want, key=repr), name
    changed = {r.doc_id: r for r in docs.collect()}
    assert changed[4001].n_chars == len(changed[4001].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    check_packing(packed, want, 1024, 2)


def test_run(spark, folder):
    path, table, bench = folder
    *_, want = expected(spark, table, bench)
    n, _ = check_packing(corpus_pipeline.run(spark, path).collect(), want, 1024, 2)
    assert n > 0 and len(want) > 150 and all(shingles(t) for _, t in want)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == []
