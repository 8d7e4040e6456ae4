"""The language stage of the pipeline on a table without labels."""

import corpus_pipeline
from data import AWKWARD, awkward
from pyspark.sql import functions as F


def test_documents_without_labels_stay(spark):
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    want = [(d, t) for d, t, *_ in AWKWARD if any(c.isalpha() for c in t or "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr) != []
