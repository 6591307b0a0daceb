"""Batches that hold fewer words than a run: every document alone in its partition."""

import corpus_pipeline as cp
import numpy as np
import pytest
from cohera.llm import jaccard, phrases, words


def alone(spark):
    rows = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 9)] + [(9, "w2x0 w2x1"), (10, "W6x0 w6x1 w6x2 w6x3 w6x4 w6x5")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    assert docs.rdd.getNumPartitions() == len(rows)
    return rows, docs


@pytest.mark.parametrize("k", range(1, 10))
def test_runs(k):
    h = words.mixed(np.arange(1, 40, dtype=np.uint64))
    whole = words.runs(h, k)
    for n in range(12):
        got = words.runs(h[:n], k)
        there = max(0, n - k + 1)
        assert len(got) == n and (got[:there] == whole[:there]).all()


def test_substrings(spark):
    rows, docs = alone(spark)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in phrases.remove_repeats(docs).collect()}
    assert got == {k: (len(t.split()), 0, t) for k, t in rows}


def test_jaccard(spark):
    rows, docs = alone(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs, 4, 85).collect()}
    assert got == {k: (max(1, len(t.split()) - 3), {9: 2, 10: 6}.get(k, k)) for k, t in rows}


def test_near_duplicates(spark):
    rows, docs = alone(spark)
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()} == set(range(1, 9))
