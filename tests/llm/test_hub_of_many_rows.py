"""More rows to one hub than a block holds, and near misses beside them."""

import random

import numpy as np
import pytest
from cohera.llm import jaccard


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)}


def test_signatures_bound_overlaps():
    r = np.random.default_rng(2)
    for n, m, common in [(1, 1, 1), (1, 1, 0), (300, 5000, 200), (5000, 300, 0), (9000, 8000, 7900), (700, 700, 700)]:
        grams = np.unique(r.integers(0, 2**63, n + m, dtype=np.uint64))[: n + m - common]
        r.shuffle(grams)
        x, y = grams[:n], grams[n - common :]
        bound = jaccard.most_shared(jaccard.signature(x), jaccard.signature(y), n, m)
        assert common <= bound <= min(n, m)
    assert jaccard.most_shared(jaccard.signature(x), jaccard.signature(x), len(x), len(x)) == len(x)
    x, y = (np.unique(r.integers(0, 2**63, 4000, dtype=np.uint64)) for _ in range(2))
    assert jaccard.most_shared(jaccard.signature(x), jaccard.signature(y), 4000, 4000) < 2400  # a signature of fixed size would be full


@pytest.mark.parametrize("most_asked", [jaccard.MOST_ASKED, 0])
def test_many_near_copies_of_one_text(spark, most_asked):
    r = random.Random(1)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(base)]
    for k in range(1300):
        w = list(base)
        w[r.randrange(80)] = f"own{k}"  # at most 4 of 77 shingles change
        texts.append(" ".join(w))
    misses = []
    for k in range(40):  # a quarter of the words is their own, so 85 of 100 is out of reach
        w = list(base)
        w[40:60] = [f"miss{k}x{i}" for i in range(20)]
        misses.append(" ".join(w))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*misses, *texts])], "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_join(docs, 4, 85, most_asked=most_asked).collect()}
    assert got == {k: (len(shingles(t)), k if k < len(misses) else len(misses)) for k, t in enumerate([*misses, *texts])}
