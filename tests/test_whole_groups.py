"""Queries without a SQL twin on whole groups, against plain programs."""

import numpy as np
import pytest
from cohera.plans import QUERIES


def test_poisson_binomial_takes_every_size(spark, tmp_path):
    sizes = {"a": range(1, 51), "b": range(3, 40, 2), "c": [7]}
    rows = [(b, int(x)) for b, xs in sizes.items() for x in (*xs, *xs)]
    spark.createDataFrame(rows, "p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_brand: (r.p0, r.p3, r.p5) for r in QUERIES["poisson_binomial"](spark, str(tmp_path)).collect()}
    assert got.keys() == sizes.keys()
    for b, xs in sizes.items():
        d = np.ones(1)
        for x in xs:
            d = np.convolve(d, [1 - x / 51, x / 51])
        assert got[b] == pytest.approx([d[k:].sum() for k in (0, 3, 5)], abs=1e-9)
