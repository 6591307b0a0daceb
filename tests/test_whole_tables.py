"""Operators that sum over rows in Spark against the plain programs that took a whole group at once."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from cohera.operators import compartments, resampling


def most_rows(monkeypatch):
    """Fails when Python is handed groups of samples."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    real = PandasGroupedOpsMixin.applyInPandas

    def held(self, f, schema):
        def small(p):
            assert len(p) <= 16, "a group of samples came to one task"
            return f(p)

        return real(self, small, schema)

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", held)


@pytest.mark.parametrize("by", [[], ["y"]])
def test_draws_number_rows_by_ranges(spark, by):
    keys = np.random.default_rng(5).permutation(2000)[:700].tolist()
    df = spark.createDataFrame([(k, k % 2) for k in keys], "id int, y int").repartition(5)
    drawn = resampling.draws(df, "id", 3, by)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_part" in plan
    want = Counter()
    for y in (0, 1) if by else (None,):
        rows = sorted(k for k in keys if y is None or k % 2 == y)
        for r in range(3):
            for i in range(len(rows)):
                text = "|".join(["0", str(r), str(i), *([str(y)] if by else [])])
                want[rows[int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % len(rows)], r] += 1
    assert {(x.id, x.replicate): x.times for x in drawn.collect()} == want


def test_component_from_sums(spark, monkeypatch):
    most_rows(monkeypatch)
    rng = np.random.default_rng(6)
    z = rng.normal(size=90)
    x = z[:, None] * np.array([1.0, 2.0, -0.5, 1.5]) + rng.normal(size=(90, 4)) + 9
    x[rng.random((90, 4)) < 0.1] = np.nan
    df = spark.createDataFrame([(s, f, None if np.isnan(x[s, f]) else float(x[s, f])) for s in range(90) for f in range(4)], "s int, f int, v double")
    markers = spark.createDataFrame([(f, "n") for f in range(4)], "f int, kind string")
    got = {r.s: r.score for r in compartments.first_component(df, "s", "f", "v", markers, "kind").collect()}
    there = ~np.isnan(x).all(axis=1)
    c = np.where(np.isnan(x), np.nanmean(x, axis=0), x)[there]
    c = c - c.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    pc = u[:, 0] * np.sign(u[:, 0] @ c.mean(axis=1)) * s[0]
    assert got == {int(k): pytest.approx(v, abs=1e-8) for k, v in zip(np.flatnonzero(there), pc / pc.std())}


def test_residuals_from_sums(spark, monkeypatch):
    most_rows(monkeypatch)
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=80) + 50, rng.normal(size=80)
    y = np.column_stack([3 * a - b + rng.normal(size=80), rng.normal(size=80) + 4])
    rows = [(s, f, float(y[s, f])) for s in range(80) for f in range(2)] + [(s, 2, float(s) if s % 2 else None) for s in range(6)] + [(9, None, 1.0)]
    cov = spark.createDataFrame([(s, float(a[s]), float(b[s])) for s in range(80)], "s int, a double, b double")
    df = spark.createDataFrame(rows, "s int, f int, v double")
    got = {(r.s, r.f): r.residual for r in compartments.residualise(df, "s", "f", "v", cov, ["a", "b"], df.where("s % 2 = 0")).collect()}
    assert len(got) == len(rows)
    x, use = np.column_stack([np.ones(80), a, b]), np.arange(80) % 2 == 0
    for f in range(2):
        beta = np.linalg.lstsq(x[use], y[use, f], rcond=None)[0]
        want = y[:, f] - x @ beta + y[use, f].mean()
        assert [got[s, f] for s in range(80)] == pytest.approx(want, abs=1e-8)
    assert [got[s, 2] for s in range(6)] == [None, 1.0, None, 3.0, None, 5.0]
    assert got[9, None] == 1.0
