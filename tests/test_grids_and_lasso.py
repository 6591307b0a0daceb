"""Fits of a grid and lasso paths against plain programs."""

import numpy as np
import pytest
from cohera.operators import grids, lasso
from pyspark.sql import functions as F

R = np.random.default_rng(11)


def plain_logistic(x, y, c):
    """Gradient-free check: Newton on plain arrays, to the end."""
    z = np.column_stack([np.ones(len(x)), x])
    b, shrink = np.zeros(z.shape[1]), np.array([0] + [1 / c] * x.shape[1])
    for _ in range(200):
        e = 1 / (1 + np.exp(-z @ b))
        step = np.linalg.solve((z * (e * (1 - e))[:, None]).T @ z + np.diag(shrink + 1e-12), z.T @ (y - e) - shrink * b)
        b = b + step * min(1, 1 / np.abs(step).max())
    return b


def area(s, y):
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))


def table(n=240, p=5):
    x = R.normal(size=(n, p)) * [1, 10, 0.1, 3, 1] + [0, 100, 5, 0, -2]
    y = (x[:, 0] + 0.2 * (x[:, 1] - 100) + R.normal(size=n) > 0).astype(float)
    return x, y, R.integers(0, 4, n)


def frame(spark, x, y, fold):
    rows = [(k, None if y[k] is None else float(y[k]), int(fold[k]), *map(float, x[k]), "clash") for k in range(len(x))]
    return spark.createDataFrame(rows, "id long, y double, fold int, " + ", ".join(f"f{j} double" for j in range(x.shape[1])) + ", score string")


def test_search_over_c_equals_plain_program(spark):
    x, y, fold = table()
    cs = [1e-3, 1e-2, 0.1, 1.0, 100.0]
    found, model = grids.search_c(grids.Grid(frame(spark, x, y, fold), "id", "y", [f"f{j}" for j in range(5)], ["fold"]), [0, 1, 2, 3], cs)
    got = {r.c: (r.auc, r.converged, r.chosen) for r in found.collect()}
    want = {}
    for c in cs:
        a = []
        for f in range(4):
            tr = fold != f
            m, s = x[tr].mean(axis=0), x[tr].std(axis=0)
            b = plain_logistic((x[tr] - m) / s, y[tr], c)
            a.append(area(b[0] + ((x[~tr] - m) / s) @ b[1:], y[~tr]))
        want[c] = np.mean(a)
    assert all(abs(got[c][0] - want[c]) < 1e-9 and got[c][1] for c in cs)
    best = max(cs, key=lambda c: (round(want[c], 12), -c))
    assert [c for c in cs if got[c][2]] == [best]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose(model.beta, plain_logistic(z, y, best), atol=1e-6)


def test_fits_of_nulls_one_class_and_steep_data(spark):
    x, y, fold = table(120)
    steep = (x[:, 0] > 0).astype(float)  # separable
    g = grids.Grid(frame(spark, x, steep, fold), "id", "y", [f"f{j}" for j in range(5)], ["fold"])
    m = g.fitted([grids.Fit((), 1e6, (0,))])[0]
    assert m.converged and m.beta[1] > 5 and not m.beta[2:].any()
    with pytest.raises(ValueError, match="not converged"):
        g.fitted([grids.Fit((), 1e6)], steps=2)
    one = grids.Grid(frame(spark, x, np.ones(120), fold), "id", "y", ["f0"], ["fold"])
    fits = [grids.Fit(((0, 1),), test=(0, 1))]
    assert {r.score for r in one.scores(fits, one.fitted(fits)).collect()} == {1.0}
    holes = x.copy()
    holes[::3, 0] = np.nan
    labels = [None if k % 10 == 0 else v for k, v in enumerate(y)]
    g = grids.Grid(frame(spark, holes, labels, fold), "id", "y", ["f0", "f1"], ["fold"])
    m = g.fitted([grids.Fit()])[0]
    keep = np.array([v is not None for v in labels])
    a = holes[keep][:, :2]
    mean = np.nanmean(a, axis=0)
    a = np.where(np.isnan(a), mean, a)
    assert np.allclose(m.beta[:3], plain_logistic((a - mean) / a.std(axis=0), y[keep], 1.0), atol=1e-6)
    assert g.scores([grids.Fit()], [m]).count() == 120  # rows without a label are scored


def test_seed_ensemble_equals_a_plain_loop(spark):
    x, y, fold = table(160)
    names = [f"f{j}" for j in range(5)]
    df = frame(spark, x, y, fold)
    got = {r.id: r.score for r in grids.seed_ensemble(df, "id", "y", names, "fold", [0, 1, 2, 3], [3, 4, 5], 2.0, 0.5, 100).collect()}
    parts = {s: [r[0] for r in grids.with_seed_levels(df, "id", [s])[0].orderBy("id").select(f"_seed{s}").collect()] for s in (3, 4, 5)}
    want = np.zeros(len(x))
    for s in (3, 4, 5):
        use = list(grids.subset_of(names, 2, s))
        assert len(use) == 2
        for f in range(4):
            tr = (fold != f) & (np.array(parts[s]) != 0)
            m, d = x[tr].mean(axis=0), x[tr].std(axis=0)
            b = plain_logistic(((x[tr] - m) / d)[:, use], y[tr], 0.5 * tr.sum() / 100)
            te = fold == f
            want[te] += 1 / (1 + np.exp(-(b[0] + ((x[te] - m) / d)[:, use] @ b[1:]))) / 3
    assert max(abs(got[k] - want[k]) for k in range(len(x))) < 1e-8


def test_backward_elimination_by_masks(spark):
    x, y, fold = table(160)
    names = [f"f{j}" for j in range(5)]
    got = grids.eliminated(grids.Grid(frame(spark, x, y, fold), "id", "y", names, ["fold"]), names, [0, 1, 2, 3], 2)
    left = list(range(5))
    for dropped, auc in got:
        tried = []
        for j in left:
            use, score = [i for i in left if i != j], np.zeros(len(x))
            for f in range(4):
                tr = fold != f
                m, d = x[tr].mean(axis=0), x[tr].std(axis=0)
                b = plain_logistic(((x[tr] - m) / d)[:, use], y[tr], 1.0)
                score[~tr] = 1 / (1 + np.exp(-(b[0] + ((x[~tr] - m) / d)[:, use] @ b[1:])))
            tried.append((area(score, y), j))
        best = max(a for a, _ in tried)
        j = next(j for a, j in tried if abs(a - best) < 1e-12)
        assert dropped == f"f{j}" and abs(auc - best) < 1e-9
        left.remove(j)
    assert len(left) == 2


# ---- lasso


def plain_lasso(x, y, alpha, w=None):
    """Coordinate descent over rows; x and y have mean 0."""
    n, p = x.shape
    w = np.zeros(p) if w is None else w.copy()
    for _ in range(100_000):
        before = w.copy()
        for j in range(p):
            r = y - x @ w + x[:, j] * w[j]
            rho, d = x[:, j] @ r / n, x[:, j] @ x[:, j] / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / d if d > 1e-12 else 0
        if np.abs(w - before).max() < 1e-11:
            return w
    raise AssertionError


def test_neighbourhoods_equal_plain_coordinate_descent(spark):
    n, p, folds, length = 150, 7, 3, 12
    x = R.normal(size=(n, p))
    x[:, 1] = x[:, 0] * 2 + 0.3 * R.normal(size=n) + 50
    x[:, 2] = x[:, 1] - x[:, 3] + R.normal(size=n)
    x[:, 6] = 4.0
    fold = np.arange(n) % folds
    df = spark.createDataFrame([(k, x[k].tolist(), int(fold[k])) for k in range(n)] + [(999, None, 0), (998, [None] * p, 1), (997, [float("nan")] * p, 1)], "id long, x array<double>, fold int")
    got = {}
    for r in lasso.lasso_neighbours(df, "x", "fold", folds, length, 1e-2).collect():
        got.setdefault(r.target, {})[r.neighbour] = (r.coefficient, r.alpha)
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    for t in range(p):
        others = [j for j in range(p) if j != t]
        top = np.abs(z[:, others].T @ z[:, t] / n).max()
        alphas = max(top, 1e-12) * 1e-2 ** (np.arange(length) / (length - 1))
        errors = np.zeros(length)
        for f in range(folds):
            tr = fold != f
            mx, my, w = z[tr].mean(axis=0), z[tr, t].mean(), None
            for k, a in enumerate(alphas):
                w = plain_lasso((z[tr] - mx)[:, others], z[tr, t] - my, a, w)
                errors[k] += ((z[~tr, t] - my - (z[~tr] - mx)[:, others] @ w) ** 2).mean() / folds
        best = int(np.argmin(np.round(errors, 12)))
        w = plain_lasso(z[:, others], z[:, t], alphas[best])
        want = {o: c for o, c in zip(others, w, strict=True) if c}
        assert set(got.get(t, {})) == set(want), t
        for o, c in want.items():
            assert abs(got[t][o][0] - c) < 1e-6 and abs(got[t][o][1] - alphas[best]) < 1e-12


def test_replication_and_correlations(spark):
    x = R.normal(size=(80, 3))
    x[:, 1] += x[:, 0]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    got = {(r.a, r.b): r.r for r in lasso.correlations(df, "x").collect()}
    assert all(abs(got[a, b] - np.corrcoef(x[:, a], x[:, b])[0, 1]) < 1e-12 for a, b in ((0, 1), (0, 2), (1, 2)))
    pairs = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (2, 1), (5, 6)], "target int, neighbour int")
    first = spark.createDataFrame([(0, 1, 0.9), (0, 2, -0.5), (1, 2, 0.4)], "a int, b int, r double")
    second = spark.createDataFrame([(0, 1, 0.3), (0, 2, 0.5), (1, 2, 0.1)], "a int, b int, r double")
    kept = {(r.target, r.neighbour): r.replicated for r in lasso.replicated(pairs, first, second, 0.2).collect()}
    assert kept == {(0, 1): True, (1, 0): True, (2, 0): False, (2, 1): False, (5, 6): False}
    assert lasso.replicated(pairs, first, second).where(F.col("r_first").isNull()).count() == 1
