"""Both ways of ranking, quantiles and running sums; batch correction, transfer and trimming against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from cohera.operators import compartments as cm
from cohera.operators import matrix as mx
from cohera.operators import models as md
from cohera.operators import networks as nw
from cohera.operators import ranks as rk
from cohera.operators import resampling as rs
from cohera.operators import stats as st
from cohera.operators import transfer as tr
from cohera.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "b", None]), r.choice([None, *range(40)]), r.choice([0, 1]), k) for k in range(900)] + [("c", 1.5, 1, 901), ("d", None, 0, 902)]
    return spark.createDataFrame([(g, None if v is None else float(v), y, k) for g, v, y, k in data], "g string, v double, y int, k int")


@pytest.mark.parametrize("largest", [10**6, 0])
def test_midranks_and_numbers(rows, largest):
    pdf = rows.toPandas()
    want = pdf.groupby("g", dropna=False).v.rank()
    got = rk.with_midrank(rows, "v", ["g"], largest=largest).toPandas().sort_values("k").midrank
    assert np.allclose(got, want, equal_nan=True)
    for down in (False, True):
        known = rows.where("v is not null")
        got = rk.row_numbers(known, "v", ["g"], ["k"], "n", descending=down, largest=largest).toPandas().sort_values("k")
        p = pdf.dropna(subset=["v"]).sort_values(["v", "k"], ascending=[not down, True])
        assert got.n.tolist() == (p.groupby("g", dropna=False).cumcount() + 1).loc[p.sort_values("k").index].tolist()
    assert rk.with_midrank(rows.limit(0), "v", ["g"], largest=largest).count() == 0


@pytest.mark.parametrize("largest", [10**6, 0])
def test_quantiles(rows, largest):
    got = {r.g: (r.q0, r.q1, r.q2) for r in rk.quantiles(rows, "v", ["g"], [0.0, 0.37, 1.0], largest=largest).collect()}
    want = {(None if pd.isna(g) else g): tuple(np.quantile(p.v.dropna(), [0, 0.37, 1])) for g, p in rows.toPandas().groupby("g", dropna=False) if p.v.notna().any()}
    assert set(got) == set(want)
    assert all(np.allclose(got[g], want[g]) for g in want)
    whole = rk.quantiles(rows, "v", [], [0.5], largest=largest).first()[0]
    assert whole == np.median(rows.toPandas().v.dropna())
    assert rk.quantiles(rows.limit(0), "v", ["g"], [0.5], largest=largest).count() == 0


@pytest.mark.parametrize("largest", [10**6, 0])
def test_areas_and_tests(rows, largest):
    pdf = rows.toPandas().dropna(subset=["v"])
    got = {r.g: r.auc for r in st.two_group_auc(rows, "v", "y", ["g"], largest=largest).collect()}
    for g, p in pdf.groupby("g", dropna=False):
        x, y = p.v[p.y == 1].to_numpy(), p.v[p.y == 0].to_numpy()
        want = np.mean((x[:, None] > y) + 0.5 * (x[:, None] == y)) if len(x) and len(y) else None
        assert got[None if pd.isna(g) else g] == (pytest.approx(want) if want is not None else None)
    u = {r.g: r.u for r in st.mann_whitney(rows, "v", "y", ["g"], largest=largest).collect()}
    p = pdf[pdf.g == "a"]
    assert u["a"] == pytest.approx(np.sum((p.v[p.y == 1].to_numpy()[:, None] > p.v[p.y == 0].to_numpy()) + 0.5 * (p.v[p.y == 1].to_numpy()[:, None] == p.v[p.y == 0].to_numpy())))
    w = {r.g: r.w for r in st.signed_rank(rows.withColumn("d", rows.v - 20), "d", ["g"], largest=largest).collect()}
    d = p.v[p.v != 20] - 20
    assert w["a"] == d.abs().rank()[d > 0].sum()
    rho = {r.g: r.rho for r in st.spearman(rows.withColumn("z", rows.v * rows.v % 17), "v", "z", ["g"], largest=largest).collect()}
    assert rho["a"] == pytest.approx(p.v.rank().corr((p.v * p.v % 17).rank()))


def test_normal_tail(spark):
    z = spark.createDataFrame([(x / 4,) for x in range(-30, 31)], "z double")
    for r in z.select("z", st.normal_two_sided_p(z.z).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=2e-7)


def plain_combat(data, batch):
    groups = [np.flatnonzero(batch == b) for b in np.unique(batch)]
    mean = sum(len(i) / data.shape[1] * data[:, i].mean(axis=1) for i in groups)
    within = sum(((data[:, i] - data[:, i].mean(axis=1, keepdims=True)) ** 2).sum(axis=1) for i in groups) / data.shape[1]
    sd = np.sqrt(np.maximum(within, 1e-8))
    s = (data - mean[:, None]) / sd[:, None]
    out = s.copy()
    for i in groups:
        x, n = s[:, i], len(i)
        g, d = x.mean(axis=1), np.maximum(x.var(axis=1), 1e-8)
        m, v = d.mean(), d.var()
        gs, ds = g, d
        for _ in range(500):
            g1 = (g.var() * n * g + ds * g.mean()) / (g.var() * n + ds)
            d1 = (0.5 * ((x - g1[:, None]) ** 2).sum(axis=1) + (m * v + m**3) / v) / (n / 2 + (2 * v + m**2) / v - 1)
            change = max((abs(g1 - gs) / (abs(gs) + 1e-12)).max(), (abs(d1 - ds) / (abs(ds) + 1e-12)).max())
            gs, ds = g1, d1
            if change <= 1e-4:
                break
        out[:, i] = (x - gs[:, None]) / np.sqrt(ds)[:, None]
    return out * sd[:, None] + mean[:, None]


def test_combat(spark):
    r = np.random.default_rng(4)
    data, batch = r.normal(5, 2, (12, 30)), np.arange(30) % 3
    data += batch * r.normal(0, 2, (12, 1))
    data[3] = 7.0  # does not vary
    df = spark.createDataFrame([(s, f, float(data[f, s]), int(batch[s])) for f in range(12) for s in range(30)], "s int, f int, v double, b int")
    got = {(x.f, x.s): x.adjusted for x in cm.combat(df, "s", "f", "v", "b").collect()}
    want = plain_combat(data, batch)
    assert np.allclose([[got[f, s] for s in range(30)] for f in range(12)], want, atol=1e-8)


def test_roc_band_and_grid(spark):
    r = np.random.default_rng(1)
    y = (r.random(80) < 0.4).astype(int)
    s = np.round(r.normal(y, 1), 1)
    df = spark.createDataFrame([(k, float(a), int(b)) for k, (a, b) in enumerate(zip(s, y, strict=True))], "k int, s double, y int")

    def curve(score, label, weight):
        cut = np.unique(score)[::-1]
        tpr = np.array([0, *[weight[(score >= c) & (label == 1)].sum() for c in cut]]) / weight[label == 1].sum()
        fpr = np.array([0, *[weight[(score >= c) & (label == 0)].sum() for c in cut]]) / weight[label == 0].sum()
        return [max(tpr[abs(fpr - x) < 1e-9], default=np.interp(x, fpr, tpr)) for x in np.arange(21) / 20]

    got = [x.tpr for x in st.roc_on_grid(df, "s", "y", 20).orderBy("fpr").collect()]
    assert np.allclose(got, curve(s, y, np.ones(80)))
    d = rs.draws(df, "k", 8, ["y"]).toPandas()
    each = []
    for _, p in d.groupby("replicate"):
        times = p.set_index("k").times.reindex(range(80)).fillna(0).to_numpy()
        kept = times > 0
        each.append(curve(s[kept], y[kept], times[kept]))
    band = rs.roc_band(df, "k", "s", "y", 8, 20).orderBy("fpr").toPandas()
    assert np.allclose(band[["low", "middle", "high"]].to_numpy().T, np.quantile(each, [0.025, 0.5, 0.975], axis=0))


def area(s, y):
    x, z = np.asarray(s)[np.asarray(y) == 1], np.asarray(s)[np.asarray(y) == 0]
    return np.mean((x[:, None] > z) + 0.5 * (x[:, None] == z))


def test_trimming_without_each_dataset(spark):
    r = np.random.default_rng(2)
    n, m = 90, 5
    y, d = np.arange(n) % 2, np.arange(n) // 2 % 3
    v = np.round(r.normal(0, 1, (n, m)) + y[:, None] * np.linspace(0, 1, m), 2)
    df = spark.createDataFrame([(s, f, float(v[s, f]), int(y[s]), int(d[s])) for s in range(n) for f in range(m)], "s int, f int, v double, y int, d int")
    got = tr.trim_without_each(df, "s", "f", "v", "y", "d", 2)
    for held in range(3):
        active, want = list(range(m)), []
        while len(active) > 2:
            def score(f):
                parts = [(area(v[d == c][:, [g for g in active if g != f]].sum(axis=1), y[d == c]), (d == c).sum()) for c in range(3) if c != held]
                return sum(a * k for a, k in parts) / sum(k for _, k in parts)

            best = max(active, key=lambda f: (round(score(f), 12), -f))
            want.append((best, pytest.approx(score(best))))
            active.remove(best)
        assert [(f, x) for h, _, f, x in got if h == held] == want


def test_zero_shot_keeps_training_scale(spark):
    rows = [("a", 0, 1, 1.0, 0), ("a", 1, 1, 3.0, 1), ("b", 2, 1, 10.0, 0), ("b", 3, 1, 30.0, 1), ("b", 4, 2, 5.0, 1)]
    df = spark.createDataFrame(rows, "c string, s int, f int, v double, y int")
    got = tr.zero_shot(df.where("c = 'a'"), df.where("c = 'b'"), "s", "f", "v", "y", "c").collect()
    assert [tuple(x) for x in got] == [("b", 1, 1, 1.0)]


def test_fills(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", None), (1, "z", float("nan")), (2, "x", 3.0), (2, "y", 4.0), (2, "z", None)], "s int, f string, v double")
    of = lambda how, train=None: [r.v for r in mx.filled(df, "s", "f", "v", how, train).orderBy("s", "f").collect()]
    assert of("zero") == [1, 0, 0, 3, 4, 0]
    assert of("column_mean") == [1, 4, 0, 3, 4, 0]
    assert of("row_median") == [1, 1, 1, 3, 4, 3.5]
    assert of("train_mean", df.where("s = 1")) == [1, 0, 0, 3, 4, 0]
    assert {r.f for r in mx.varying(df, "f", "v").collect()} == {"x"}


def test_unit_mean_weighs_cohorts_alike(spark):
    df = spark.createDataFrame([("u", "c1", 1.0)] * 9 + [("u", "c2", 3.0), ("w", "c1", 10.0), ("w", "c1", None)], "unit string, cohort string, m double")
    assert tuple(st.weighted_unit_mean(df, "m", "unit", "cohort").first()) == (2, 6.0)


def test_size_lines_of_every_file(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"m{k}.mtx").write_text(f"%%MatrixMarket\n% note\n3 3 2\n{k + 1} 1 5\n3 {k + 1} 7\n")
    got = sorted(tuple(r) for r in tables.matrix_market(spark, str(tmp_path)).collect())
    assert got == sorted([(k + 1, 1, 5.0) for k in range(3)] + [(3, k + 1, 7.0) for k in range(3)])


def test_long_paths_and_stable_sets(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(7, 3)], "a int, b int")
    got = {tuple(r) for r in nw.reachable(edges, "a", "b").collect()}
    assert got == {(a, b) for a in range(61) for b in range(61) if a < b or (a >= 3 and a <= 7 and b >= 3)}
    start = spark.range(64).withColumnRenamed("id", "k")
    last, rounds = md.until_stable(start, lambda now: now.where(now.k < now.agg({"k": "max"}).first()[0]) if now.count() > 30 else now, "k")
    assert (last.count(), rounds) == (30, 35)
