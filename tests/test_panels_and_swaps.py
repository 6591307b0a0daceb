"""Swaps, decomposition and rank-test tails against plain programs."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from cohera.operators import panels
from cohera.operators import stats as st
from cohera.operators import transfer as tr
from pyspark.sql import functions as F

R = np.random.default_rng(21)


def area(s, y):
    s = np.round(s, 10)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b)) if len(a) and len(b) else None


def long(spark, parts):
    """parts: (cohort, x, y, missing features)."""
    rows = [(c, f"{c}{i}", j, float(x[i, j]), int(y[i])) for c, x, y, gone in parts for i in range(len(x)) for j in range(x.shape[1]) if j not in gone]
    return spark.createDataFrame(rows, "cohort string, sample string, feature int, value double, label int")


def test_forward_swaps_with_a_cohort_that_lacks_two_slots(spark):
    n, p = 60, 12
    made = {}
    for c in ("train", "goal", "other"):
        y = R.integers(0, 2, n)
        made[c] = (R.normal(size=(n, p)) + np.outer(y, np.r_[np.zeros(6), 0.1, 0.9, 0.8, 0.0, 0.6, 0.3]), y)
    gone = {"goal": {3}, "other": {7, 10}}
    slots, options = [(f"s{k}", k) for k in range(6)], {f"s{k}": 6 + k for k in range(6)}
    tx, ty = made["train"]
    mean, sd = tx.mean(axis=0), tx.std(axis=0)
    z = (tx - mean) / sd
    w = z[ty == 1].mean(axis=0) - z[ty == 0].mean(axis=0)

    def score(active, c):
        use = [f for f in (active.get(s, f) for s, f in slots) if f not in gone[c]]
        x, y = made[c]
        return area((((x - mean) / sd)[:, use] * w[use]).sum(axis=1), y), len(use)

    active, want = {}, []
    now = score(active, "goal")[0]
    while True:
        tries = []
        for k, (s, _) in enumerate(slots):
            if s not in active:
                auc, held = score({**active, s: options[s]}, "goal")
                if held >= 5:
                    tries.append((round(auc - now, 12), -k))
        gain, k = max(tries, default=(0, 0))
        if gain <= 0:
            break
        active[slots[-k][0]] = options[slots[-k][0]]
        now = score(active, "goal")[0]
        want.append((slots[-k][0], gain, now, score(active, "other")[0]))
    train = long(spark, [("train", *made["train"], ())])
    cohorts = long(spark, [(c, *made[c], gone[c]) for c in gone])
    got = tr.forward_swaps(train, cohorts, slots, options, "goal", "sample", "feature", "value", "label", "cohort")
    assert [g["slot"] for g in got] == [x[0] for x in want] and len(want) >= 2 and {7, 10} & {g["replacement"] for g in got}
    for g, (_, gain, goal, other) in zip(got, want, strict=True):
        assert abs(g["gain"] - gain) < 1e-9 and abs(g["areas"]["goal"] - goal) < 1e-9 and abs(g["areas"]["other"] - other) < 1e-9
    assert tr.forward_swaps(train, cohorts, slots, options, "goal", "sample", "feature", "value", "label", "cohort", least=7) == []


def test_decomposition_equals_plain_arms(spark):
    n, p, size, draws = 90, 14, 4, 3
    y = R.integers(0, 2, n)
    x = R.normal(size=(n, p)) + np.outer(y, np.linspace(0, 0.7, p))
    x[:, 5] = 3.0  # constant
    fold = R.integers(0, 3, n)
    rows = [(f"i{i}", j, float(x[i, j]), int(y[i]), int(fold[i])) for i in range(n) for j in range(p)] + [("nobody", 0, None, 1, 0), ("i0", 1, 5.0, None, 0)]
    df = spark.createDataFrame(rows, "sample string, feature int, value double, label int, fold int")
    table = lambda fs: spark.createDataFrame([(f,) for f in fs], "feature int")

    def weights(rows):
        a, b = x[rows], y[rows]
        sd = a.std(axis=0)
        return [((a[b == 1, j].mean() - a[b == 0, j].mean()) / sd[j], sd[j]) if sd[j] > 1e-9 else None for j in range(p)]

    def best(w, among):
        return sorted((j for j in among if w[j]), key=lambda j: (-round(abs(w[j][0]), 12), j))[:size]

    def drawn(draw, f, w, among):
        h = lambda j: int(hashlib.md5(f"0|{draw}|{f}|{j}".encode()).hexdigest()[:8], 16)
        return sorted((j for j in among if w[j]), key=lambda j: (h(j), j))[:size]

    whole, arms = weights(np.ones(n, bool)), {a: [] for a in tr.ARMS}
    for f in range(3):
        w, te = weights(fold != f), fold == f
        auc = lambda panel, w=w, te=te: area(sum(w[j][0] * x[te, j] / w[j][1] for j in panel if w[j]), y[te])
        evens = range(0, p, 2)
        arms["fixed"].append(auc([1, 2, 5]))
        arms["full_data"].append(auc(best(whole, range(p))))
        arms["pool_fixed"].append(auc(best(w, evens)))
        arms["nested"].append(auc(best(w, range(p))))
        arms["random_pool"].append(np.mean([auc(drawn(d, f, w, evens)) for d in range(1, draws + 1)]))
        arms["random_all"].append(np.mean([auc(drawn(d, f, w, range(p))) for d in range(1, draws + 1)]))
    got = tr.decomposition(df, "sample", "feature", "value", "label", "fold", table([1, 2, 5]), table(range(0, p, 2)), size, draws).first()
    for a in tr.ARMS:
        assert abs(got[a] - np.mean(arms[a])) < 1e-9, a
    assert abs(got.total - (got.approximation + got.ranking + got.pooling)) < 1e-12


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def test_tails_with_ties_and_of_any_size(spark):
    r = random.Random(4)
    groups = {f"g{k}": ([r.randrange(6 + k) for _ in range(10 + k)], [r.randrange(5 + k) for _ in range(10)]) for k in range(8)}
    groups["same"] = ([1, 1], [1, 1, 1])
    df = spark.createDataFrame([(g, float(v), y) for g, (a, b) in groups.items() for vs, y in ((a, 1), (b, 0)) for v in vs], "g string, v double, y int")
    got = {x.g: x for x in st.mann_whitney_sides(df, "v", "y", ["g"]).collect()}
    exact = {s: {x.g: x.p for x in st.exact_mann_whitney(df, "v", "y", ["g"], s).collect()} for s in ("less", "greater", "two-sided")}
    for g, (a, b) in groups.items():
        n1, n0, n = len(a), len(b), len(a) + len(b)
        u = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
        ties = sum(t**3 - t for t in (sum(v == w for w in a + b) for v in set(a + b)))
        sd = math.sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1))))
        if not sd:
            assert got[g].p is got[g].p_less is got[g].p_greater is None
            continue
        off = u - n1 * n0 / 2
        want = {"less": tail((-off - 0.5) / sd), "greater": tail((off - 0.5) / sd), "two-sided": min(1.0, 2 * tail(max(abs(off) - 0.5, 0) / sd))}
        assert got[g].u == u and all(abs(w - exact[s][g]) < 3e-7 for s, w in want.items())
        assert abs(got[g].p_less - want["less"]) < 3e-7 and abs(got[g].p_greater - want["greater"]) < 3e-7


def test_ways_of_rank_sums():
    for a, b in ((3, 4), (1, 6), (5, 2)):
        us = [sum(i > j for i in pick for j in range(a + b) if j not in pick) for pick in itertools.combinations(range(a + b), a)]
        assert list(st._rank_sum_ways(a, b)) == [us.count(u) for u in range(a * b + 1)]
    many = st._rank_sum_ways(8, 900)  # more than 50 rows are counted out as well
    assert many.sum() == math.comb(908, 8) and many[0] == many[-1] == 1 and st._tail(many, 0, "less") == pytest.approx(1 / math.comb(908, 8))


def test_panel_views(spark):
    ranked = spark.createDataFrame([("p", f"s{k}", k, 10 - k, k % 2 == 0) for k in range(6)] + [("q", "s9", 9, 1, None)], "name string, sym string, feat int, gain int, codes boolean")
    t = panels.panel_table(ranked, "name", "sym", "feat", [F.desc("gain")], F.col("codes"), 4)
    assert {(r.panel, r.position, r.symbol) for r in panels.members(t, 3, True).collect()} == {("p", 1, "s0"), ("p", 3, "s2")}
    effects = spark.createDataFrame([(0, 0.5), (1, -2.0), (2, 0.0)], "feature int, e double")
    assert panels.register(t, effects, "e", 2) == ["panel_members", "panel_critical", "panel_sizes", "panel_directions"]
    assert {tuple(r) for r in spark.sql("SELECT panel, size, label FROM panel_sizes").collect()} == {("p", 4, "4-gene panel"), ("q", 1, "1-gene panel")}
    assert {(r.symbol, r.direction) for r in spark.table("panel_directions").collect()} == {("s0", "up"), ("s1", "down"), ("s2", None), ("s3", None), ("s9", None)}
    assert spark.table("panel_critical").count() == 3
