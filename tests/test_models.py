"""Methods without a SQL twin, against plain versions; edge cases of the others."""

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from cohera.operators import compartments, matrix, models, networks, relational, resampling, stats
from pyspark.sql import functions as F


def test_normal_functions(spark):
    grid = [(p,) for p in (1e-6, 0.001, 0.02, 0.3, 0.5, 0.8, 0.99, 1 - 1e-6)]
    got = spark.createDataFrame(grid, "p double").select("p", matrix.normal_quantile(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == pytest.approx([NormalDist().inv_cdf(r.p) for r in got], abs=1e-7)
    zs = spark.createDataFrame([(z,) for z in (0.0, 0.5, -1.96, 5.0, 12.0)], "z double").select("z", stats.normal_two_sided_p(F.col("z")).alias("p")).collect()
    assert [r.p for r in zs] == pytest.approx([math.erfc(abs(r.z) / math.sqrt(2)) for r in zs], rel=2e-7)


def test_student_t(spark):
    cases = [(2.0, 10), (0.5, 3), (-3.0, 25), (0.0, 1), (40.0, 2)]
    got = spark.createDataFrame([*cases, (None, 4)], "t double, n int").select(stats.student_t_p("t", "n").alias("p")).collect()

    def tail(t, n):  # the density integrated from 0 to |t|
        x = np.linspace(0, abs(t), 400001)
        y = np.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + x * x / n) ** (-(n + 1) / 2)
        return 1 - 2 * np.trapezoid(y, x)

    assert [r.p for r in got[:5]] == pytest.approx([tail(*c) for c in cases], abs=1e-8)
    assert got[5].p is None


def test_exact_tests(spark):
    row = spark.createDataFrame([(8, 2, 1, 5, 9, 3)], "a int, b int, c int, d int, w int, l int")
    p = row.select(stats.fisher_exact_p("a", "b", "c", "d").alias("f"), stats.sign_test_p("w", "l").alias("s")).first()
    assert p.f == pytest.approx(0.0349650, abs=1e-6)
    assert p.s == pytest.approx(sum(math.comb(12, k) for k in range(9, 13)) / 2**12)


def test_poisson_binomial(spark):
    probs = [0.1, 0.5, 0.9, 0.25]
    want = [sum(math.prod(p if x else 1 - p for p, x in zip(probs, xs)) for xs in itertools.product((0, 1), repeat=4) if sum(xs) >= k) for k in range(5)]
    df = spark.createDataFrame([(probs,)], "p array<double>")
    assert [df.select(stats.poisson_binomial_tail(F.col("p"), F.lit(k)).alias("x")).first().x for k in range(5)] == pytest.approx(want)


def test_greedy_match(spark):
    rows = [("c", "a", "x", 0.9, 0), ("c", "a", "y", 0.8, 0), ("c", "b", "x", 0.95, 1), ("c", "b", "y", 0.1, 1), ("c", "d", "x", 0.5, 2), ("e", "b", "x", 0.3, 1)]
    got = relational.greedy_match(spark.createDataFrame(rows, "g string, l string, r string, s double, o int"), "g", "l", "r", "s", "o")
    assert {(r.g, r.l, r.r) for r in got.collect()} == {("c", "a", "x"), ("c", "b", "y"), ("e", "b", "x")}


def test_kmers_and_intervals(spark):
    t = spark.createDataFrame([("t1", "AACCGGTTAC"), ("t2", "AC"), ("t3", None)], "name string, sequence string")
    p = spark.createDataFrame([("p", "CCGG"), ("q", "GTAAC"), ("r", "AC")], "probe string, seq string")
    assert {tuple(r) for r in relational.contained_probes(p, t, 4).collect()} == {("p", "t1", "+", 3), ("p", "t1", "-", 3), ("q", "t1", "-", 6)}
    rng = np.random.default_rng(0)
    a = [("c", k, int(s), int(s + e)) for k, (s, e) in enumerate(zip(rng.integers(0, 500, 60), rng.integers(0, 90, 60)))]
    b = [("c", k, int(s), int(s + e)) for k, (s, e) in enumerate(zip(rng.integers(0, 500, 60), rng.integers(0, 90, 60)))]
    got = relational.overlaps(spark.createDataFrame(a, "c string, i int, a_start long, a_end long"), spark.createDataFrame(b, "c string, j int, b_start long, b_end long"), "c", 7, 20).select("i", "j").collect()
    want = sorted((x[1], y[1]) for x in a for y in b if y[2] <= x[3] + 7 and y[3] >= x[2] - 7)
    assert sorted(map(tuple, got)) == want


def test_pearson_screen_holds_to_bonferroni(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(size=40)
    f = {"same": t, "near": t + rng.normal(size=40), "noise": rng.normal(size=40), "flat": np.ones(40)}
    long = spark.createDataFrame([(k, n, float(v[k])) for n, v in f.items() for k in range(40)], "s int, f string, v double")
    got = stats.pearson_screen(long, "s", "f", "v", spark.createDataFrame([(k, float(t[k])) for k in range(40)], "s int, t double"), 0.5, 10).collect()
    assert [r.f for r in got] == ["same", "near"]
    assert got[1].r == pytest.approx(np.corrcoef(t, f["near"])[0, 1])


def test_folds_keep_donors_and_strata(spark):
    df = spark.createDataFrame([(k, k // 3, k // 3 % 2) for k in range(90)], "id int, donor int, y int")
    f = resampling.folds(df, "donor", 5, ["y"], 2)
    assert f.groupBy("repeat", "donor").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r.n for r in f.groupBy("repeat", "y", "fold").agg(F.count_distinct("donor").alias("n")).collect()]
    assert set(sizes) == {3}
    assert f.count() == 180


def test_bootstrap(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(rng.normal() + y), int(y)) for k in range(120) for y in [k % 2]]
    df = spark.createDataFrame(rows, "id int, s double, y int")
    d = resampling.draws(df, "id", 20, ["y"])
    assert {r.n for r in d.groupBy("replicate", "y").agg(F.sum("times").alias("n")).collect()} == {60}
    i = resampling.interval(resampling.bootstrap_auc(df, "id", "s", "y", 200), "auc").first()
    assert i.low < stats.two_group_auc(df, "s", "y", []).first().auc < i.high
    same = resampling.paired_bootstrap(df.withColumn("t", F.col("s")), "id", "s", "t", "y", 5)
    assert same.where("difference <> 0").count() == 0
    assert resampling.bootstrap_auc(df.limit(0), "id", "s", "y", 5).count() == 0


def test_models(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 150)
    x = np.column_stack([y + rng.normal(size=150) * 0.7, rng.normal(size=150), rng.normal(size=150)])
    df = spark.createDataFrame([(k, int(y[k]), *map(float, x[k])) for k in range(150)], "id int, y int, a double, b double, c double")
    f = resampling.folds(df, "id", 5, ["y"])
    s = models.out_of_fold(f, ["repeat"], "fold", "id", "y", ["a", "b", "c"])
    assert s.count() == 150
    assert stats.spearman(df.withColumn("b", F.lit(1.0)), "a", "b", []).first().rho is None
    assert models.pooled_auc_of(s, ["repeat"], "repeat", "id", "y").first().auc > 0.75
    worth = {"a": 5.0, "b": 2.0, "c": 1.0}
    score = lambda sets: spark.createDataFrame([(k, sum(worth[g] for g in g_)) for k, g_ in enumerate(sets)], "candidate int, score double")
    assert models.backward_elimination(score, ["a", "b", "c"]) == [("c", 7.0), ("b", 5.0)]
    assert models.backward_elimination(score, ["a", "b", "c"], done=["c"]) == [("b", 5.0)]
    assert models.forward_selection(score, ["c", "b", "a"], 2) == [("a", 5.0), ("b", 7.0)]
    out, rounds = models.until_stable(spark.range(10).toDF("id"), lambda d: d.where("id < 4"), "id")
    assert (out.count(), rounds) == (4, 2)
    gain = models.combo_gain(spark.createDataFrame([("a", 0.7), ("b", 0.6)], "feature string, auc double"), spark.createDataFrame([(["b", "a"], 0.8), (["a", "b"], 0.8)], "members array<string>, auc double")).collect()
    assert [r.synergy for r in gain] == [pytest.approx(0.1)]


def test_compartments(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=30)
    rows = [(s, f, float(z[s] * (f + 1) + rng.normal() * 0.01)) for s in range(30) for f in range(4)]
    df = spark.createDataFrame(rows, "s int, f int, v double")
    pc = compartments.first_component(df, "s", "f", "v", spark.createDataFrame([(k, "n") for k in range(4)], "f int, kind string"), "kind").orderBy("s").collect()
    assert np.corrcoef([r.score for r in pc], z)[0, 1] > 0.999
    res = compartments.residualise(df, "s", "f", "v", spark.createDataFrame([(s, float(z[s])) for s in range(30)], "s int, z double"), ["z"])
    assert res.groupBy("f").agg(F.stddev_pop("residual").alias("d")).agg(F.max("d")).first()[0] < 0.05
    shift = spark.createDataFrame([(s, f, float(rng.normal() + 5 * (s % 2) + f * 0.1), s % 2) for s in range(60) for f in range(40)], "s int, f int, v double, b int")
    out = compartments.combat(shift, "s", "f", "v", "b")
    m = {r.b: r.m for r in out.groupBy("b").agg(F.avg("adjusted").alias("m")).collect()}
    assert out.count() == 2400
    assert abs(m[0] - m[1]) < 0.1


def test_networks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")], "s string, t string")
    got = {tuple(r) for r in networks.reachable(e, "s", "t").collect()}
    assert got == {(u, v) for u in "abc" for v in "abcd"} | {("x", "x")}
    assert {tuple(r) for r in networks.degrees(e, "s", "t").collect()} == {("a", 2), ("b", 2), ("c", 3), ("d", 1)}
    files = spark.createDataFrame([("raw", 5), ("mid", 3), ("out", 9), ("alone", 1)], "name string, modified int")
    st = {r.name: (r.stale, r.because) for r in networks.stale(files, spark.createDataFrame([("raw", "mid"), ("mid", "out")], "source string, target string")).collect()}
    assert st == {"raw": (False, None), "mid": (True, "raw"), "out": (False, None), "alone": (False, None)}
    rng = np.random.default_rng(5)
    a = rng.normal(size=500)
    b = a + rng.normal(size=500)
    c = b + rng.normal(size=500)
    r = np.corrcoef([a, b, c])
    pairs = spark.createDataFrame([(i, j, float(r[i, j])) for i in range(3) for j in range(i + 1, 3)], "a int, b int, r double")
    assert {(x.a, x.b) for x in networks.skeleton(pairs, 500).collect()} == {(0, 1), (1, 2)}
