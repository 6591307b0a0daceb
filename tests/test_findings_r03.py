"""What the third round's findings named: results against the DuckDB twins on tables made for it, and the shape of the work."""

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from cohera.operators import compartments, models, networks, resampling, stats
from cohera.plans import ORACLE, QUERIES
from pyspark.sql import functions as F


def write(tmp_path, **tables):
    for name, columns in tables.items():
        pd.DataFrame(columns).to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def twin(d, name, *tables):
    with duckdb.connect() as c:
        for t in tables:
            c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
        return c.execute(ORACLE[name]).fetchall()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_degree_where_ids_of_both_sides_meet(spark, tmp_path):
    d = write(tmp_path, lineitem={"l_suppkey": [1003, 1003, 1004, 7, 1005], "l_partkey": [3, 5, 3, 403, 405], "l_quantity": [50.0] * 5})
    assert {tuple(r) for r in QUERIES["node_degree"](spark, d).collect()} == set(twin(d, "node_degree", "lineitem"))
    e = spark.createDataFrame([(1, 1), (1, 2), (3, None)], "a int, b int")
    assert {tuple(r) for r in networks.degrees(e, "a", "b").collect()} == {(1, 1), (2, 1)}
    assert {tuple(r) for r in networks.degrees(e, "a", "b", loops=True).collect()} == {(1, 2), (2, 1), (3, 0), (None, 1)}


def test_rank_correlations_of_groups_beyond_the_bound(spark):
    r = random.Random(8)
    rows = [(g, float(r.randrange(12)), float(r.randrange(5)), r.randrange(2)) for g in ("a", "b", None) for _ in range(120)] + [("flat", 1.0, float(k), 1) for k in range(9)] + [("a", None, 1.0, 1), ("b", 1.0, None, 0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, c int")
    for f in (lambda n: stats.spearman(df, "x", "y", ["g"], largest=n), lambda n: stats.partial_spearman(df, "x", "y", "c", ["g"], largest=n)):
        small, large = ({t.g: (t.n, t.rho) for t in f(n).collect()} for n in (10_000, 5))
        assert small.keys() == large.keys() == {"a", "b", "flat", None}
        assert large["flat"] == (9, None) and all(large[k] == (small[k][0], pytest.approx(small[k][1], abs=1e-12)) for k in ("a", "b", None))
    cells = stats.spearman(df, "x", "y", ["g"], largest=5)
    assert "Window" not in plan(cells) or "_times" in plan(cells)  # equal rows are one row


def test_used_sizes_are_made_distinct(spark, tmp_path):
    d = write(tmp_path, part={"p_size": [1, 1, 30, 40, None]}, lineitem={"l_quantity": [30.4, 30.6, 12.0, None]})
    got = QUERIES["exclusion_set"](spark, d)
    assert {tuple(r) for r in got.collect()} == {(x,) for (x,) in twin(d, "exclusion_set", "part", "lineitem")}
    assert plan(got).count("Aggregate") >= 2


def test_log_cpm_shuffles_a_sample_once(spark, tmp_path):
    n = None
    d = write(tmp_path, lineitem={"l_orderkey": [1, 1, 2, 3, 3], "l_linenumber": [1, 2, 1, 1, 2], "l_quantity": [1.0, 2.0, 3.0, n, n], "l_extendedprice": [9.0, 1.0, n, 4.0, 0.5], "l_discount": [0.1, n, 0.2, 0.0, 0.0], "l_tax": [0.0, 0.1, 0.3, n, 0.1]})
    got = QUERIES["expression_unpivot_log1p_cpm"](spark, d)
    want = {(k, f): v for k, f, v in twin(d, "expression_unpivot_log1p_cpm", "lineitem")}
    assert {(k, f): v for k, f, v in got.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    assert "Join" not in plan(got)


def test_sets_are_those_of_least_hash_whatever_the_bound(spark):
    df = spark.createDataFrame([(k, "ab"[k % 10 == 0]) for k in range(2000)] + [(5000, None)], "f int, g string")
    number = lambda draw, f: int(hashlib.md5(f"0|{draw}|{f}".encode()).hexdigest()[:8], 16)
    for by in ([], ["g"]):
        want = set()
        for g in ("a", "b", None) if by else (0,):
            fs = [r.f for r in df.collect() if not by or r.g == g]
            want |= {(d, f) for d in range(5) for f in sorted(fs, key=lambda f: (number(d, f), f))[:7]}
        for tried in (None, 7, 1):  # the last ones leave sets short
            got = resampling.random_sets(df, "f", 7, 5, by=by, tried=tried)
            assert sorted((r.draw, r.f) for r in got.collect()) == sorted(want)
    # 10,005 rows (draw, feature): far fewer are ordered
    assert "LogicalRDD" in plan(resampling.random_sets(df, "f", 7, 5)) and "Generate" not in plan(resampling.random_sets(df, "f", 7, 5))


def test_equal_correlations_go_to_the_smaller_kind(spark):
    r = random.Random(4)
    rows = [(s, f, r.random()) for s in range(60) for f in range(33)]
    cents = [(f, k, r.random()) for f in range(33) for k in (0,)]
    cents += [(f, k, 7.3 * m + k) for f, _, m in list(cents) for k in (1, 2)]  # the same order of features in all kinds
    got = compartments.nearest_centroid(spark.createDataFrame(rows, "s int, f int, v double").repartition(7), "s", "f", "v", spark.createDataFrame(r.sample(cents, len(cents)), "f int, k int, m double").repartition(5), "k", "m")
    assert {x.k for x in got.collect()} == {0} and got.count() == 60


def test_draws_take_as_many_tasks_as_picks_call_for(spark, monkeypatch):
    r = random.Random(12)
    df = spark.createDataFrame([(k, float(r.randrange(40)), k % 2) for k in range(300)], "id int, s double, y int")
    whole = [{x.replicate: x[1] for x in f(df).collect()} for f in (lambda t: resampling.bootstrap_auc(t, "id", "s", "y", 6), lambda t: resampling.bootstrap_median_difference(t, "id", "s", "y", 6))]
    monkeypatch.setattr(resampling, "PICKS", 100)
    d = resampling.draws(df, "id", 6, ["y"], carried=["s"])
    assert plan(d).count("RepartitionByExpression") == 3 and d.rdd.getNumPartitions() == 1 + 300 * 6 // 100
    times = {}
    for y in (0, 1):
        rows = [x for x in df.orderBy("id").collect() if x.y == y]
        for b in range(6):
            times[b, y] = [rows[int(hashlib.md5(f"0|{b}|{i}|{y}".encode()).hexdigest()[:8], 16) % len(rows)].s for i in range(len(rows))]
    median = {b: pd.Series(times[b, 1]).median() - pd.Series(times[b, 0]).median() for b in range(6)}
    assert whole[1] == median == {x.replicate: x.difference for x in resampling.bootstrap_median_difference(df, "id", "s", "y", 6).collect()}
    assert whole[0] == {x.replicate: pytest.approx(x.auc) for x in resampling.bootstrap_auc(df, "id", "s", "y", 6).collect()}


def test_skeleton_tests_all_sets_of_a_dense_panel_without_rows_of_sets(spark, monkeypatch):
    g = np.random.default_rng(11)
    x = g.normal(size=(300, 12)) + 0.6 * g.normal(size=(300, 1))
    x[:, 4] += x[:, 2]
    x[:, 7] = x[:, 5]  # a copy: given it, nothing is left, and no partial correlation where it is a member for itself
    c, names = np.corrcoef(x.T), [f"f{k:02}" for k in range(12)]
    table = spark.createDataFrame([(names[a], names[b], float(np.clip(c[a, b], -1, 1)) if (a, b) != (9, 3) else None) for a in range(12) for b in range(a)], "a string, b string, r double")
    r = {frozenset(names[k] for k in (a, b)): float(np.clip(c[a, b], -1, 1)) for a in range(12) for b in range(a) if (a, b) != (9, 3)}

    def partial(a, b, given):
        if not given:
            return r.get(frozenset((a, b)))
        ab, az, bz = (partial(u, v, given[:-1]) for u, v in ((a, b), (a, given[-1]), (b, given[-1])))
        spread = None if None in (ab, az, bz) else max((1 - az**2) * (1 - bz**2), 0) ** 0.5
        return (ab - az * bz) / spread if spread else None

    for n, cut in ((300, 1.959963984540054), (5, 0.2)):  # 5: no freedom is left at level 2, so that every set with a partial correlation separates
        edges, sets = set(), {}
        for e, v in r.items():
            if np.arctanh(min(abs(v), 1 - 1e-12)) * (n - 3) ** 0.5 > cut:
                edges.add(tuple(sorted(e)))
        for level in (1, 2, 3):
            near = {v: sorted({b for e in edges if v in e for b in e if b != v}) for v in names}
            for a, b in sorted(edges):
                z = []
                for s in {s for u, o in ((a, b), (b, a)) for s in itertools.combinations([w for w in near[u] if w != o], level)}:
                    v = partial(a, b, s[::-1])
                    if v is not None:
                        z.append((np.arctanh(min(abs(v), 1 - 1e-12)) * max(n - level - 3, 0) ** 0.5, s))
                if z and min(z)[0] <= cut:
                    sets[a, b] = (level, pytest.approx(min(z)[0], abs=1e-9), min(z)[1])
                    edges = edges - {(a, b)}
        for piece in (1 << 19, 30):
            monkeypatch.setattr(networks, "PIECE", piece)
            kept, gone = networks.deep_skeleton(table, n, 3, cut)
            assert {(e.a, e.b) for e in kept.collect()} == edges
            assert {(s.a, s.b): (s.level, s.z, tuple(s.given)) for s in gone.where("level > 0").collect()} == sets
        assert sets


def test_areas_of_pairs_by_sorted_runs(spark, tmp_path, monkeypatch):
    g = random.Random(5)
    some = lambda: float("nan") if g.random() < 0.05 else g.choice([-0.0, 0.0, 0.5, 0.25, g.random()])
    rows = [(k // 2 if k < 20 else k, [some() for _ in range(6 if k % 7 else 4)], g.choice([0, 1, 2, 3, None])) for k in range(150)] + [(None, [1.0] * 6, 1), (500, None, 1), (501, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        want = {(a, b): (auc, synergy) for a, b, auc, synergy in c.execute(ORACLE["pair_synergy"]).fetchall()}
    assert len(want) == 15
    got = QUERIES["pair_synergy"](spark, str(tmp_path))
    assert {(r.a, r.b): (r.auc, r.synergy) for r in got.collect()} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    wide = frame.where("label is not null").selectExpr("vec_id", "embedding", "label % 2 as y")
    pairs = wide.join(wide.selectExpr("vec_id", "embedding as other"), "vec_id")
    gaps = pairs.withColumn("embedding", F.expr("transform(embedding, (v, i) -> if((vec_id + i) % 9 = 0, null, v))"))  # a missing element leaves its row out of its pairs
    long = gaps.select("y", F.posexplode("embedding").alias("a", "v"), "other").select("y", "a", "v", F.posexplode("other").alias("b", "w")).where("a < b")
    plain = stats.two_group_auc(long.withColumn("v", F.col("v").cast("double") + F.col("w")), "v", "y", ["a", "b"])
    areas = {(a - 1, b - 1): pytest.approx(v[0], abs=1e-12) for (a, b), v in want.items()}
    less = {(r.a, r.b): pytest.approx(r.auc, abs=1e-12) for r in plain.collect()}
    for most in (models.PAIR_SUMS, 400):
        monkeypatch.setattr(models, "PAIR_SUMS", most)
        for largest in (200_000, 40):  # one range of a pair's sums, or several
            assert {(r.a, r.b): r.auc for r in models.pair_areas(pairs, "embedding", "other", "y", largest).collect()} == areas
            assert {(r.a, r.b): r.auc for r in models.pair_areas(gaps, "embedding", "other", "y", largest).collect()} == less != areas
    one_class = spark.createDataFrame([([1.0, 2.0], 1), ([2.0, 1.0], 1)], "x array<double>, y int")
    assert [tuple(r) for r in models.pair_areas(one_class, "x", "x", "y").collect()] == [(0, 1, None)]
    assert models.pair_areas(one_class.where("y = 5"), "x", "x", "y").collect() == []


def test_ranks_of_samples_go_along_with_their_draws(spark, tmp_path, monkeypatch):
    g = random.Random(15)
    some = lambda: float("nan") if g.random() < 0.05 else g.choice([-0.0, 0.0, 0.5, g.random(), g.random()])
    rows = [(k // 2 if k < 20 else k, [some() for _ in range(64)]) for k in range(120)] + [(500, None), (501, []), (502, [0.5] * 3), (-7, [0.25] * 62)]  # short ones are drawn, without all pairs
    rows = [(k, v and v[:62] + v[61:62] * 2 if k % 3 and len(v or []) == 64 else v) for k, v in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        want = {r[0]: tuple(v if isinstance(v, bool) else pytest.approx(v, abs=1e-9) for v in r[1:]) for r in c.execute(ORACLE["composition_driver"]).fetchall()}
    assert len(want) == 4
    for picks in (resampling.PICKS, 300):
        monkeypatch.setattr(resampling, "PICKS", picks)
        got = QUERIES["composition_driver"](spark, str(tmp_path))
        assert {r.gene: tuple(r)[1:] for r in got.collect()} == want
        # picks are summed where they are counted, in as many tasks as they call for: drawn samples are not shuffled again to meet their ranks
        assert not [line for line in plan(got).splitlines() if "Join" in line and "vec_id" in line]


def test_missing_values_of_samples_rank_last(spark, tmp_path):
    g = random.Random(16)
    rows = [(k, [None if g.random() < 0.08 else float("nan") if g.random() < 0.04 else g.random() for _ in range(64)]) for k in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        want = {r[0]: tuple(v if isinstance(v, bool) else pytest.approx(v, abs=1e-9) for v in r[1:]) for r in c.execute(ORACLE["composition_driver"]).fetchall()}
    assert {r.gene: tuple(r)[1:] for r in QUERIES["composition_driver"](spark, str(tmp_path)).collect()} == want
