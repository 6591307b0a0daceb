"""Hand-checked cases of the statistics and matrix operators."""

import pytest
from cohera.functions import text
from cohera.operators import matrix, relational, stats
from pyspark.sql import functions as F


def test_auc_with_ties(spark):
    rows = [("a", 1, 3.0), ("a", 1, 2.0), ("a", 1, 2.0), ("a", 0, 2.0), ("a", 0, 1.0), ("a", 0, 0.0), ("b", 1, 1.0), ("b", 1, None), ("b", None, 4.0)]
    got = {r.g: r for r in stats.two_group_auc(spark.createDataFrame(rows, "g string, y int, x double"), "x", "y", ["g"]).collect()}
    assert got["a"].auc == pytest.approx(8 / 9)
    assert got["a"].rank_biserial == pytest.approx(7 / 9)
    assert got["b"].auc is None


def test_hedges_and_meta(spark):
    rows = [(1, float(x)) for x in (5, 6, 7, 8)] + [(0, float(x)) for x in (4, 5, 5, 6)]
    r = stats.hedges(spark.createDataFrame(rows, "y int, x double"), "x", "y", []).first()
    assert (r.g, r.v) == (pytest.approx(1.207591, abs=1e-6), pytest.approx(0.591142, abs=1e-6))
    e = spark.createDataFrame([("f", 0.5, 0.04), ("f", 0.8, 0.09), ("f", 0.2, 0.05)], "f string, g double, v double")
    m = stats.random_effects(e, "g", "v", ["f"]).first()
    assert [m.fixed, m.q, m.tau2, m.pooled, m.se, m.i2] == pytest.approx([0.452475, 2.673267, 0.018889, 0.460676, 0.156785, 0.251852], abs=1e-6)


def test_welch(spark):
    rows = [(1, 3.0), (1, 5.0), (1, 9.0), (0, 1.0), (0, 2.0), (0, 2.0)]
    assert stats.welch_t(spark.createDataFrame(rows, "y int, x double"), "x", "y", []).first().t == pytest.approx(2.228344, abs=1e-6)


def test_step_up_is_monotone(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.021,), (None,)], "p double")
    assert [r.q for r in stats.adjusted(df, "p").orderBy(F.asc_nulls_last("p")).collect()] == [pytest.approx(0.021)] * 3 + [None]


def test_calibration(spark):
    df = spark.createDataFrame([(0.05, 0), (0.15, 0), (0.15, 1), (0.95, 1), (1.0, 1)], "s double, y int")
    assert stats.calibration_error(df, "s", "y").first().ece == pytest.approx(0.16)
    assert stats.brier_log_loss(df, "s", "y").first().brier == pytest.approx(0.15)
    got = {r.threshold: r for r in stats.decision_curve(df, "s", "y", [0.2, 0.5]).collect()}
    assert [got[0.2].net_benefit, got[0.5].net_benefit, got[0.2].treat_all, got[0.5].treat_all] == pytest.approx([0.4, 0.4, 0.5, 0.2])


def test_quantile_normalise(spark):
    rows = [("a", k, float(v)) for k, v in enumerate((5, 2, 3))] + [("b", k, float(v)) for k, v in enumerate((4, 1, 6))]
    got = matrix.quantile_normalise(spark.createDataFrame(rows, "c string, k int, v double"), "v", "c", "k").orderBy("c", "k").collect()
    assert [r.normalised for r in got] == [5.5, 1.5, 3.5, 3.5, 1.5, 5.5]


def test_guards(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "g string, x double")
    assert [r.z for r in matrix.z_within(df, "x", ["g"]).collect()] == [0.0, 0.0]
    gains = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 15.0), ("d", 4.0), ("e", 1.0)], "f string, g double")
    assert [matrix.cumulative_gain(gains, "f", "g", x).count() for x in (0.99, 0.8)] == [4, 2]
    assert matrix.z_within(df.limit(0), "x", ["g"]).count() == 0


def test_relational(spark):
    left, right = spark.createDataFrame([("a.1", "a"), ("b.2", "b")], "full string, base string"), spark.createDataFrame([("a.1", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert {r.full: r.v for r in relational.fallback_join(left, right, "full", "base", "k", "v").collect()} == {"a.1": 1, "b.2": 3}
    r = spark.createDataFrame([("000", "AACG", "e.12")], "z string, s string, i string")
    assert r.select(text.without_leading_zeros(F.col("z")), text.reverse_complement(F.col("s")), text.base_id(F.col("i"))).first()[:] == ("0", "CGTT", "e")
