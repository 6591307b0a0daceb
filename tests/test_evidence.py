"""Agreement of schemes and models, audits, grades and units left out, against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from cohera.operators import evidence as ev
from cohera.operators import stats as st
from cohera.sources import tables
from pyspark.sql import functions as F


def _tail(t, dof):
    """Two-sided tail of Student's t by the trapezium rule over an angle."""
    a = np.linspace(math.atan(abs(t) / math.sqrt(dof)), math.pi / 2, 200_001)
    f = np.cos(a) ** (dof - 1)
    part = ((f[1:] + f[:-1]) / 2 * np.diff(a)).sum()
    return 2 * part * math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)


def test_p_of_rank_correlations(spark):
    cases = [("a", 0.3, 12), ("b", -0.9, 5), ("c", 0.02, 400), ("d", 1.0, 6), ("e", -1.0, 4), ("f", 0.5, 2), ("g", None, 9), ("h", 1.0000000000000002, 8), ("i", 0.5, 3)]
    got = {r.k: r for r in ev.with_rank_p(spark.createDataFrame(cases, "k string, rho double, n long")).collect()}
    for k, rho, n in cases:
        if rho is None or n < 3:
            assert got[k].p is None and got[k].t is None
        elif abs(rho) >= 1:
            assert got[k].p == 0 and got[k].t is None
        else:
            assert got[k].p == pytest.approx(_tail(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2), rel=1e-6)


@pytest.mark.parametrize("largest", [10**6, 0])
def test_schemes_are_ranked_among_the_rows_of_both(spark, largest):
    r = random.Random(5)
    rows = [tuple(r.choice([None, *map(float, range(12))]) for _ in range(3)) + (None,) for _ in range(200)]
    df = spark.createDataFrame(rows, "u double, v double, w double, void double")
    pdf = pd.DataFrame(rows, columns=["u", "v", "w", "void"], dtype="float64")
    want = pdf.corr(method="spearman")
    got = {(x.a, x.b): x for x in ev.scheme_correlations(df, ["u", "v", "w", "void"], largest).collect()}
    assert set(got) == {("u", "v"), ("u", "w"), ("v", "w")}
    for (a, b), x in got.items():
        assert x.rho == pytest.approx(want.loc[a, b]) and x.n == (pdf[a].notna() & pdf[b].notna()).sum()


def test_gaps_and_parity(spark):
    schema = "cohort string, panel string, model string, auc double"
    rows = [("x", "p", "one", 0.9), ("x", "p", "two", 0.88), ("x", "q", "one", 0.5), ("x", "q", "two", 0.75), ("y", "p", "one", 0.75), ("y", "p", "two", 0.5), ("y", "q", "one", 0.8), (None, "p", "one", 0.6), (None, "p", "two", 0.6)]
    gaps = ev.model_gaps(spark.createDataFrame(rows, schema), ["cohort", "panel"], "model", "auc", "one", "two")
    assert {(g.cohort, g.panel): round(g.gap, 9) for g in gaps.collect()} == {("x", "p"): 0.02, ("x", "q"): -0.25, ("y", "p"): 0.25, (None, "p"): 0.0}
    assert {m.cohort: (m.cells, round(m.mean_gap, 9)) for m in ev.mean_gaps(gaps, "cohort").collect()} == {"x": (2, -0.115), "y": (1, 0.25), None: (1, 0.0)}
    one = ev.parity(gaps, ["cohort", "panel"], 0.03).first()
    assert (one.cells, one.agreeing, one.worst_cohort, one.worst_panel, one.largest_gap, one.holds) == (4, 2, "x", "q", -0.25, False)  # a tie: the least cell
    assert ev.parity(gaps.where("cohort = 'x' and panel = 'p'"), ["cohort", "panel"], 0.03).first().holds is True
    none = ev.parity(gaps.where("false"), ["cohort", "panel"]).first()
    assert (none.cells, none.agreeing, none.largest_gap, none.holds) == (0, 0, None, None)


def test_audit_has_every_class(spark):
    genes = [(1, "MIR21", "ncRNA"), (2, "TP53", "protein"), (3, None, None), (4, "ENSG0001", "protein"), (5, "KRT8P", "Processed_Pseudogene"), (6, "", "protein"), (7, "mirlet7", None), (8, "ACTB", None)]
    levels = [(1, 0.2), (1, 0.9), (2, 50.0), (3, 7.0), (4, 4.9), (5, None), (6, -1.0), (99, 3.0)]
    got = ev.audited(spark.createDataFrame(genes, "g int, symbol string, kind string"), "g", "symbol", "kind", spark.createDataFrame(levels, "g int, tpm double"), "tpm", ["Mir"], ["processed_pseudogene"])
    rows = {r.g: r for r in got.collect()}
    assert {g: r.audit for g, r in rows.items()} == {1: "artifact", 2: "clean", 3: "expressed", 4: "borderline", 5: "no_level", 6: "no_level", 7: "no_level", 8: "clean"}
    assert rows[1].highest == 0.9 and rows[2].highest is None
    assert (rows[3].by_symbol, rows[3].by_kind, rows[3].without_symbol) == (False, False, True) and rows[7].by_symbol and rows[5].by_kind


def test_grades_tiers_and_shifts(spark):
    cases = [(True, 0.01, 0.04, 1.0, "up"), (True, 0.01, 0.06, 1.0, "down"), (True, 0.01, 0.01, -1.0, "ns"), (False, 0.2, 0.3, 1.0, "down"), (True, None, None, 1.0, None), (None, 0.01, 0.01, 1.0, "up"), (True, float("nan"), 0.1, 1.0, "up")]
    df = spark.createDataFrame(cases, "up boolean, p double, q double, change double, shift string").coalesce(1)
    g = ev.grade(F.col("up"), F.col("p"), F.col("q"), F.col("change"))
    got = df.select(g.alias("g"), ev.tier(g).alias("t"), ev.shift_class(F.col("up"), F.col("shift")).alias("s")).collect()
    assert [(r.g, r.t, r.s) for r in got] == [
        ("confirmed", 1, "composition_driven"), ("suggestive", 2, "sign_reversal"), ("opposite", 3, "ambiguous"), ("none", 3, "composition_driven"),
        ("not_measured", 3, None), ("not_measured", 3, None), ("not_measured", 3, "composition_driven"),
    ]


def test_units_left_out_as_by_a_loop(spark):
    r = random.Random(9)
    samples = [(k, r.choice("abcd"), r.randint(0, 1)) for k in range(60)]
    rows = [(k, u, f, r.gauss(y * (f == "x"), 1) if f != "flat" else 0.1, y) for k, u, y in samples for f in ("x", "z", "flat") if r.random() < 0.9]
    rows += [(100, None, "x", 1.0, 1), (101, "a", "x", None, 1), (102, "a", "x", 1.0, None)]
    df = spark.createDataFrame(rows, "k int, u string, f string, v double, y int")
    got = {x.k: x.score for x in ev.leave_one_unit_out(df, "k", "u", "f", "v", "y").collect()}
    pdf = pd.DataFrame(rows, columns=["k", "u", "f", "v", "y"]).dropna()
    want = {}
    for u in pdf.u.unique():
        rest = pdf[pdf.u != u]
        w = {}
        for f, x in rest.groupby("f"):
            if x.v.nunique() > 1:
                w[f] = (x.v[x.y == 1].mean() - x.v[x.y == 0].mean()) / x.v.var(ddof=0)
        for k, x in pdf[pdf.u == u].groupby("k"):
            seen = [w[f] * v for f, v in zip(x.f, x.v, strict=True) if f in w]
            want[k] = sum(seen) if seen else None
    assert set(got) == set(want)
    for k, s in want.items():
        assert got[k] == (None if s is None else pytest.approx(s, abs=1e-8))
    assert [x.score for x in ev.leave_one_unit_out(df.where("u = 'a' and v is not null and y is not null"), "k", "u", "f", "v", "y").collect() if x.score is not None] == []


def test_welch_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 1), ("a", 2.0, 0), ("a", 2.0, 0), ("b", 1.0, 1), ("b", 1.0, 1), ("b", 1.0, 0), ("b", 1.0, 0)], "g string, v double, y int")
    assert {r.g: r.t for r in st.welch_t(df, "v", "y", ["g"]).collect()} == {"a": None, "b": None}
    got = {r.g: r.t for r in st.welch_t(df, "v", "y", ["g"], 1e-300).collect()}
    assert got["a"] == pytest.approx(-1e300) and got["b"] == 0


def test_fasta_headers_may_hold_the_sign(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b"\n>one a>b >c\nacg\ntt\n>two\r\nGG\r\nA\r\n>three\n>four\nT")
    got = {r.name: r.sequence for r in tables.fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"one": "ACGTT", "two": "GGA", "three": "", "four": "T"}
