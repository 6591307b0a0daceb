"""Identity, evidence, feature search and file readers on small cases, against plain programs where SQL has no twin."""

import zipfile
from statistics import NormalDist

import numpy as np
import pytest
from cohera.operators import annotation as an
from cohera.operators import grids
from cohera.operators import resampling as rs
from cohera.plans import QUERIES
from cohera.sources import files
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rank_auc(score, y):
    a, b = score[y == 1][:, None], score[y == 0][None, :]
    return ((a > b).mean() + 0.5 * (a == b).mean()).item()


def test_symbols_and_probes(spark):
    df = spark.createDataFrame([("ENSG1",), ("A",), ("B",), ("C",), (None,)], "s string")
    hits = spark.createDataFrame([("A", "A1"), ("B", "B1"), ("B", "B2"), ("C", "C1"), ("ENSG1", "X")], "alias string, canonical string")
    curated = spark.createDataFrame([("C", "C9")], "alias string, canonical string")
    got = {r.s: r.canonical for r in an.canonical_symbols(df, "s", hits, curated).collect()}
    assert got == {"ENSG1": "ENSG1", "A": "A1", "B": "B", "C": "C9", None: None}
    h = spark.createDataFrame([("p", "+", "g"), ("q", "+", "g"), ("q", "+", "k"), ("r", "+", "k"), ("s", "-", "g"), ("t", "+", "m")], "probe string, strand string, gene string")
    told = spark.createDataFrame([("p", "g"), ("r", "z"), ("s", "x")], "probe string, symbol string")
    assert sorted(map(tuple, an.probe_genes(h, told).collect())) == [("p", "g"), ("t", "m")]
    assert an.probe_genes(h.limit(0), told).count() == 0


def test_evidence(spark):
    docs = spark.createDataFrame([(1, "SOD1 and sod1"), (2, "fus, SOD1"), (3, None), (4, "")], "d int, t string")
    terms = spark.createDataFrame([("SOD1",), ("FUS",), ("X",)], "term string")
    got = {r.term: (r.documents, r.flagged) for r in an.literature_counts(docs, "d", "t", terms, 2).collect()}
    assert got == {"SOD1": (2, True), "FUS": (1, False), "X": (0, False)}
    a = spark.createDataFrame([("g", 1, "Inhibitor"), ("g", -1, "inhibitor"), ("g", -1, "agonist"), ("g", 1, "antagonist"), ("g", 1, "binder"), ("g", None, "agonist")], "g string, way int, action string")
    assert [r[0] for r in a.select(an.restores(F.col("way"), F.col("action"))).collect()] == [True, False, True, True, None, None]
    need = spark.createDataFrame([("a", 1, 0.5), ("b", -1, 0.5), ("c", 1, 0.5)], "gene string, way int, chance double")
    s = spark.createDataFrame([("t", "a", 1), ("t", "b", -1), ("t", "c", -1), ("t", "z", 1)], "term string, gene string, way int")
    assert [tuple(r) for r in an.reversal(s, need).collect()] == [("t", 2, 1, pytest.approx(0.5))]
    assert [r.sources for r in an.with_sources({"x": need, "y": s}, "gene").orderBy("gene").collect()] == ["x+y", "x+y", "x+y", "y"]


def test_forward_selection_takes_the_best_each_time(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("label is not null").toPandas()
    x, y = np.stack(e.embedding.to_numpy()).astype(float), (e.label % 2).to_numpy()
    taken, want = [], []
    for _ in range(3):
        auc, best = max((rank_auc(x[:, [*taken, k]].sum(axis=1), y), -k) for k in range(x.shape[1]) if k not in taken)
        taken.append(-best)
        want.append((-best + 1, pytest.approx(auc, abs=1e-9)))
    assert [tuple(r) for r in QUERIES["forward_selection"](spark, SF).collect()] == want


def test_fixpoint(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").toPandas()
    while True:
        g = o.groupby("o_orderpriority").o_totalprice
        left = o[(o.o_totalprice - g.transform("mean")).abs() <= 1.8 * g.transform(lambda v: v.std(ddof=0))]
        if len(left) == len(o):
            break
        o = left
    assert {r[0] for r in QUERIES["decontamination_fixpoint"](spark, SF).select("o_orderkey").collect()} == set(o.o_orderkey)


def test_covariate_adjustment(spark):
    rng = np.random.default_rng(3)
    s, a = rng.normal(size=120), rng.normal(size=120)
    y = (s + a + rng.normal(size=120) > 0).astype(int)
    rows = [("g", int(v), float(p), float(q)) for v, p, q in zip(y, s, a)] + [("h", 1, 0.5, 0.5), ("g", None, 1.0, 1.0), ("g", 1, None, 1.0)]
    got = {r.model: r for r in grids.covariate_models(spark.createDataFrame(rows, "k string, y int, s double, a double"), ["k"], "y", "s", ["a"]).collect()}
    assert set(got) == {"score", "covariates", "both"} and got["covariates"].coefficient is None
    assert got["score"].auc == pytest.approx(rank_auc(s, y)) and got["covariates"].auc == pytest.approx(rank_auc(a, y))
    z = np.column_stack([np.ones(120), (s - s.mean()) / s.std(), (a - a.mean()) / a.std()])
    beta = np.zeros(3)
    for _ in range(20000):  # plain ascent to the maximum
        beta += 0.01 * (z.T @ (y - 1 / (1 + np.exp(-z @ beta))) - beta * [0, 1, 1])
    assert got["both"].coefficient == pytest.approx(beta[1], abs=1e-6) and got["both"].auc > max(got["score"].auc, got["covariates"].auc)


def test_stability(spark):
    rows = [(d, f, float(d % 2) * k + (d * 7 % 5) / 50, d % 2) for d in range(20) for k, f in enumerate(("none", "some", "much"))]
    got = {r.f: r.frequency for r in rs.selection_stability(spark.createDataFrame(rows, "d int, f string, v double, y int"), "d", "f", "v", "y", 1, 30).collect()}
    assert got == {"much": 1.0}


def test_files(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>title</t></is></c></row><row r="3"><c r="A3" t="s"><v>0</v></c><c r="AA3" t="s"><v>1</v></c></row><row r="4"><c r="A4"><v>7</v></c><c r="AA4" t="s"><v>2</v></c><c r="AB4"><v>9</v></c></row><row r="5"><c r="AA5"><v>1.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Donor</t></si><si><r><t>Ag</t></r><r><t>e</t></r></si><si><t>old</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = sorted(tuple(r) for r in files.workbook(spark, str(tmp_path / "t.xlsx"), "Donor").select("row", "column", "value").collect())
    assert got == [(1, "Age", "old"), (1, "Donor", "7"), (2, "Age", "1.5")]
    assert files.workbook(spark, str(tmp_path / "t.xlsx"), "absent").count() == 0
    np.save(tmp_path / "x.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    assert [r["values"] for r in files.array_rows(spark, str(tmp_path / "x.npy"), [2, 0]).orderBy("row").collect()] == [[2.0, 0.0], [5.0, 3.0], [8.0, 6.0], [11.0, 9.0]]
    (tmp_path / "r.txt").write_text("Report\n  k = 3  AUC = 0.91\n  k = 4  AUC = 0.88\n")
    assert [tuple(r) for r in files.report_fields(spark, str(tmp_path / "r.txt"), r"k = (\d+)\s+AUC = ([\d.]+)", ["k", "auc"]).collect()] == [("3", "0.91"), ("4", "0.88")]


def test_normal_scores_by_query(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").toPandas()
    g = o.groupby("o_orderpriority").o_totalprice
    want = dict(zip(o.o_orderkey, [NormalDist().inv_cdf(p) for p in g.rank() / (g.transform("size") + 1)]))
    got = {r.o_orderkey: r.score for r in QUERIES["rank_inverse_normal"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_greedy_match_by_query(spark):
    p = spark.read.parquet(f"{SF}/part.parquet").toPandas()
    want = set()
    for kind, g in p.groupby("p_type"):
        used = set()
        price = dict(zip(g.p_partkey, g.p_retailprice))
        for gene in sorted(price):
            near = [(abs(price[gene] - price[s]), s) for s in price if s != gene and s not in used and abs(price[gene] - price[s]) < 1]
            if near:
                used.add(min(near)[1])
                want.add((kind, gene, min(near)[1]))
    assert {(r.p_type, r.gene, r.substitute) for r in QUERIES["greedy_best_match"](spark, SF).collect()} == want
