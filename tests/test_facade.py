"""Studies from folders, libraries summed, scans with their sample tables."""

import gzip

import numpy as np
import pytest
from cohera.sources import facade
from pyspark.sql import functions as F

R = np.random.default_rng(3)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if path.suffix == ".gz" else text.encode())
    return path


def series(samples, features, groups, ages, sites):
    cells = lambda xs: "\t".join(f'"{x}"' for x in xs)
    lines = [f"!Sample_title\t{cells(samples)}", f"!Sample_geo_accession\t{cells(samples)}"]
    for name, xs in (("group", groups), ("age", ages), ("site", sites)):
        lines.append(f"!Sample_characteristics_ch1\t{cells(f'{name}: {x}' for x in xs)}")
    lines += ["!series_matrix_table_begin", f'"ID_REF"\t{cells(samples)}']
    lines += [f'"{f}"\t' + "\t".join(str(v) for v in vs) for f, vs in features.items()]
    return "\n".join([*lines, "!series_matrix_table_end"]) + "\n"


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "A1/matrix/A1-GPL10_series.txt.gz", series(["s1", "s2", "s3"], {"g1": [1, 5, 2], "g2": [3, 1, 9], "g3": [2, 2, 2]}, ["ALS", "control", "other"], ["60", "n/a", "50"], ["b", "a", "b"]))
    put(tmp_path / "A1/matrix/A1-GPL20_series.txt", series(["s4"], {"g1": [7], "g3": [8]}, ["ALS"], ["61"], ["c"]))
    put(tmp_path / "B2/matrix/B2_series.txt", series(["t1", "t2"], {"g1": [1, 2], "g9": [3, 4]}, ["control", "ALS"], ["1", "2"], ["x", "x"]))
    broken = gzip.compress(series(["u1"], {"g1": [1]}, ["ALS"], ["1"], ["x"]).encode() * 50)
    (tmp_path / "C3/matrix").mkdir(parents=True)
    (tmp_path / "C3/matrix/C3_series.txt.gz").write_bytes(broken[: len(broken) // 2])
    put(tmp_path / "D4/matrix/D4_series.txt", series(["v1"], {"g1": [1]}, ["other"], ["1"], ["x"]))
    return tmp_path


def study(**more):
    return facade.Study(F.when(F.col("attrs")["group"] == "ALS", 1).when(F.col("attrs")["group"] == "control", 0), "group", **more)


def test_dataset_of_platforms(spark, root):
    own = study()
    got = {(r.platform, r.sample_id, r.feature_id): (r.value, r.label) for r in facade.load_dataset(spark, str(root), "A1", own).collect()}
    assert got["GPL10", "s2", "g1"] == (5.0, 0) and got["GPL20", "s4", "g3"] == (8.0, 1) and len(got) == 8  # s3 has no label
    one = facade.load_dataset(spark, str(root), "A1", own, platform="GPL20").collect()
    assert {r.sample_id for r in one} == {"s4"}
    more = {(r.sample_id, r.feature_id): r.value for r in facade.load_dataset(spark, str(root), "A1", own, "GPL10", True).collect()}
    assert more["s1", "meta_age"] == 60.0 and more["s2", "meta_age"] is None and more["s1", "meta_site"] == 1.0 and more["s2", "meta_site"] == 0.0
    assert not any(f == "meta_group" for _, f in more)
    scored = {(r.sample_id, r.feature_id): r.value for r in facade.load_dataset(spark, str(root), "A1", study(rank_normalise=True), "GPL10").collect()}
    assert scored["s1", "g1"] < scored["s1", "g3"] < scored["s1", "g2"] and abs(scored["s1", "g3"]) < 1e-6
    for bad in ({"accession": "Z9"}, {"accession": "A1", "platform": "GPL99"}):
        with pytest.raises(FileNotFoundError):
            facade.load_dataset(spark, str(root), study=own, **bad)


def test_all_studies_with_report(spark, root):
    studies = {a: study() for a in ("A1", "B2", "C3", "D4", "E5")}
    rows, report = facade.load_all(spark, str(root), studies)
    said = {r.accession: (r.status, r.platforms, r.samples, r.features) for r in report.collect()}
    assert said == {"A1": ("loaded", 2, 3, 3), "B2": ("loaded", 0, 2, 2), "C3": ("failed", 0, 0, 0), "D4": ("empty", 0, 0, 0), "E5": ("missing", 0, 0, 0)}
    assert all(r.reason for r in report.collect() if r.status != "loaded")
    assert rows.count() == 8 + 4
    both, _ = facade.load_all(spark, str(root), studies, aligned=True)
    assert {r.feature_id for r in both.collect()} == {"g1"}
    none, report = facade.load_all(spark, str(root), {"E5": studies["E5"]})
    assert none.count() == 0 and report.count() == 1


def library(path, genes, cells, header="Donor\tRegion\tGroup\tDGE_Group", sizes=None):
    m = R.integers(0, 4, (len(genes), len(cells)))
    put(path / "row_metadata.tsv", "Gene\tid\n" + "".join(f"{g}\t{k}\n" for k, g in enumerate(genes)))
    put(path / "col_metadata.tsv", header + "\n" + "".join("\t".join(c) + "\n" for c in cells))
    at = [(i, j, m[i, j]) for i in range(len(genes)) for j in range(len(cells)) if m[i, j]]
    n = sizes or m.shape
    put(path / "counts_fil.mtx", f"%%MatrixMarket x\n% note\n{n[0]} {n[1]} {len(at)}\n" + "".join(f"{i + 1} {j + 1} {v}\n" for i, j, v in at))
    return m


def test_library_pseudobulk(spark, tmp_path):
    genes = ["a", "b", "a", "c"]
    cells = {x: [(R.choice(["d1", "d2"]), "mtx", "als", R.choice(["ex", "in", "glia"])) for _ in range(15)] for x in ("l1", "l2")}
    made = {x: library(tmp_path / x, genes, cells[x]) for x in cells}
    library(tmp_path / "mouse", genes, [("d1", "m", "w")] * 4, "Donor\tRegion\tGroup")
    want = {}
    for x, m in made.items():
        for j, (d, r, g, k) in enumerate(cells[x]):
            if k != "glia":
                w = want.setdefault((d, r, g, k), {"n": 0, "library": 0, "a": 0, "c": 0, "zz": 0})
                w["n"] += 1
                w["library"] += m[:, j].sum()
                w["a"] += m[0, j]
                w["c"] += m[3, j]
    got = {}
    for r in facade.library_pseudobulk(spark, str(tmp_path / "*"), ["a", "c", "zz"], ["ex", "in"]).collect():
        got.setdefault((r.Donor, r.Region, r.Group, r.DGE_Group), {"n": r.n, "library": r.library})[r.gene] = r.total
    assert got == want
    library(tmp_path / "bad", genes, cells["l1"], sizes=(5, 15))
    with pytest.raises(ValueError, match="bad: size line 5 15"):
        facade.library_pseudobulk(spark, str(tmp_path / "*"), ["a"], ["ex"])


def test_scans_with_their_sample_table(spark, tmp_path):
    put(tmp_path / "x.sdrf.txt", "Source\tArray Data File\tComment[a]\tComment[a]\tFactor Value[disease]\nq1\ta.gpr \t1\t2\tAmyotrophic lateral Sclerosis\nq2\tb.gpr\t1\t2\tnormal\nq3\tgone.gpr\t1\t2\tnormal\nq4\tc.gpr\t1\t2\t\n")
    head = 'ATF\t1\nnote\n"Block"\t"ID"\t"F532 Median"\t"B532 Median"\t"Flags"\n'
    put(tmp_path / "gpr/a.gpr", head + "1\tA_1\t17\t1\t0\n1\tA_1\t5\t1\t0\n1\tA_2\t9\t1\t-50\n1\tB_1\t9\t1\t0\n")
    put(tmp_path / "gpr/b.gpr", head + "1\tA_1\t3\t1\t0\n1\tA_2\t5\t1\t0\n")
    put(tmp_path / "gpr/c.gpr", head + "1\tA_2\t900\t1\t0\n")
    got = {(r.sample_id, r.feature_id): (r.value, r.label) for r in facade.scanned_cohort(spark, str(tmp_path / "x.sdrf.txt"), str(tmp_path / "gpr/*.gpr")).collect()}
    got = {k: (round(v, 9), y) for k, (v, y) in got.items()}
    assert got == {("a.gpr", "A_1"): (round(float(np.log2(10.0)), 9), 1), ("a.gpr", "A_2"): (2.0, 1), ("b.gpr", "A_1"): (1.0, 0), ("b.gpr", "A_2"): (2.0, 0)}
    with pytest.raises(FileNotFoundError):
        facade.scanned_cohort(spark, str(tmp_path / "x.sdrf.txt"), str(tmp_path / "gpr/c.gpr"))


def test_counts_labelled_by_their_columns(spark, tmp_path):
    p = put(tmp_path / "blood.txt.gz", "\tCase01\tControl01\tother\n11\t10\t0\t1\n22\t30\t5\t1\nSod1\t60\t15\t1\n")
    label = F.when(F.col("sample_id").startswith("Case"), 1).when(F.col("sample_id").startswith("Control"), 0)
    names = spark.createDataFrame([("11", "TARDBP"), ("sod1", "SOD1"), ("99", "FUS")], "feature_id string, symbol string")
    got = {(r.sample_id, r.symbol): (r.value, r.label) for r in facade.labelled_counts(spark, str(p), names, label).collect()}
    assert set(got) == {(s, g) for s in ("Case01", "Control01") for g in ("TARDBP", "SOD1")}
    assert abs(got["Case01", "SOD1"][0] - np.log1p(6e5)) < 1e-12 and got["Control01", "TARDBP"] == (0.0, 0)
