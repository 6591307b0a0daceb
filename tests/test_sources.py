"""Tiny files of every cohort format, and the writers."""

import gzip
import io
import os
import tarfile

import pytest
from cohera.operators import relational
from cohera.sources import cohorts, sinks
from pyspark.sql import functions as F

SERIES = """!Series_title\t"x"
!Sample_title\t"01_case"\t"2_ctl"
!Sample_geo_accession\t"GSM1"\t"GSM2"
!Sample_source_name_ch1\t"cord"\t"cord"
!Sample_characteristics_ch1\t"group: ALS: sporadic"\t"group: Control"
!Sample_characteristics_ch1\t"age: 60"\t"unknown"
!series_matrix_table_begin
"ID_REF"\t"a"\t"b"
"p1"\t1.5\t2
"p2"\tNA\t4
!series_matrix_table_end
"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if path.suffix == ".gz" else text.encode())
    return str(path)


@pytest.fixture
def series(tmp_path):
    return put(tmp_path / "s_series_matrix.txt.gz", SERIES)


def test_series_matrix(spark, series):
    meta, expr = cohorts.series_matrix(spark, series)
    m = {r.sample_id: r for r in meta.collect()}
    assert m["GSM1"].attrs == {"group": "ALS: sporadic", "age": "60"}
    assert (m["GSM1"].title, m["GSM1"].source, m["GSM2"].attrs["age"]) == ("01_case", "cord", "unknown")
    assert {(r.feature_id, r.sample_id): r.value for r in expr.collect()} == {("p1", "GSM1"): 1.5, ("p1", "GSM2"): 2.0, ("p2", "GSM1"): None, ("p2", "GSM2"): 4.0}


def test_sample_fields_and_cohort(spark, series):
    names = {r.field for r in cohorts.sample_fields(spark, series).collect()}
    assert names == {"title", "geo_accession", "source_name_ch1", "characteristics_ch1", "characteristics_ch1__2"}
    label = relational.ordered_labels(F.col("attrs")["group"], [("als", 1), ("cont", 0)])
    assert {(r.sample_id, r.label) for r in cohorts.cohort(spark, series, label).collect()} == {("GSM1", 1), ("GSM2", 0)}


def test_wide_table_and_names(spark, tmp_path, series):
    meta, _ = cohorts.series_matrix(spark, series)
    short = put(tmp_path / "w.tsv", "lib-001a\t002b-2\tlen\ng1.2\t5\t6\t9\ng1.3\t1\t1\t9\n")
    w = cohorts.wide_table(spark, short, drop=("len",))
    assert {(r.feature_id, r.column, r.value) for r in w.collect()} == {("g1.2", "lib-001a", 5.0), ("g1.2", "002b-2", 6.0), ("g1.3", "lib-001a", 1.0), ("g1.3", "002b-2", 1.0)}
    assert {(r.column, r.value) for r in cohorts.gene_counts(w).collect()} == {("lib-001a", 6.0), ("002b-2", 7.0)}
    assert {r.sample_id for r in cohorts.named_by_title(w, meta).collect()} == {"GSM1"}
    by = spark.createDataFrame([("GSM9", {"alt": "002b"})], "sample_id string, attrs map<string,string>")
    assert {(r.sample_id, r.value) for r in cohorts.named_by_field(w, by, "alt").collect()} == {("GSM9", 6.0), ("GSM9", 1.0)}
    named = put(tmp_path / "n.tsv", "\tgene\tx\n0\tA\t3\n1\tB\t4\n")
    assert {(r.feature_id, r.column, r.value) for r in cohorts.wide_table(spark, named, gene_col="gene").collect()} == {("A", "x", 3.0), ("B", "x", 4.0)}
    types = spark.createDataFrame([("lib-001a", "t"), ("002b-2", "t")], "column string, type string")
    assert {(r.feature_id, r.total) for r in cohorts.type_sums(w, types).collect()} == {("g1.2", 11.0), ("g1.3", 2.0)}


def test_soft(spark, tmp_path):
    p = put(tmp_path / "f.soft", "^DATABASE = x\n!Database_name = y\n^SAMPLE = GSM7\n!Sample_title = a = b\n!Sample_type = RNA\n^SAMPLE = GSM8\n!Sample_title = c\n")
    assert {tuple(r) for r in cohorts.soft_family(spark, p).collect()} == {("GSM7", "title", "a = b"), ("GSM7", "type", "RNA"), ("GSM8", "title", "c")}


def test_tar_counts(spark, tmp_path):
    with tarfile.open(tmp_path / "r.tar", "w") as tf:
        for name, text in (("GSM1_a.txt.gz", "g\tn\nA\t1\nB\t2\n__no_feature\t9\n"), ("GSM2.txt", "g\tn\nA\t3\nB\tx\n"), ("GSM3.txt", "g\tn\nA\t5\nB\t6\n"), ("readme", "x")):
            raw = gzip.compress(text.encode()) if name.endswith("gz") else text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tf.addfile(info, io.BytesIO(raw))
    assert {tuple(r) for r in cohorts.tar_counts(spark, str(tmp_path / "r.tar")).collect()} == {("GSM1", "A", 1.0), ("GSM1", "B", 2.0), ("GSM3", "A", 5.0), ("GSM3", "B", 6.0)}


def test_salmon(spark, tmp_path):
    for s, n in (("s1", 3), ("s2", 4)):
        put(tmp_path / "q" / s / "quant.sf", f"Name\tLength\tEffectiveLength\tTPM\tNumReads\nENST1.1\t10\t9\t1\t{n}\nENST2.3\t10\t9\t1\t1\nENST9.1\t1\t1\t1\t7\nENSG5.1\t1\t1\t1\t2\n")
    fa = put(tmp_path / "t.fa", ">ENST1.1 cdna gene:ENSG1.4 x\nACGT\n>ENST2.3 cdna gene:ENSG1.4\nAC\n")
    got = {tuple(r) for r in cohorts.salmon(spark, str(tmp_path / "q"), spark.read.text(fa)).collect()}
    assert got == {("s1", "ENSG1", 4.0), ("s2", "ENSG1", 5.0), ("s1", "ENSG5", 2.0), ("s2", "ENSG5", 2.0)}


def test_arrays_and_platform(spark, tmp_path):
    head = 'ATF\t1\n"Block"\t"ID"\t"F532 Median"\t"B532 Median"\t"Flags"\n'
    put(tmp_path / "g" / "a.gpr", head + "1\tp\t10\t1\t0\n1\tp\t20\t1\t0\n1\tq\t9\t1\t-50\n1\tz\t1\t1\t-1\n")
    put(tmp_path / "g" / "b.gpr", head + "1\tp\t5\t1\t0\n1\tq\t7\t1\t0\n1\tz\t1\t1\t-1\n")
    got = {(os.path.basename(r.file), r.probe, r.value) for r in cohorts.array_scans(spark, str(tmp_path / "g")).collect()}
    assert got == {("a.gpr", "p", 14.0), ("a.gpr", "q", 6.0), ("b.gpr", "p", 4.0), ("b.gpr", "q", 6.0)}
    p = put(tmp_path / "GPL.txt", "#x\nID\tSYM\tN\np1\tA /// B\t1\np2\t\t1\np3\tC\n!end\n")
    assert {tuple(r) for r in cohorts.platform(spark, p, "SYM").collect()} == {("p1", "A"), ("p3", "C")}


def test_section(spark, tmp_path):
    at = str(tmp_path / "x")
    put(tmp_path / "x_matrix.mtx", "%%MatrixMarket\n2 2 3\n1 1 5\n2 1 6\n2 2 7\n")
    put(tmp_path / "x_features.tsv", "E1\tA\nE2\tB\n")
    put(tmp_path / "x_barcodes.tsv", "bc1\nbc2\n")
    put(tmp_path / "x_tissue_positions.csv", "barcode,in_tissue,r\nbc1,1,0\nbc2,0,0\n")
    assert {tuple(r) for r in cohorts.section(spark, at).collect()} == {("A", "bc1", 5.0), ("B", "bc1", 6.0)}


def test_sinks(spark, tmp_path):
    df, path = spark.range(5).withColumn("x", F.lit("a")), str(tmp_path / "t")
    assert sinks.write_if_changed(df, path)
    assert not sinks.write_if_changed(df.orderBy(F.desc("id")), path)
    assert sinks.write_if_changed(df.where("id < 4"), path)
    p = sinks.Progress(spark, str(tmp_path / "p"), "auc")
    assert p.done() is None
    p.add(df)
    assert p.done().count() == 5
    assert sinks.Progress(spark, str(tmp_path / "p"), "other").done().count() == 0
    assert sinks.report_lines(df.limit(1), "%5d %s", "id", "x").first().line == "    0 a"
