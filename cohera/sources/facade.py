"""Whole cohorts from a folder of studies, libraries summed to pseudobulk, and scans with their sample tables.

A study lies in <root>/<accession>/matrix/, a file per platform. Paths are listed by Spark's own file source, so any store works.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.matrix import normal_scores
from .cohorts import _cells, array_scans, lines, series_matrix, wide_table

COHORT = "accession string, platform string, sample_id string, feature_id string, value double, label int"
REPORT = "accession string, status string, reason string, platforms int, samples long, features long"


class Study(NamedTuple):
    """How a study is read: the label (an expression on title, source and attrs; null leaves a sample out), the attribute that it uses up, whether values become normal scores."""

    label: Column
    field: str | None = None
    rank_normalise: bool = False


def files(spark: SparkSession, path: str) -> list[str]:
    """Paths that a glob finds; none raises FileNotFoundError."""
    try:
        found = sorted(r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect())  # files of a study
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if not found:
        raise FileNotFoundError(path)
    return found


def encoded_attributes(meta: DataFrame, prefix: str, field: str | None) -> DataFrame:
    """file, sample_id, feature_id, value: a field with any number is numbers (others null), else each value's place among the file's sorted values; the label's field is left out."""
    a = meta.select("file", "sample_id", F.explode("attrs").alias("key", "v")).where(F.col("key") != F.lit(field or ""))
    a = a.withColumn("_n", F.col("v").try_cast("double"))
    kinds = a.groupBy("file", "key").agg(F.count("_n").alias("_numbers"))
    places = a.where("v is not null").select("file", "key", "v").distinct()
    places = places.withColumn("_code", (F.row_number().over(Window.partitionBy("file", "key").orderBy("v")) - 1).cast("double"))  # values of one field
    coded = a.join(kinds, ["file", "key"]).join(places, ["file", "key", "v"], "left")
    value = F.when(F.col("_numbers") > 0, F.col("_n")).otherwise(F.col("_code"))
    return coded.select("file", "sample_id", F.concat(F.lit(f"{prefix}_"), "key").alias("feature_id"), value.alias("value"))


def load_dataset(spark: SparkSession, root: str, accession: str, study: Study, platform: str | None = None, attributes: bool = False, prefix: str = "meta") -> DataFrame:
    """accession, platform, sample_id, feature_id, value, label of all of a study's files, or of those whose name holds the platform.

    A sample needs a label and values (in the same file). Normal scores are per sample, before attributes are added. No file raises FileNotFoundError.
    """
    paths = [p for p in files(spark, f"{root}/{accession}/matrix/*.txt*") if platform is None or platform in p.rsplit("/", 1)[-1]]
    if not paths:
        raise FileNotFoundError(f"{root}/{accession}/matrix holds no file of {platform}")
    meta, expr = series_matrix(spark, paths)
    labelled = meta.withColumn("label", study.label.cast("int")).where("label is not null")
    samples = labelled.select("file", "sample_id", "label").join(expr.select("file", "sample_id").distinct(), ["file", "sample_id"])
    rows = expr.join(samples, ["file", "sample_id"])
    if study.rank_normalise:
        keyed = rows.withColumn("_key", F.concat_ws("\u0001", "file", "sample_id"))
        rows = normal_scores(keyed, "_key", "value", "_score").withColumn("value", F.col("_score")).select(*rows.columns)
    rows = rows.select("file", "sample_id", "feature_id", "value", "label")
    if attributes:
        own = labelled.join(samples.select("file", "sample_id"), ["file", "sample_id"], "left_semi")
        rows = rows.unionByName(encoded_attributes(own, prefix, study.field).join(samples, ["file", "sample_id"]).select("file", "sample_id", "feature_id", "value", "label"))
    name = F.nullif(F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(GPL\d+)", 1), F.lit(""))
    return rows.select(F.lit(accession).alias("accession"), name.alias("platform"), "sample_id", "feature_id", "value", "label")


def load_all(spark: SparkSession, root: str, studies: dict[str, Study], aligned: bool = False, attributes: bool = False, prefix: str = "meta") -> tuple[DataFrame, DataFrame]:
    """The rows of every study that can be read, and a report with a row per study: loaded, missing, empty (no labelled sample with values) or failed, with the reason.

    A study is read once to its end to be counted, so that a broken file is found here and not in what follows. With `aligned` only features that every
    loaded platform holds stay.
    """
    loaded, report = None, []
    for accession, study in studies.items():
        try:
            rows = load_dataset(spark, root, accession, study, None, attributes, prefix)
            n = rows.agg(F.count_distinct("platform").cast("int"), F.count_distinct("sample_id"), F.count_distinct("feature_id")).first()
        except FileNotFoundError as e:
            report.append((accession, "missing", str(e), 0, 0, 0))
            continue
        except PySparkException as e:
            report.append((accession, "failed", str(e).split("\n", 1)[0][:300], 0, 0, 0))
            continue
        except Exception as e:  # what a reader of files raises while running comes through py4j
            if not type(e).__module__.startswith(("py4j", "pyspark")):
                raise
            report.append((accession, "failed", str(e).split("\n", 1)[0][:300], 0, 0, 0))
            continue
        if not n[1]:
            report.append((accession, "empty", "no labelled sample has values", 0, 0, 0))
            continue
        report.append((accession, "loaded", None, *n))
        loaded = rows if loaded is None else loaded.unionByName(rows)
    out = spark.createDataFrame([], COHORT) if loaded is None else loaded
    if aligned and loaded is not None:
        held = out.select("accession", F.coalesce("platform", F.lit("")).alias("platform"), "feature_id").distinct()
        every = held.select("accession", "platform").distinct().agg(F.count("*").alias("_every"))
        shared = held.groupBy("feature_id").agg(F.count("*").alias("_n")).join(F.broadcast(every), F.col("_n") == F.col("_every")).select("feature_id")  # one row
        out = out.join(shared, "feature_id").select(*loaded.columns)
    return out, spark.createDataFrame(report, REPORT)


def library_pseudobulk(spark: SparkSession, path: str, genes: list[str], groups: list[str], keys: tuple[str, ...] = ("Donor", "Region", "Group"), group: str = "DGE_Group", matrix: str = "counts_fil.mtx") -> DataFrame:
    """keys, group, gene, total, n (cells), library (all counts of those cells), of all libraries that the glob `path` of folders finds.

    A library holds a MatrixMarket file (genes x cells) and row_metadata.tsv (Gene) and col_metadata.tsv in matrix order; one whose cells have no `group` column is left out.
    Counts are summed where triplets lie: cells and genes are joined by number, and a sum per (library, group, gene) is shuffled. A symbol that comes again counts by its first row.
    Raises ValueError where a size line and the metadata disagree. Genes that a library lacks are 0 there, as long as its cells are in a group.
    """
    library = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)

    def table(name: str) -> tuple[DataFrame, DataFrame]:
        t = lines(spark, f"{path}/{name}").where("value <> ''").withColumn("library", library)
        head = t.groupBy("library").agg(F.min("line").alias("_top"), F.min_by("value", "line").alias("_h"))
        body = t.join(head, "library").where("line > _top")
        at = F.row_number().over(Window.partitionBy("library").orderBy("line")).cast("long")  # one library's genes or cells
        return head, body.select("library", at.alias("at"), _cells(F.col("_h")).alias("_names"), _cells(F.col("value")).alias("c"))

    cell = lambda name: F.get("c", F.array_position("_names", name).cast("int") - 1)
    heads, cells = table("col_metadata.tsv")
    _, rows = table("row_metadata.tsv")
    with_groups = heads.where(F.array_contains(_cells(F.col("_h")), group)).select("library")
    t = lines(spark, f"{path}/{matrix}").where(~F.col("value").startswith("%") & (F.trim("value") != "")).withColumn("library", library).join(with_groups, "library", "left_semi")
    t = t.select("library", "line", F.split(F.trim("value"), r"\s+").alias("p"))
    first = t.groupBy("library").agg(F.min("line").alias("_first"), F.min_by("p", "line").alias("_size"))
    n_rows, n_cells = (x.groupBy("library").agg(F.count("*").alias(n)) for x, n in ((rows, "_rows"), (cells, "_cells")))
    sizes = first.join(n_rows, "library", "left").join(n_cells, "library", "left")
    wrong = sizes.where(~(F.col("_size")[0].try_cast("long").eqNullSafe(F.col("_rows")) & F.col("_size")[1].try_cast("long").eqNullSafe(F.col("_cells"))))
    bad = wrong.select("library", F.array_join("_size", " ").alias("s"), "_rows", "_cells").orderBy("library").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{b['library']}: size line {b['s']}, but {b['_rows']} rows and {b['_cells']} cells" for b in bad))
    wanted = rows.select("library", cell("Gene").alias("gene"), "at").where(F.col("gene").isin(*genes)).groupBy("library", "gene").agg(F.min("at").alias("row"))
    kept = cells.select("library", F.col("at").alias("col"), *[cell(k).alias(k) for k in (*keys, group)]).where(F.col(group).isin(*groups))
    counts = t.join(first.select("library", "_first"), "library").where("line > _first and size(p) >= 3")
    counts = counts.select("library", F.col("p")[0].cast("long").alias("row"), F.col("p")[1].cast("long").alias("col"), F.col("p")[2].cast("double").alias("v"))
    by = [*keys, group]
    met = counts.join(kept, ["library", "col"]).join(wanted, ["library", "row"], "left")
    totals = met.groupBy(*by, "gene").agg(F.sum("v").alias("total"))
    whole = totals.groupBy(*by).agg(F.sum("total").alias("library"))
    frame = kept.groupBy(*by).agg(F.count("*").alias("n")).select("*", F.explode(F.array(*[F.lit(g) for g in genes])).alias("gene"))
    same = lambda x, y, names: [x[k].eqNullSafe(y[k]) for k in names]
    out = frame.join(totals, same(frame, totals, [*by, "gene"]), "left").select(*[frame[k] for k in by], frame["gene"], frame["n"], totals["total"])
    out = out.join(whole, same(out, whole, by), "left").select(*[out[k] for k in by], out["gene"], out["n"], out["total"], whole["library"])
    return out.select(*by, "gene", F.coalesce("total", F.lit(0.0)).alias("total"), "n", F.coalesce("library", F.lit(0.0)).alias("library"))


def sample_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A table of samples and data files, one line a sample: the columns named by their headers (of equal headers the first), trimmed; empty cells are null."""
    t = lines(spark, path).where("value <> ''").select("file", "line", _cells(F.col("value")).alias("c"))
    head = t.groupBy("file").agg(F.min("line").alias("_top"), F.min_by("c", "line").alias("_h"))
    at = lambda name: F.nullif(F.get("c", F.array_position("_h", name).cast("int") - 1), F.lit(""))
    return t.join(head, "file").where("line > _top").select(*[at(v).alias(k) for k, v in columns.items()])


def scanned_cohort(spark: SparkSession, samples: str, scans: str, file_col: str = "Array Data File", label_col: str = "Factor Value[disease]", pattern: str = "sclerosis", probes: str = "A_") -> DataFrame:
    """sample_id (the scan's file name), feature_id (probe), value (log2, at least 0), label: scans that the sample table names, labelled by a pattern in any case.

    Probes begin with `probes`; a probe missing in an array takes its median over the named arrays.
    """
    table = sample_table(spark, samples, {"sample_id": file_col, "_what": label_col}).where("sample_id is not null and _what is not null")
    table = table.select("sample_id", F.col("_what").rlike(f"(?i){pattern}").cast("int").alias("label")).dropDuplicates(["sample_id"])
    paths = files(spark, scans)
    named = {r[0] for r in table.select("sample_id").collect()}  # arrays of a study
    chosen = [p for p in paths if p.rsplit("/", 1)[-1] in named]
    if not chosen:
        raise FileNotFoundError(f"no scan of {scans} is in {samples}")
    values = array_scans(spark, chosen).where(F.col("probe").startswith(probes)).withColumn("sample_id", F.element_at(F.split("file", "/"), -1))
    return values.join(table, "sample_id").select("sample_id", F.col("probe").alias("feature_id"), F.log2(F.greatest("value", F.lit(1.0))).alias("value"), "label")


def labelled_counts(spark: SparkSession, path: str, symbols: DataFrame, label: Column, gene_col: str | None = None, drop: tuple[str, ...] = (), sep: str = "\t") -> DataFrame:
    """sample_id, symbol, value (log of one more than counts a million), label of a counts table whose labels lie in its column names (label: an expression on sample_id; null drops a column).

    symbols (feature_id, symbol) says which features are wanted under which name: identifiers of another kind, or symbols themselves; they meet in any case of letters. Libraries are
    sums over all features. Of several rows of one wanted feature the first counts.
    """
    wide = wide_table(spark, path, gene_col, drop, sep).withColumnRenamed("column", "sample_id")
    size = wide.groupBy("file", "sample_id").agg(F.sum("value").alias("_library"))
    names = symbols.select(F.lower(F.trim(F.col("feature_id").cast("string"))).alias("_key"), "symbol").distinct()
    met = wide.withColumn("_key", F.lower(F.trim("feature_id"))).join(names, "_key").join(size, ["file", "sample_id"])
    one = met.groupBy("file", "sample_id", "symbol", "_library").agg(F.min_by("value", F.struct("_key", "feature_id")).alias("value"))
    out = one.withColumn("label", label.cast("int")).where("label is not null")
    return out.select("sample_id", "symbol", F.log1p(F.try_divide(F.col("value") * 1e6, F.col("_library"))).alias("value"), "label")
