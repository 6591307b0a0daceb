"""Readers of cohort text formats. All give long tables; `file` is the input file, so that one call reads many cohorts at once.

Lines are read by Spark's text source. Compressed files are one partition each, so a study's files are the unit of parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_id, without_leading_zeros
from .tables import matrix_market


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (rises within a file) and value."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.rtrim("value").alias("value"))


def _cells(c: Column) -> Column:
    return F.transform(F.split(c, "\t"), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))


def series_matrix(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Samples (file, sample_id, title, source, attrs) and expression (file, feature_id, sample_id, value) of series matrix files.

    The key of a characteristics row is that of its first sample; of rows with one key the last counts; a cell without a colon is the value itself.
    Table columns are the samples in order where the counts agree, else they keep the names of the header. Cells that are no numbers are null.
    """
    t = lines(spark, path)
    head = t.where(F.col("value").startswith("!Sample_")).select("file", "line", _cells(F.col("value")).alias("c"))
    cells = head.select("file", "line", F.col("c")[0].alias("field"), F.col("c")[1].alias("first"), F.posexplode(F.slice("c", 2, F.size("c"))).alias("pos", "v"))
    ids = cells.where("field = '!Sample_geo_accession'").select("file", "pos", F.col("v").alias("sample_id"))
    key = F.when(F.col("field") == "!Sample_title", "_title").when(F.col("field") == "!Sample_source_name_ch1", "_source").when(F.col("field") == "!Sample_characteristics_ch1", F.trim(F.split_part("first", F.lit(":"), F.lit(1))))
    v = F.when((F.col("field") == "!Sample_characteristics_ch1") & F.contains("v", F.lit(":")), F.trim(F.expr("substring(v, instr(v, ':') + 1)"))).otherwise(F.col("v"))
    fields = cells.select("file", "pos", "line", key.alias("key"), v.alias("v")).where("key <> ''").groupBy("file", "pos", "key").agg(F.max_by("v", "line").alias("v"))
    attrs = fields.groupBy("file", "pos").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("attrs"))
    samples = ids.join(attrs, ["file", "pos"], "left")
    meta = samples.select("file", "sample_id", F.col("attrs")["_title"].alias("title"), F.col("attrs")["_source"].alias("source"), F.map_filter("attrs", lambda k, _: ~k.isin("_title", "_source")).alias("attrs"))
    rows = t.where(~F.col("value").startswith("!") & F.contains("value", F.lit("\t"))).select("file", "line", _cells(F.col("value")).alias("c"))
    header = rows.groupBy("file").agg(F.min_by("c", "line").alias("_h"), F.min("line").alias("_top"))
    n = ids.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "sample_id"))).alias("_ids"))
    names = header.join(n, "file", "left").select("file", "_top", F.when(F.size("_ids") == F.size("_h") - 1, F.transform("_ids", lambda x: x["sample_id"])).otherwise(F.slice("_h", 2, F.size("_h"))).alias("_names"))
    wide = rows.join(names, "file").where("line > _top")
    long = wide.select("file", F.col("c")[0].alias("feature_id"), F.posexplode("_names").alias("pos", "sample_id"), "c")
    return meta, long.select("file", "feature_id", "sample_id", F.expr("try_cast(get(c, pos + 1) as double)").alias("value"))


def sample_fields(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, pos, field, value of every !Sample_ row; a field that comes again is named field__2, field__3, ..."""
    head = lines(spark, path).where(F.col("value").startswith("!Sample_")).select("file", "line", _cells(F.col("value")).alias("c"))
    named = head.withColumn("_n", F.row_number().over(Window.partitionBy("file", F.col("c")[0]).orderBy("line")))
    name = F.substring(F.col("c")[0], F.lit(9), F.length(F.col("c")[0]))
    return named.select("file", F.when(F.col("_n") > 1, F.concat(name, F.lit("__"), F.col("_n"))).otherwise(name).alias("field"), F.posexplode(F.slice("c", 2, F.size("c"))).alias("pos", "value"))


def wide_table(spark: SparkSession, path: str | list[str], gene_col: str | None = None, drop: tuple[str, ...] = (), sep: str = "\t") -> DataFrame:
    """file, feature_id, column, value of tables with one column per library.

    Names are laid to cells from the right, so a header that leaves out the row index fits as well. The feature is the first cell, or gene_col.
    """
    cut = lambda c: F.transform(F.split(c, sep), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    t = lines(spark, path).where("value <> ''").select("file", "line", cut(F.col("value")).alias("c"))
    header = t.groupBy("file").agg(F.min_by("c", "line").alias("_h"), F.min("line").alias("_top"))
    rows = t.join(header, "file").where("line > _top").withColumn("_off", F.size("c") - F.size("_h"))
    gene = F.col("c")[0] if gene_col is None else F.get("c", F.array_position("_h", gene_col).cast("int") - 1 + F.col("_off"))
    long = rows.select("file", gene.alias("feature_id"), "_off", "c", F.posexplode("_h").alias("pos", "column")).where("pos + _off > 0")
    out = long.select("file", "feature_id", "column", F.expr("try_cast(get(c, pos + _off) as double)").alias("value"))
    skip = [*drop, *([gene_col] if gene_col else [])]
    return out.where(~F.col("column").isin(*skip)) if skip else out


def named_by_title(expression: DataFrame, samples: DataFrame) -> DataFrame:
    """Columns meet samples by number: the digits of the column against the part of the title before "_", leading zeros aside. Others are dropped."""
    ids = samples.select(without_leading_zeros(F.split_part("title", F.lit("_"), F.lit(1))).alias("_k"), "sample_id").groupBy("_k").agg(F.max("sample_id").alias("sample_id"))
    return expression.withColumn("_k", without_leading_zeros(F.regexp_replace("column", "[^0-9]", ""))).join(ids, "_k").drop("_k", "column")


def named_by_field(expression: DataFrame, samples: DataFrame, field: str) -> DataFrame:
    """Columns meet samples by a field of the samples: the whole name, else the name without a last "-N". Others are dropped."""
    ids = samples.select(F.col("attrs")[field].alias("_v"), F.col("sample_id").alias("_id")).where("_v is not null").groupBy("_v").agg(F.max("_id").alias("_id"))
    names = expression.select("column").distinct()
    full = names.join(ids, names["column"] == ids["_v"], "left").select("column", F.col("_id").alias("_a"), F.regexp_replace("column", r"-\d+$", "").alias("_v"))
    both = full.join(ids, "_v", "left").select("column", F.coalesce("_a", "_id").alias("sample_id")).where("sample_id is not null")
    return expression.join(both, "column").drop("column")


def soft_family(spark: SparkSession, path: str) -> DataFrame:
    """accession, field, value of the sample blocks of family files."""
    t = spark.read.text(path, lineSep="^SAMPLE").select(F.split("value", "\n").alias("l"))
    acc = F.regexp_extract(F.col("l")[0], r"^\s*=\s*(\S+)", 1)
    f = t.select(acc.alias("accession"), F.explode(F.slice("l", 2, F.size("l"))).alias("v")).where("accession <> '' and v rlike '^!Sample_'")
    return f.select("accession", F.regexp_extract("v", r"^!Sample_(\S+)", 1).alias("field"), F.trim(F.regexp_extract("v", r"=\s*(.*)$", 1)).alias("value"))


def tar_counts(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """sample_id, feature_id, count from archives of per-sample count files (plain or gz), named by the GSM id in the file name.

    Rows that begin with "__" or do not parse are dropped; a sample whose row count differs from its archive's first is dropped.
    An archive is one task, and its files are read one after the other.
    """
    import gzip
    import io
    import re
    import tarfile

    import pandas as pd

    def untar(parts):
        for part in parts:
            for raw in part["content"]:
                want = None
                with tarfile.open(fileobj=io.BytesIO(raw)) as tf:
                    for member in tf:
                        name = re.search(r"GSM\d+", member.name)
                        if not name or not member.isfile():
                            continue
                        data = tf.extractfile(member).read()
                        text = (gzip.decompress(data) if member.name.endswith(".gz") else data).decode("utf-8", "ignore")
                        rows = []
                        for line in text.splitlines()[1 if header else 0:]:
                            cells = line.strip().split("\t")
                            if len(cells) < 2 or cells[0].startswith("__"):
                                continue
                            try:
                                rows.append((cells[0].strip('"'), float(cells[1])))
                            except ValueError:
                                continue
                        want = len(rows) if want is None else want
                        if rows and len(rows) == want:
                            yield pd.DataFrame({"sample_id": name.group(), "feature_id": [r[0] for r in rows], "count": [r[1] for r in rows]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(untar, "sample_id string, feature_id string, count double")


def salmon(spark: SparkSession, root: str, headers: DataFrame | None = None) -> DataFrame:
    """sample_id, gene, count from <root>/<sample>/quant.sf; transcripts become genes by the FASTA headers (column value), gene ids stay."""
    q = spark.read.csv(f"{root}/*/quant.sf", sep="\t", header=True, schema="Name string, Length double, EffectiveLength double, TPM double, NumReads double")
    sample = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    q = q.select(sample.alias("sample_id"), base_id(F.col("Name")).alias("tx"), "NumReads")
    gene = F.when(F.col("tx").startswith("ENSG"), F.col("tx"))
    if headers is not None:
        m = headers.where(F.col("value").startswith(">")).select(F.regexp_extract("value", r"(ENST\d+)\.\d+", 1).alias("tx"), F.regexp_extract("value", r"gene:(ENSG\d+)\.\d+", 1).alias("_g")).where("tx <> '' and _g <> ''").dropDuplicates(["tx"])
        q = q.join(m, "tx", "left")
        gene = F.coalesce(gene, "_g")
    return q.withColumn("gene", gene).where("gene is not null").groupBy("sample_id", "gene").agg(F.sum("NumReads").alias("count"))


def gene_counts(wide: DataFrame) -> DataFrame:
    """Versions leave the ids of a wide table and duplicates are summed: file, feature_id, column, value."""
    return wide.withColumn("feature_id", base_id(F.col("feature_id"))).groupBy("file", "feature_id", "column").agg(F.sum("value").alias("value"))


def array_scans(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, probe, value of scanner tables (header: first cell Block): foreground less background, median per probe.

    Flagged spots (below 0) count as missing; a probe missing in an array takes its median over the arrays, one missing in all is dropped.
    """
    t = lines(spark, path).select("file", "line", _cells(F.col("value")).alias("c"))
    top = t.where("c[0] = 'Block'").groupBy("file").agg(F.min("line").alias("_top"), F.min_by("c", "line").alias("_h"))
    r = t.join(top, "file").where("line > _top and size(c) > 1")
    at = lambda name: F.get("c", F.array_position("_h", name).cast("int") - 1)
    num = lambda name: at(name).try_cast("double")
    spots = r.select("file", at("ID").alias("probe"), F.when(num("Flags") >= 0, num("F532 Median") - num("B532 Median")).alias("v"))
    med = spots.groupBy("file", "probe").agg(F.median("v").alias("v"))
    return med.withColumn("value", F.coalesce("v", F.median("v").over(Window.partitionBy("probe")))).where("value is not null").drop("v")


def platform(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """probe and symbol (the first of alternatives parted by ///) of a platform table; probes without a symbol are dropped."""
    t = lines(spark, path)
    top = t.where(F.col("value").startswith("ID\t")).groupBy("file").agg(F.min("line").alias("_top"), F.min_by(F.split("value", "\t"), "line").alias("_h"))
    r = t.join(top, "file").where((F.col("line") > F.col("_top")) & ~F.col("value").startswith("!") & (F.col("value") != "")).withColumn("c", F.split("value", "\t"))
    s = F.trim(F.split(F.get("c", F.array_position("_h", symbol).cast("int") - 1), r"\s*///\s*")[0])
    return r.select(F.col("c")[0].alias("probe"), s.alias("symbol")).where("symbol <> ''")


def section(spark: SparkSession, prefix: str) -> DataFrame:
    """gene, barcode, value of a spatial section: matrix, features, barcodes and positions (a header or none); spots in tissue alone."""
    def numbered(name):
        t = lines(spark, f"{prefix}_{name}.tsv*")
        return t.select(F.row_number().over(Window.partitionBy("file").orderBy("line")).cast("long").alias("at"), F.split("value", "\t").alias("c"))

    pos = spark.read.csv(f"{prefix}_tissue_positions.csv*").where("_c1 = '1'").select(F.col("_c0").alias("barcode"))
    m = matrix_market(spark, f"{prefix}_matrix.mtx*")
    genes, spots = numbered("features").select(F.col("at").alias("row"), F.coalesce(F.get("c", F.lit(1)), F.col("c")[0]).alias("gene")), numbered("barcodes").select(F.col("at").alias("col"), F.col("c")[0].alias("barcode"))
    return m.join(genes, "row").join(spots, "col").join(pos, "barcode", "left_semi").select("gene", "barcode", "value")


def type_sums(wide: DataFrame, types: DataFrame) -> DataFrame:
    """Sums of a genes x cells table by cell type (column, type): feature_id, type, total. The table is read once and never whole."""
    return wide.join(types, "column").groupBy("feature_id", "type").agg(F.sum("value").alias("total"))


def cohort(spark: SparkSession, path: str | list[str], label: Column) -> DataFrame:
    """Long rows (file, sample_id, feature_id, value, label) of samples that have both a label (an expression on the sample table) and values."""
    meta, expr = series_matrix(spark, path)
    return expr.join(meta.withColumn("label", label).where("label is not null").select("file", "sample_id", "label"), ["file", "sample_id"])
