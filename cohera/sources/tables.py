"""Readers that give long tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows from the shared checkpoint folder of the session, without their lineage; a folder of its own only in local mode where none is named (tests)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return df.checkpoint()


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """term, direction and gene of lines "term<TAB>description<TAB>gene<TAB>..."; a last word Up or Down is the direction."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") > 2)
    name = F.col("p")[0]
    way = F.regexp_extract(name, r" (Up|Down)$", 1)
    return parts.select(F.regexp_replace(name, r" (Up|Down)$", "").alias("term"), F.nullif(way, F.lit("")).alias("direction"), F.explode(F.slice("p", 3, F.size("p"))).alias("gene")).where("gene <> ''")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """row, col, value (from 1) of coordinate files; each file's comments and size line (its first after them) are dropped."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("_at"))
    t = t.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"), "_file", "_at")
    first = t.groupBy("_file").agg(F.min("_at").alias("_first"))
    rows = t.join(first, "_file").where("_at > _first and size(p) = 3")
    return rows.select(F.col("p")[0].cast("long").alias("row"), F.col("p")[1].cast("long").alias("col"), F.expr("try_cast(p[2] as double)").alias("value"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name and sequence of each record. A record begins at a line's first sign, so its header may hold > too."""
    t = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where("trim(value) <> ''")
    lines = F.split("value", "\n")
    return t.select(F.split(lines[0], r"\s")[0].alias("name"), F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), r"\s", "")).alias("sequence"))
