"""A corpus pipeline: quality, line dedup, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed pieces. Rules for nulls,
empty texts and repeated rows are those of the operators; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohera.llm import jaccard, lines, packing, pii, quality
from cohera.llm.common import table, written

SIMILAR_WORDS, SIMILAR_PERCENT = 5, 80
ORACLE_SQL = None  # a learnt model and a tokenizer decide; tests hold each stage against a plain version


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    return docs.where(quality.score_of(F.col("text"), quality.fit(docs, labels)) >= 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that have come before."""
    return _counted(lines.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of least doc_id; documents without words or doc_id stay.

    Rows that share that doc_id but not the text all stay, and of rows that share both one stays (the one of least hash over its columns).
    """
    found = jaccard.jaccard_join(docs, SIMILAR_WORDS, SIMILAR_PERCENT)
    first = docs.join(found.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = first.groupBy("doc_id", F.sha2("text", 256).alias("_text_key")).agg(F.min_by(row, F.xxhash64(row)).alias("_row"))
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns]).union(docs.where("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with <EMAIL>, <IP>, <CARD> and <PHONE> for what the field finds."""
    return _counted(pii.mask(docs, pii.fit(docs)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
