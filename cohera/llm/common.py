"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # of an Arrow batch; one longer text is a batch of its own
HOT_SHARES, SALTS = 1024, 64
TOKENIZER_DIR = None  # None: the installed public_tokenizers; else a folder that every executor has


def vocabulary(name: str) -> str:
    return f"{TOKENIZER_DIR}/{name}" if TOKENIZER_DIR else public_tokenizers.path(name)


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches, bounded in bytes as well: whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local one only in local mode where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/cohera-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: this cuts lineage and survives lost executors."""
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def picked(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns cannot clash."""
    return docs.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def crc32_text(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def by_characters(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of texts that hold about `most` characters each; a longer text stands alone."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def join_salted(left: DataFrame, right: DataFrame, key: list[str], count: str, spread: list[str], total: int) -> DataFrame:
    """left joined to right on key, where right has one row or few a key, with `count`, how many of left's `total` rows (or fewer) hold it.

    Keys with more than a HOT_SHARES-th of left's rows, of which there are fewer than HOT_SHARES, are dealt over SALTS tasks by the columns
    `spread`; their rows of right are copied that often. No task gets more of one key than that share or a SALTS-th of the key.
    """
    most = max(SALTS, total // HOT_SHARES)
    hot = F.broadcast(right.where(F.col(count) > most).select(*key).distinct().withColumn("_hot", F.lit(True)))  # fewer than HOT_SHARES rows
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = left.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col(count) > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(copies)).drop(count), [*key, "_salt"]).drop("_salt")
