"""Writers: tables, keyed progress and writes that leave equal content alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def fingerprint(df: DataFrame) -> tuple[int, int, str]:
    """Rows, xor and sum of row hashes: equal for equal bags of rows in any order."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)])
    r = df.select(h.alias("h")).agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string")).collect()[0]
    return r[0], r[1], r[2]


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Writes only where columns or rows differ from what is there, so that times of unchanged tables stay. True if written."""
    old = existing(df.sparkSession, path)
    if old is not None and sorted(old.dtypes) == sorted(df.dtypes) and fingerprint(old) == fingerprint(df):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


class Progress:
    """Results of finished steps, appended as rows under a criterion; rows of another criterion are never read, so a changed one starts anew."""

    def __init__(self, spark: SparkSession, path: str, criterion: str):
        self.spark, self.path, self.criterion = spark, path, criterion

    def done(self) -> DataFrame | None:
        t = existing(self.spark, self.path)
        return None if t is None else t.where(F.col("criterion") == self.criterion).drop("criterion")

    def add(self, rows: DataFrame) -> None:
        rows.withColumn("criterion", F.lit(self.criterion)).write.mode("append").parquet(self.path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, sep="\t")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def report_lines(df: DataFrame, layout: str, *columns: str) -> DataFrame:
    """One formatted line per row (printf layout): a report as a view of its table."""
    return df.select(F.format_string(layout, *columns).alias("line"))
