"""Connected components over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b: long), by large-star and small-star steps.

    Each step takes minima per node, combined before the shuffle, so a node of any degree is one row; each round is written to the
    shared folder, and rounds end when nothing changes (their number grows with the logarithm of the nodes). Loops and repeated edges are harmless;
    null ends are dropped.
    """
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        stars = written(small.select("v", "m").union(low.select("u", "m")).toDF("u", "v").where("u <> v").distinct(), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
