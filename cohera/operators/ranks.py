"""Ranks, running sums and quantiles within groups of any size.

A group of at most `largest` rows is ordered by one window task. Where any group is larger, values are cut into ranges of about equal
size at approximate quantiles (as many ranges as there are shuffle partitions; the driver sees the cuts alone), each range is
ordered by itself, and the sums of a group's earlier ranges, one row per range, are added. So no task orders more than a range
of one group, however few groups there are, and both ways give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

LARGEST = 200_000  # rows of a group that one task may order
MOST_RANGES = 512


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls being equal; without keys right is one row."""
    if not keys:
        return left.join(F.broadcast(right))
    other = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_key_{k}" for k in keys])


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group. This runs df: where several ranks are taken of the same rows, count once and pass the number on as `size`."""
    return (df.groupBy(*by).count().agg(F.max("count")).first()[0] if by else df.count()) or 0


def _range_of(v: Column, cuts: list[float]) -> Column:
    """The number of cuts that v reaches, by halving."""

    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(v < cuts[mid], search(a, mid)).otherwise(search(mid + 1, b))

    return search(0, len(cuts))


def with_ranges(df: DataFrame, value: str, out: str = "_range") -> DataFrame:
    n = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    v = F.col(value).cast("double")
    cuts = df.agg(F.percentile_approx(v, F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(10_000))).first()[0] if n > 1 else []
    return df.withColumn(out, F.when(v.isNull(), -1).otherwise(_range_of(v, sorted(set(cuts or [])))))


def running(df: DataFrame, value: str, by: list[str], sums: list[str], descending: bool = False, tie: list[str] | None = None, largest: int = LARGEST, size: int | None = None) -> DataFrame:
    """Adds, for each column of sums, <column>_before: its sum over the group's rows before this one in order of value and tie."""
    way = F.desc if descending else F.asc
    order = [way(value), *(tie or [])]
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if (largest_group(df, by) if size is None else size) <= largest:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns({f"{c}_before": earlier(w, c) for c in sums})
    rows = with_ranges(df, value)
    inner = Window.partitionBy(*by, "_range").orderBy(*order)
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    outer = Window.partitionBy(*by).orderBy(way("_range"))  # a row per range
    totals = totals.select(*by, "_range", *[earlier(outer, c).alias(f"_{c}_ranges") for c in sums])
    out = joined(rows.withColumns({f"_{c}_inner": earlier(inner, c) for c in sums}), totals, [*by, "_range"])
    return out.select(*df.columns, *[(F.col(f"_{c}_inner") + F.col(f"_{c}_ranges")).alias(f"{c}_before") for c in sums])


def row_numbers(df: DataFrame, value: str, by: list[str], tie: list[str], out: str, descending: bool = False, largest: int = LARGEST, size: int | None = None) -> DataFrame:
    """Numbers from 1 in order of value and tie within the groups."""
    got = running(df.withColumn("_one", F.lit(1).cast("long")), value, by, ["_one"], descending, tie, largest, size)
    return got.withColumn(out, F.col("_one_before") + 1).drop("_one", "_one_before")


def with_midrank(df: DataFrame, value: str, by: list[str], out: str = "midrank", largest: int = LARGEST, size: int | None = None) -> DataFrame:
    """Average rank of value within the groups; null values have no rank."""
    if (largest_group(df, by) if size is None else size) <= largest:
        w = Window.partitionBy(*by, F.col(value).isNull()).orderBy(value)
        ties = Window.partitionBy(*by, value)
        return df.withColumn(out, F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count("*").over(ties) - 1) / F.lit(2.0)))
    return joined(df, midranks(df.withColumn("_one", F.lit(1).cast("long")), value, by, "_one", out, largest), [*by, value], "left")


def midranks(df: DataFrame, value: str, by: list[str], times: str, out: str, largest: int = LARGEST) -> DataFrame:
    """by, value and the average rank of each distinct value, rows counting `times`; null values have none. Distinct values are written once, so df is read once."""
    counts = checkpointed(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(times).alias("_t")))
    ranks = running(counts, value, by, ["_t"], largest=largest)  # distinct values: their own number
    return ranks.select(*by, value, (F.col("_t_before") + (F.col("_t") + 1) / F.lit(2.0)).alias(out))


def quantiles(df: DataFrame, value: str, by: list[str], at: list[float], largest: int = LARGEST) -> DataFrame:
    """by, q0, q1, ...: exact quantiles with linear interpolation, nulls left out; a group without values has no row."""
    rows = df.where(F.col(value).isNotNull())
    if largest_group(rows, by) <= largest:
        g = rows.groupBy(*by).agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in at])).alias("_q"), F.count("*").alias("_n"))
        return g.where("_n > 0").select(*by, *[F.col("_q")[k].alias(f"q{k}") for k in range(len(at))])
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_t"))
    places = joined(running(counts, "_v", by, ["_t"], largest=largest), counts.groupBy(*by).agg(F.sum("_t").alias("_n")), by)
    aggs = []
    for k, p in enumerate(at):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        for side, i in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggs.append(F.max(F.when((F.col("_t_before") <= i) & (i < F.col("_t_before") + F.col("_t")), F.col("_v"))).alias(f"_{side}{k}"))
    g = places.groupBy(*by).agg(F.max("_n").alias("_n"), *aggs)
    part = [F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1)) for p in at]
    return g.select(*by, *[(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * x).alias(f"q{k}") for k, x in enumerate(part)])
