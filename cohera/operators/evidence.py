"""Agreement of models and of weighting schemes, audits of flagged features, grades of evidence, units left out one at a time."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import spearman, student_t_p


def with_rank_p(found: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Adds t and the two-sided p of a rank correlation on n - 2 degrees of freedom.

    A correlation of 1 or -1 has no t and a p of 0; below three rows, or where rho is null, both are null.
    """
    r, dof = F.greatest(F.least(F.col(rho), F.lit(1.0)), F.lit(-1.0)), F.col(n) - 2
    inside = F.col(rho).isNotNull() & (dof >= 1)
    out = found.withColumn("t", F.when(inside & (F.abs(r) < 1), r * F.sqrt(dof / ((1 + r) * (1 - r)))))
    return out.withColumn("p", F.when(inside & (F.abs(r) >= 1), 0.0).otherwise(student_t_p(F.col("t"), dof.cast("double"))))


def scheme_correlations(df: DataFrame, schemes: list[str], largest: int | None = None) -> DataFrame:
    """a, b, n, rho: rank correlation of every two columns, over the rows that have both.

    Ranks are taken among the rows of the pair, so each pair is a group of its own; all pairs come from one reading of df.
    Pairs without common rows are absent.
    """
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    rows = df.select(F.explode(F.array(*[pair(a, b) for a, b in combinations(schemes, 2)])).alias("_p")).select("_p.*")
    return spearman(rows, "x", "y", ["a", "b"], **({} if largest is None else {"largest": largest}))


def model_gaps(results: DataFrame, cell: list[str], model: str, metric: str, first: str, second: str) -> DataFrame:
    """cell and gap: the metric of the first model less that of the second, where both have one (means, if a cell has several)."""
    of = lambda m: F.avg(F.when(F.col(model) == m, F.col(metric)))
    return results.groupBy(*cell).agg((of(first) - of(second)).alias("gap")).where("gap is not null")


def mean_gaps(gaps: DataFrame, cohort: str) -> DataFrame:
    """Per cohort: its cells and their mean gap."""
    return gaps.groupBy(cohort).agg(F.count("*").alias("cells"), F.avg("gap").alias("mean_gap"))


def parity(gaps: DataFrame, cell: list[str], within: float = 0.02) -> DataFrame:
    """One row: cells, those whose gap is at most `within`, the largest gap with its cell (worst_*), and whether parity holds throughout.

    Of cells with equally large gaps the least is named; without cells there is no verdict (null).
    """
    worst = F.min_by(F.struct(*cell, "gap"), F.struct((-F.abs("gap")).alias("_off"), *cell))
    one = gaps.agg(F.count("*").alias("cells"), F.count(F.when(F.abs("gap") <= within, 1)).alias("agreeing"), worst.alias("_w"))
    return one.select("cells", "agreeing", *[F.col("_w")[c].alias(f"worst_{c}") for c in cell], F.col("_w")["gap"].alias("largest_gap"), F.when(F.col("cells") > 0, F.col("agreeing") == F.col("cells")).alias("holds"))


def audited(features: DataFrame, key: str, symbol: str, kind: str, levels: DataFrame, level: str, prefixes: list[str], suspects: list[str], unnamed: str = "ENSG", low: float = 1.0, high: float = 5.0) -> DataFrame:
    """features with by_symbol, by_kind, without_symbol (flags), highest (of flagged ones: their highest level) and audit, their class.

    Flags: a prefix of the symbol (any case), a suspect kind (any case), no symbol or a stable id (`unnamed`) in its place. Classes: clean;
    of flagged features no_level (none known, or negative), artifact (highest below low), borderline (below high), expressed.
    Levels of features that are not flagged are left out before they are grouped.
    """
    s, k = F.coalesce(F.upper(F.col(symbol)), F.lit("")), F.lower(F.col(kind))
    by_symbol = F.lit(False)
    for p in prefixes:
        by_symbol = by_symbol | s.startswith(p.upper())
    bare = F.coalesce(F.col(symbol), F.lit(""))
    told = features.withColumns({"by_symbol": by_symbol, "by_kind": F.coalesce(k.isin([x.lower() for x in suspects]), F.lit(False)), "without_symbol": (bare == "") | bare.startswith(unnamed)})
    flagged = F.col("by_symbol") | F.col("by_kind") | F.col("without_symbol")
    asked = told.where(flagged).select(key)
    highest = levels.join(asked, key, "left_semi").groupBy(key).agg(F.max(level).alias("highest"))
    out = told.join(highest, key, "left")
    h = F.col("highest")
    return out.withColumn("audit", F.when(~flagged, "clean").when(h.isNull() | (h < 0), "no_level").when(h < low, "artifact").when(h < high, "borderline").otherwise("expressed"))


def grade(up: Column, p: Column, q: Column, change: Column, level: float = 0.05) -> Column:
    """Grade of a second test of a feature whose direction is known: confirmed, suggestive, opposite, none or not_measured."""
    known = up.isNotNull() & p.isNotNull() & ~F.isnan(p)
    return F.when(~known, "not_measured").when(p >= level, "none").when((change > 0) != up, "opposite").when(q < level, "confirmed").otherwise("suggestive")


def tier(grade_: Column) -> Column:
    """1 for confirmed, 2 for suggestive, 3 for all other grades."""
    return F.when(grade_ == "confirmed", 1).when(grade_ == "suggestive", 2).otherwise(3)


def shift_class(up: Column, shift: Column) -> Column:
    """How a feature's direction stands to the shift (up, down, ns) of the part that it belongs to; null where either is null."""
    return F.when(shift == "ns", "ambiguous").when(up != (shift == "up"), "sign_reversal").when(up == (shift == "up"), "composition_driven")


def leave_one_unit_out(df: DataFrame, sample: str, unit: str, feature: str, value: str, label: str) -> DataFrame:
    """sample, label, score: every unit's samples scored by what all other units teach, a sum of standardised values weighted by the
    classes' difference of means.

    A unit's own sums are taken off the totals, so any number of units costs one grouping and no fit per unit. Features that do not
    vary, or lack a class, among the others weigh nothing; a sample without any other has a null score. Rows that lack a unit, a
    value or a label (0 or 1) are left out.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in (sample, unit, feature, value, label))).select(sample, unit, feature, F.col(value).cast("double").alias("_v"), F.col(label).cast("int").alias(label))
    v, y = F.col("_v"), F.col(label)
    own = rows.groupBy(unit, feature).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.sum(y).alias("n1"), F.sum(v * y).alias("s1"))
    sums = ("n", "s", "q", "n1", "s1")
    total = own.groupBy(feature).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    rest = own.join(total, feature).select(unit, feature, *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in sums])
    mean = F.try_divide(F.col("s"), F.col("n"))
    square = F.try_divide(F.col("q"), F.col("n"))
    varies = F.when(square - mean * mean > 1e-12 * square, square - mean * mean)  # less is rounding
    apart = F.try_divide(F.col("s1"), F.col("n1")) - F.try_divide(F.col("s") - F.col("s1"), F.col("n") - F.col("n1"))
    weights = rest.select(unit, feature, (apart / varies).alias("_w"))
    return rows.join(weights, [unit, feature]).groupBy(sample, label).agg(F.round(F.sum(F.col("_w") * v), 10).alias("score"))
