"""Rank and moment statistics over long tables; columns are named by role."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.tables import checkpointed
from .draws import hashed
from .ranks import LARGEST, joined, largest_group, midranks, row_numbers, running, with_midrank


def label_counts(df: DataFrame, value: str, label: str, by: list[str], largest: int = LARGEST) -> DataFrame:
    """Per group and distinct value: rows of each class (_p, _q), all (_t), and rows of class 0 at smaller values (_q_before)."""
    known = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    hit = F.col(label) == 1
    g = known.groupBy(*by, value).agg(F.count(F.when(hit, 1)).alias("_p"), F.count(F.when(~hit, 1)).alias("_q"), F.count("*").alias("_t"))
    return running(g, value, by, ["_q"], largest=largest)


def two_group_auc(df: DataFrame, value: str, label: str, by: list[str], largest: int = LARGEST) -> DataFrame:
    """Per group: n1, n0, auc (ties count half; null for one class) and rank_biserial. Rows of null value or label are left out.

    Rows are counted per distinct value first, combined before the shuffle, so only distinct values are ordered.
    """
    g = label_counts(df, value, label, by, largest).groupBy(*by).agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("n1"), F.coalesce(F.sum("_q"), F.lit(0)).alias("n0"), F.sum(F.col("_p") * (F.col("_q_before") + F.col("_q") / F.lit(2.0))).alias("_u"))
    auc = F.try_divide(F.col("_u"), (F.col("n1") * F.col("n0")).cast("double"))
    return g.withColumn("auc", auc).withColumn("rank_biserial", 2 * F.col("auc") - 1).drop("_u")


def hedges(df: DataFrame, value: str, label: str, by: list[str]) -> DataFrame:
    """Hedges' g and its variance per group; null where a class has fewer than two rows or the pooled spread is 0."""
    case, ctrl = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    m = df.groupBy(*by).agg(F.count(case).alias("n1"), F.count(ctrl).alias("n0"), F.avg(case).alias("m1"), F.avg(ctrl).alias("m0"), F.var_samp(case).alias("v1"), F.var_samp(ctrl).alias("v0"))
    n = F.col("n1") + F.col("n0")
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), n - 2))
    m = m.withColumn("g", F.try_divide(F.col("m1") - F.col("m0"), pooled) * (1 - F.lit(3.0) / (4 * n - 9)))
    return m.withColumn("v", F.try_divide(n.cast("double"), F.col("n1") * F.col("n0")) + F.col("g") * F.col("g") / (2 * n)).select(*by, "n1", "n0", "g", "v")


def welch_t(df: DataFrame, value: str, label: str, by: list[str], least_se: float | None = None) -> DataFrame:
    """by, t. Where neither class varies, t is null, or taken over least_se where that is given (the smallest normal double keeps its sign)."""
    case, ctrl = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    m = df.groupBy(*by).agg(F.avg(case).alias("m1"), F.avg(ctrl).alias("m0"), (F.var_samp(case) / F.count(case)).alias("e1"), (F.var_samp(ctrl) / F.count(ctrl)).alias("e0"))
    se = F.sqrt(F.col("e1") + F.col("e0"))
    se = se if least_se is None else F.when(se == 0, F.lit(least_se)).otherwise(se)
    return m.select(*by, F.try_divide(F.col("m1") - F.col("m0"), se).alias("t"))


def random_effects(effects: DataFrame, g: str, v: str, by: list[str]) -> DataFrame:
    """DerSimonian-Laird pooling: k, fixed, q, tau2, pooled, se, i2."""
    e = effects.where(F.col(g).isNotNull() & (F.col(v) > 0)).withColumn("_w", 1 / F.col(v))
    f = e.groupBy(*by).agg(F.count("*").alias("k"), F.sum("_w").alias("sw"), F.sum(F.col("_w") ** 2).alias("sw2"), (F.sum(F.col("_w") * F.col(g)) / F.sum("_w")).alias("fixed"), F.sum(F.col("_w") * F.col(g) * F.col(g)).alias("sgg"))
    f = f.withColumn("q", F.col("sgg") - F.col("sw") * F.col("fixed") ** 2)
    f = f.withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("sw") - F.col("sw2") / F.col("sw")), F.lit(0.0))))
    keep = f.select(*by, "k", "fixed", "q", "tau2")
    r = e.join(keep, by).withColumn("_r", 1 / (F.col(v) + F.col("tau2")))
    out = r.groupBy(*by, "k", "fixed", "q", "tau2").agg((F.sum(F.col("_r") * F.col(g)) / F.sum("_r")).alias("pooled"), F.sqrt(1 / F.sum("_r")).alias("se"))
    return out.withColumn("i2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("q")), F.lit(0.0))))


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided normal tail by a Chebyshev fit of the complementary error function (relative error below 1.2e-7), plain arithmetic in any engine."""
    # The published coefficients of the fit.
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(fit[0])
    for c in fit[1:]:
        poly = poly * t + c
    return F.when(z.isNotNull(), F.least(F.lit(1.0), t * F.exp(-x * x + poly)))


def adjusted(df: DataFrame, p: str, family: list[str] | None = None, out: str = "q") -> DataFrame:
    """Step-up false discovery rates within a family of tests; a null p stays null and is not counted."""
    by = [*(family or []), F.col(p).isNull()]
    n = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(p))
    df = df.withColumn("_raw", F.col(p) * n / rank)
    down = Window.partitionBy(*by).orderBy(F.desc(p), F.desc("_raw")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw")


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where a side does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def spearman(df: DataFrame, x: str, y: str, by: list[str], largest: int = LARGEST, size: int | None = None) -> DataFrame:
    """by, n, rho. size: rows of the largest group, where known; else they are counted once for both ranks."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    size = largest_group(full, by) if size is None else size
    if size > largest:
        return rho_of_cells(checkpointed(full.groupBy(*by, x, y).agg(F.count("*").alias("_times"))), x, y, by, largest)
    ranked = with_midrank(with_midrank(full, x, by, "_rx", largest, size), y, by, "_ry", largest, size)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("rho"))


def rho_of_cells(cells: DataFrame, x: str, y: str, by: list[str], largest: int = LARGEST) -> DataFrame:
    """by, n, rho of written rows (by, x, y, _times) that count several times: ranks are those of distinct values, and sums of products are weighted, so a row is never repeated."""
    r = cells
    for c, name in ((x, "_rx"), (y, "_ry")):
        r = joined(r, midranks(cells, c, by, "_times", name, largest), [*by, c])
    product = lambda a, b: F.sum(F.col("_times") * F.col(a) * F.col(b))
    varies = lambda c: F.min(c) < F.max(c)
    g = r.groupBy(*by).agg(F.sum("_times").alias("n"), product("_rx", "_ry").alias("_xy"), product("_rx", "_rx").alias("_xx"), product("_ry", "_ry").alias("_yy"), (varies("_rx") & varies("_ry")).alias("_varies"))
    n = F.col("n").cast("double")
    off = n * ((n + 1) / 2) ** 2  # the mean of midranks is known
    return g.select(*by, "n", F.when(F.col("_varies"), F.try_divide(F.col("_xy") - off, F.sqrt((F.col("_xx") - off) * (F.col("_yy") - off)))).alias("rho"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Reliability per equal-width bin, the last one closed: n, confidence, accuracy."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(b).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    r = calibration(df, score, label, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def brier_log_loss(df: DataFrame, score: str, label: str) -> DataFrame:
    p, y = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7)), F.col(label)
    return df.agg(F.avg((y - F.col(score)) ** 2).alias("brier"), (-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def decision_curve(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Net benefit of the model and of treating all, per threshold: one pass over the rows."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    rows = df.select(F.col(score).alias("_s"), F.col(label).alias("_y"), t)
    odds = F.col("threshold") / (1 - F.col("threshold"))
    g = rows.groupBy("threshold").agg(F.count("*").alias("n"), F.count(F.when((F.col("_s") >= F.col("threshold")) & (F.col("_y") == 1), 1)).alias("tp"), F.count(F.when((F.col("_s") >= F.col("threshold")) & (F.col("_y") == 0), 1)).alias("fp"), F.avg(F.col("_y").cast("double")).alias("rate"))
    return g.select("threshold", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit"), (F.col("rate") - (1 - F.col("rate")) * odds).alias("treat_all"))


def roc_points(df: DataFrame, score: str, label: str, by: list[str] | None = None, weight: str | None = None, largest: int = LARGEST) -> DataFrame:
    """by, threshold, tpr, fpr, youden at every distinct score (rows are counted per score first, so only scores are ordered)."""
    by, n = by or [], F.col(weight) if weight else F.lit(1).cast("long")
    g = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(label) == 1, n).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 0, n).otherwise(0)).alias("_n"))
    every = g.groupBy(*by).agg(F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    r = joined(running(g, "threshold", by, ["_p", "_n"], descending=True, largest=largest), every, by)
    r = r.select(*by, "threshold", F.try_divide((F.col("_p_before") + F.col("_p")).cast("double"), F.col("_ps")).alias("tpr"), F.try_divide((F.col("_n_before") + F.col("_n")).cast("double"), F.col("_ns")).alias("fpr"))
    return r.withColumn("youden", F.col("tpr") - F.col("fpr"))


def roc_on_grid(df: DataFrame, score: str, label: str, steps: int = 100, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """by, fpr (0, 1 / steps, ..., 1), tpr: the ROC curve by linear interpolation between its points; at a point met several times the last rate counts.

    Every stretch of the curve covers the grid points in it: a row per point and grid point, nothing is paired.
    """
    by = by or []
    p = roc_points(df, score, label, by, weight).where("tpr is not null and fpr is not null")
    corners = p.groupBy(*by, "fpr").agg(F.min("tpr").alias("_low"), F.max("tpr").alias("_high"))
    corners = corners.unionByName(p.select(*by).distinct().withColumns({"fpr": F.lit(0.0), "_low": F.lit(0.0), "_high": F.lit(0.0)})) if by else corners.unionByName(df.sparkSession.sql("select 0.0d as fpr, 0.0d as _low, 0.0d as _high"))
    corners = corners.groupBy(*by, "fpr").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    w = Window.partitionBy(*by).orderBy("fpr")  # distinct rates of false positives on a curve
    legs = corners.select(*by, "fpr", "_low", "_high", F.lag("fpr").over(w).alias("_x"), F.lag("_high").over(w).alias("_y"))
    first, last = F.floor(F.col("_x") * steps + 1e-9) + 1, F.floor(F.col("fpr") * steps + 1e-9)
    cells = legs.where("_x is not null").select(*by, "fpr", "_low", "_high", "_x", "_y", F.explode(F.when(first <= last, F.sequence(first, last))).alias("_g"))
    x = F.col("_g") / F.lit(float(steps))
    at = F.when(F.abs(x - F.col("fpr")) < 1e-12, F.col("_high")).otherwise(F.col("_y") + (F.col("_low") - F.col("_y")) * (x - F.col("_x")) / (F.col("fpr") - F.col("_x")))
    zero = corners.where("fpr = 0").select(*by, F.lit(0.0).alias("fpr"), F.col("_high").alias("tpr"))
    return cells.select(*by, x.alias("fpr"), at.alias("tpr")).unionByName(zero)


def weighted_unit_mean(df: DataFrame, metric: str, unit: str, cohort: str) -> DataFrame:
    """Every unit weighs the same, and so do the cohorts within a unit, whatever their rows; null metrics carry no weight."""
    each = df.where(F.col(metric).isNotNull()).groupBy(unit, cohort).agg(F.avg(metric).alias("_c"))
    per = each.groupBy(unit).agg(F.avg("_c").alias("_m"))
    return per.agg(F.count("*").alias("units"), F.avg("_m").alias("weighted_mean"))


def mann_whitney(df: DataFrame, value: str, label: str, by: list[str], largest: int = LARGEST) -> DataFrame:
    """u (of label 1), n1, n0, z and the two-sided p: normal approximation with tie and continuity correction; null for one class or all ties."""
    t = F.col("_t").cast("double")
    c = label_counts(df, value, label, by, largest)
    g = c.groupBy(*by).agg(F.sum("_p").alias("n1"), F.sum("_q").alias("n0"), F.sum(F.col("_p") * (F.col("_q_before") + F.col("_q") / F.lit(2.0))).alias("u"), F.sum(t * (t * t - 1)).alias("_ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    off = F.col("u") - n1 * n0 / 2
    g = g.withColumn("z", F.signum(off) * F.try_divide(F.greatest(F.abs(off) - 0.5, F.lit(0.0)), sd))
    return g.withColumn("p", normal_two_sided_p(F.col("z"))).select(*by, "n1", "n0", "u", "z", "p")


def mann_whitney_sides(df: DataFrame, value: str, label: str, by: list[str], largest: int = LARGEST) -> DataFrame:
    """mann_whitney's rows and p_less, p_greater: the tails for label 1 having the smaller, the larger values, each with its own continuity correction."""
    t = F.col("_t").cast("double")
    c = label_counts(df, value, label, by, largest)
    g = c.groupBy(*by).agg(F.sum("_p").alias("n1"), F.sum("_q").alias("n0"), F.sum(F.col("_p") * (F.col("_q_before") + F.col("_q") / F.lit(2.0))).alias("u"), F.sum(t * (t * t - 1)).alias("_ties"), (F.max("_t") > 1).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    off = F.col("u") - n1 * n0 / 2

    def upper(z: Column) -> Column:
        return F.when(z >= 0, normal_two_sided_p(z) / 2).otherwise(1 - normal_two_sided_p(z) / 2)

    sides = {"p_less": upper(F.try_divide(-off - 0.5, sd)), "p_greater": upper(F.try_divide(off - 0.5, sd))}
    both = normal_two_sided_p(F.try_divide(F.greatest(F.abs(off) - 0.5, F.lit(0.0)), sd))
    known = F.try_divide(F.lit(1.0), sd).isNotNull()
    return g.select(*by, "n1", "n0", "u", "ties", F.when(known, both).alias("p"), *[F.when(known, c).alias(k) for k, c in sides.items()])


MOST_EXACT = 50  # differences whose signed ranks are counted out
MOST_WAYS = 2_000_000  # values of u: a smaller class of 8 against a quarter of a million rows


@lru_cache(maxsize=64)
def _rank_sum_ways(n1: int, n0: int) -> np.ndarray:
    """How many of the orders of n1 + n0 distinct values give each u, from 0 to n1 * n0, as whole numbers of any size.

    The counts are the coefficients of the product of (1 - q^(n + i)) / (1 - q^i) for i up to the smaller class: a shifted difference and a running sum each.
    """
    k, n = min(n1, n0), max(n1, n0)
    ways = np.zeros(k * n + 1, object)
    ways[0] = 1
    for i in range(1, k + 1):
        if n + i <= k * n:
            ways[n + i :] = ways[n + i :] - ways[: -(n + i)]
        for r in range(i):
            ways[r::i] = np.add.accumulate(ways[r::i])
    return ways


def _tail(ways: np.ndarray, at: float, alternative: str) -> float:
    k, total = int(round(at)), ways.sum()
    low, high = ways[: k + 1].sum() / total, ways[k:].sum() / total
    return float({"less": low, "greater": high, "two-sided": min(1.0, 2 * min(low, high))}[alternative])


def exact_mann_whitney(df: DataFrame, value: str, label: str, by: list[str], alternative: str = "two-sided") -> DataFrame:
    """by, n1, n0, u, ties (whether values repeat) and p. Orders are counted out where no values repeat and a class has at most 8 rows, however many the other has (up to MOST_WAYS
    values of u); elsewhere p is the normal approximation of the side. alternative: "two-sided", "less" or "greater" (label 1 has the smaller, the larger values)."""
    near = {"two-sided": "p", "less": "p_less", "greater": "p_greater"}[alternative]
    g = mann_whitney_sides(df, value, label, by)

    @F.pandas_udf(DoubleType())
    def p(u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series, near: pd.Series) -> pd.Series:
        fine = lambda a, b, t: not t and 0 < min(a, b) <= 8 and a * b <= MOST_WAYS
        return pd.Series([_tail(_rank_sum_ways(int(a), int(b)), x, alternative) if fine(a, b, t) else q for x, a, b, t, q in zip(u, n1, n0, ties, near)], dtype="float64")

    return g.select(*by, "n1", "n0", "u", "ties", p("u", "n1", "n0", "ties", near).alias("p"))


def exact_signed_rank(df: DataFrame, difference: str, by: list[str]) -> DataFrame:
    """by, n, w and the two-sided p: counted out where sizes do not repeat and n is at most MOST_EXACT, by the normal approximation elsewhere."""
    d = df.where(F.col(difference) != 0).withColumn("_a", F.abs(F.col(difference)))
    ties = d.groupBy(*by, "_a").count().groupBy(*by).agg((F.max("count") > 1).alias("_same"))
    g = joined(signed_rank(df, difference, by), ties, by)

    @F.pandas_udf(DoubleType())
    def p(n: pd.Series, w: pd.Series, same: pd.Series, near: pd.Series) -> pd.Series:
        out = []
        for k, x, t, q in zip(n, w, same, near):
            if t or k > MOST_EXACT:
                out.append(q)
                continue
            ways = np.zeros(k * (k + 1) // 2 + 1)
            ways[0] = 1
            for rank in range(1, k + 1):
                ways[rank:] = ways[rank:] + ways[:-rank]
            out.append(_tail(ways, x, "two-sided"))
        return pd.Series(out, dtype="float64")

    return g.select(*by, "n", "w", p("n", "w", "_same", "p").alias("p"))


def signed_rank(df: DataFrame, difference: str, by: list[str], largest: int = LARGEST) -> DataFrame:
    """Wilcoxon signed rank: n (without zeros), the sum of positive ranks, z with tie correction and p."""
    d = df.where((F.col(difference) != 0)).withColumn("_a", F.abs(F.col(difference)))
    c = running(d.groupBy(*by, "_a").agg(F.count("*").alias("_t"), F.count(F.when(F.col(difference) > 0, 1)).alias("_p")), "_a", by, ["_t"], largest=largest)
    t = F.col("_t").cast("double")
    g = c.groupBy(*by).agg(F.sum("_t").alias("n"), F.sum(F.col("_p") * (F.col("_t_before") + (F.col("_t") + 1) / F.lit(2.0))).alias("w"), F.sum(t * (t * t - 1)).alias("_ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    g = g.withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, sd))
    return g.withColumn("p", normal_two_sided_p(F.col("z"))).select(*by, "n", "w", "z", "p")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 12 (relative error below 1e-14), for positive numbers."""
    x = np.asarray(x, dtype=float)
    shift = sum(np.log(x + i) for i in range(12))
    y = x + 12
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def _near_mode(low: int, high: int, mode: float, sd: float) -> np.ndarray:
    """The whole numbers of a range within 40 spreads of the mode: what lies beyond is below the least double."""
    w = 40 * sd + 40
    return np.arange(max(low, math.floor(mode - w)), min(high, math.ceil(mode + w)) + 1)


def _hypergeometric_logs(x: np.ndarray, m: int, n: int, u: int) -> np.ndarray:
    """Logarithms of the chances of x hits among m when n of u are drawn."""
    choose = lambda a, b: log_gamma(a + 1.0) - log_gamma(b + 1.0) - log_gamma(a - b + 1.0)
    return choose(np.full(len(x), m), x) + choose(np.full(len(x), u - m), n - x) - choose(np.array([u]), np.array([n]))


def _hypergeometric_range(low: int, m: int, n: int, u: int) -> np.ndarray:
    mean = m * n / u if u else 0.0
    sd = math.sqrt(max(0.0, mean * (1 - m / u) * (u - n) / max(1, u - 1))) if u else 0.0
    return _near_mode(max(low, m + n - u, 0), min(m, n), max(mean, low), sd)


@F.pandas_udf(DoubleType())
def fisher_exact_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p of the table ((a, b), (c, d)): tables of the same margins that are no likelier. Null cells give null.

    Work per table grows with the spread of the cell, not with the counts.
    """
    def one(a, b, c, d):
        if any(pd.isna(x) for x in (a, b, c, d)):
            return None
        a, b, c, d = int(a), int(b), int(c), int(d)
        r, k, n = a + b, a + c, a + b + c + d
        logs = _hypergeometric_logs(_hypergeometric_range(0, k, r, n), k, r, n)
        own = _hypergeometric_logs(np.array([a]), k, r, n)[0]
        return float(min(1.0, np.exp(logs[logs <= own + 1e-7]).sum()))

    return pd.Series([one(*row) for row in zip(a, b, c, d)], dtype="float64")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, h = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1))
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


@F.pandas_udf(DoubleType())
def sign_test_p(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """One-sided binomial tail P(X >= wins) of fair coins; ties are left out by the caller."""
    one = lambda w, n: 1.0 if w <= 0 else incomplete_beta(w, n - w + 1, 0.5)
    return pd.Series([None if pd.isna(w) or pd.isna(v) else one(int(w), int(w + v)) for w, v in zip(wins, losses)], dtype="float64")


@F.pandas_udf(DoubleType())
def student_t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t. Null where either is null or dof < 1."""
    return pd.Series([None if pd.isna(v) or pd.isna(n) or n < 1 else incomplete_beta(n / 2, 0.5, n / (n + v * v)) for v, n in zip(t, dof)], dtype="float64")


def poisson_binomial_tail(probs: Column, k: Column) -> Column:
    """P(at least k successes) of independent trials with the given chances, by a fold over the array."""
    start = F.array(F.lit(1.0))
    step = lambda acc, p: F.transform(F.sequence(F.lit(0), F.size(acc)), lambda i: F.coalesce(F.try_element_at(acc, i + 1), F.lit(0.0)) * (1 - p) + F.when(i > 0, F.try_element_at(acc, F.greatest(i, F.lit(1)))).otherwise(0.0) * p)
    dist = F.aggregate(probs, start, step)
    return F.aggregate(F.filter(F.transform(dist, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda s: s["i"] >= k), F.lit(0.0), lambda acc, s: acc + s["v"])


def residual(df: DataFrame, y: str, x: str, by: list[str], out: str) -> DataFrame:
    """Residual of the line of y on x within each group; y less its mean where x does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    line = df.groupBy(*by).agg(F.avg(a).alias("_xm"), F.avg(b).alias("_ym"), F.coalesce(F.try_divide(F.covar_pop(a, b), F.var_pop(a)), F.lit(0.0)).alias("_slope"))
    return joined(df, line, by).withColumn(out, F.col(y) - F.col("_ym") - F.col("_slope") * (F.col(x) - F.col("_xm"))).drop("_xm", "_ym", "_slope")


def partial_spearman(df: DataFrame, x: str, y: str, cov: str, by: list[str], largest: int = LARGEST) -> DataFrame:
    """Ranks of x and y lose their linear part in the rank of the covariate; then Spearman of what is left. Residuals are rounded at 1e-9, so ties stay ties.

    The rows are written and counted once, equal ones as one with their number; five ranks are taken of them, and both lines come from one aggregate.
    """
    r = checkpointed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(cov).isNotNull()).groupBy(*by, x, y, cov).agg(F.count("*").alias("_times")))
    size = r.groupBy(*by).agg(F.sum("_times").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if size <= largest:
        r = r.select(*by, x, y, cov, F.explode(F.array_repeat(F.lit(1).cast("long"), F.col("_times").cast("int"))).alias("_times"))
    cells = r
    for c, name in ((x, "_rx"), (y, "_ry"), (cov, "_rc")):
        r = with_midrank(r, c, by, name, size=size) if size <= largest else joined(r, midranks(cells, c, by, "_times", name, largest), [*by, c])
    if size <= largest:
        slope = lambda c: F.coalesce(F.try_divide(F.covar_pop("_rc", c), F.var_pop("_rc")), F.lit(0.0))
        line = r.groupBy(*by).agg(F.avg("_rc").alias("_mc"), F.avg("_rx").alias("_mx"), F.avg("_ry").alias("_my"), slope("_rx").alias("_sx"), slope("_ry").alias("_sy"))
    else:
        product = lambda c: F.sum(F.col("_times") * F.col("_rc") * F.col(c))
        g = r.groupBy(*by).agg(F.sum("_times").cast("double").alias("_n"), product("_rx").alias("_cx"), product("_ry").alias("_cy"), product("_rc").alias("_cc"), (F.min("_rc") < F.max("_rc")).alias("_varies"))
        mean = (F.col("_n") + 1) / 2  # of midranks, whatever the ties
        slope = lambda c: F.coalesce(F.when(F.col("_varies"), F.try_divide(F.col(c) - F.col("_n") * mean * mean, F.col("_cc") - F.col("_n") * mean * mean)), F.lit(0.0))
        line = g.select(*by, *[mean.alias(m) for m in ("_mc", "_mx", "_my")], slope("_cx").alias("_sx"), slope("_cy").alias("_sy"))
    left = lambda c, m, s: F.round(F.col(c) - F.col(m) - F.col(s) * (F.col("_rc") - F.col("_mc")), 9)
    r = joined(r, line, by).select(*by, left("_rx", "_mx", "_sx").alias("_ex"), left("_ry", "_my", "_sy").alias("_ey"), "_times")
    if size <= largest:
        return spearman(r, "_ex", "_ey", by, size=size)
    return rho_of_cells(checkpointed(r.groupBy(*by, "_ex", "_ey").agg(F.sum("_times").alias("_times"))), "_ex", "_ey", by, largest)


def pearson_screen(df: DataFrame, sample: str, feature: str, value: str, target: DataFrame, least_r: float, cap: int, alpha: float = 0.05) -> DataFrame:
    """Features correlated with the target (sample, t): |r| at least least_r, Bonferroni p at most alpha, the cap strongest.

    One equi-join on the sample and one aggregate over all features; nothing is paired with itself.
    """
    g = df.join(target.select(sample, "t"), sample).where(F.col(value).isNotNull() & F.col("t").isNotNull()).groupBy(feature).agg(F.count("*").alias("n"), correlation(value, "t").alias("r"))
    tests = g.agg(F.count("r").alias("_tests"))
    t = F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("r") * F.col("r")))
    s = g.join(F.broadcast(tests)).where(F.abs(F.col("r")) >= least_r).withColumn("p", F.when(F.abs(F.col("r")) >= 1, 0.0).otherwise(student_t_p(t, F.col("n") - 2)))  # one row
    return s.where(F.col("p") * F.col("_tests") <= alpha).orderBy(F.desc(F.abs(F.col("r"))), feature).limit(cap).select(feature, "n", "r", "p")


def replicated(a: DataFrame, b: DataFrame, key: list[str], value: str, least: float) -> DataFrame:
    """Rows of a whose effect comes again in b: the same sign and both at least `least` in size."""
    other = b.select(*key, F.col(value).alias("_b"))
    return a.join(other, key).where((F.signum(value) == F.signum("_b")) & (F.abs(F.col(value)) >= least) & (F.abs(F.col("_b")) >= least)).withColumnRenamed("_b", "other")


def quasi_poisson(df: DataFrame, count: str, library: str, group: str, by: list[str]) -> DataFrame:
    """Two-group quasi-Poisson with the library as offset, in closed form: log2 ratio of rates, Pearson dispersion, t, dof and p."""
    rate = df.groupBy(*by, group).agg((F.sum(count) / F.sum(library)).alias("_mu"), F.sum(count).alias("_c"), F.count("*").alias("_n"))
    chi = F.sum((F.col(count) - F.col("_mu") * F.col(library)) ** 2 / (F.col("_mu") * F.col(library)))
    per = df.join(rate, [*by, group]).groupBy(*by, group, "_mu", "_c", "_n").agg(chi.alias("_x"))
    of = lambda k, c: F.max(F.when(F.col(group) == k, F.col(c)))
    g = per.groupBy(*by).agg(of(1, "_mu").alias("_m1"), of(0, "_mu").alias("_m0"), of(1, "_c").alias("_c1"), of(0, "_c").alias("_c0"), F.sum("_x").alias("_x"), F.sum("_n").alias("n"))
    g = g.withColumn("dispersion", F.try_divide(F.col("_x"), F.col("n") - 2)).withColumn("log2fc", F.log2(F.try_divide(F.col("_m1"), F.col("_m0"))))
    se = F.sqrt(F.col("dispersion") * (F.try_divide(F.lit(1.0), F.col("_c1")) + F.try_divide(F.lit(1.0), F.col("_c0"))))
    g = g.withColumn("t", F.try_divide(F.col("log2fc") * math.log(2), se))
    return g.withColumn("p", student_t_p(F.col("t"), F.col("n") - 2)).select(*by, "n", "log2fc", "dispersion", "t", "p")


def clustered_ols(df: DataFrame, y: str, x: str, cluster: str, by: list[str]) -> DataFrame:
    """Slope of y on x with a standard error clustered by donor (small-sample factor included), from moments alone."""
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    m = d.groupBy(*by).agg(F.avg(x).alias("_xm"), F.avg(y).alias("_ym"), F.try_divide(F.covar_pop(x, y), F.var_pop(x)).alias("slope"), (F.var_pop(x) * F.count("*")).alias("_sxx"), F.count("*").alias("n"))
    joined = d.join(m, by) if by else d.join(F.broadcast(m))  # one row
    cx = F.col(x) - F.col("_xm")
    c = joined.groupBy(*by, cluster, "slope", "_sxx", "n").agg(F.sum(cx * (F.col(y) - F.col("_ym") - F.col("slope") * cx)).alias("_u"))
    out = c.groupBy(*by, "slope", "_sxx", "n").agg(F.count("*").alias("clusters"), F.sum(F.col("_u") ** 2).alias("_uu"))
    factor = F.try_divide(F.col("clusters").cast("double"), F.col("clusters") - 1) * F.try_divide((F.col("n") - 1).cast("double"), F.col("n") - 2)
    return out.select(*by, "n", "clusters", "slope", F.try_divide(F.sqrt(factor * F.col("_uu")), F.col("_sxx")).alias("se"))


def pooled_auc(df: DataFrame, auc: str, n1: str, n0: str, sd: str, by: list[str]) -> DataFrame:
    """Areas pooled by the inverse of their variance under the null, with a standard error from their bootstrap spreads."""
    a, b = F.col(n1).cast("double"), F.col(n0).cast("double")
    w = df.where(F.col(auc).isNotNull()).withColumn("_w", 12 * a * b / (a + b + 1))
    return w.groupBy(*by).agg(F.count("*").alias("k"), (F.sum(F.col("_w") * F.col(auc)) / F.sum("_w")).alias("pooled"), (F.sqrt(F.sum((F.col("_w") * F.col(sd)) ** 2)) / F.sum("_w")).alias("se"))


def sign_consistency(effects: DataFrame, g: str, v: str, by: list[str], least: int) -> DataFrame:
    """Random effects of the features seen in at least `least` units, with same_sign: how many units share the commoner sign."""
    signs = effects.where(F.col(g).isNotNull() & (F.col(v) > 0)).groupBy(*by).agg(F.greatest(F.count(F.when(F.col(g) > 0, 1)), F.count(F.when(F.col(g) < 0, 1))).alias("same_sign"))
    return joined(random_effects(effects, g, v, by), signs, by).where(F.col("k") >= least)


def leave_one_cohort_means(df: DataFrame, metric: str, unit: str, cohort: str) -> DataFrame:
    """held_out, weighted_mean: the equal-unit mean without each cohort in turn, from sums per cohort and unit alone."""
    each = df.where(F.col(metric).isNotNull()).groupBy(unit, cohort).agg(F.avg(metric).alias("_c"))
    units = each.groupBy(unit).agg(F.sum("_c").alias("_s"), F.count("*").alias("_n"))
    means = units.agg(F.sum(F.col("_s") / F.col("_n")).alias("_all"), F.count("*").alias("_units"))
    own = each.join(units, unit).withColumn("_without", F.when(F.col("_n") > 1, (F.col("_s") - F.col("_c")) / (F.col("_n") - 1)))
    lost = own.groupBy(F.col(cohort).alias("held_out")).agg(F.sum(F.coalesce("_without", F.lit(0.0)) - F.col("_s") / F.col("_n")).alias("_d"), F.count(F.when(F.col("_without").isNull(), 1)).alias("_gone"))
    return lost.join(F.broadcast(means)).select("held_out", F.try_divide(F.col("_all") + F.col("_d"), F.col("_units") - F.col("_gone")).alias("weighted_mean"))  # one row


def leave_one_out_meta(effects: DataFrame, feature: str, unit: str, g: str, v: str) -> DataFrame:
    """Random effects without each unit in turn: the sign stays and every p is below 0.05 (robust), and the worst p.

    Rows are copied once per other unit of the same study list, which is short; the pooling itself is grouped by feature and unit left out.
    """
    units = effects.select(F.col(unit).alias("held_out")).distinct()
    runs = random_effects(effects.join(F.broadcast(units), F.col(unit) != F.col("held_out")), g, v, [feature, "held_out"])
    p = normal_two_sided_p(F.col("pooled") / F.col("se"))
    r = runs.withColumn("_p", p).groupBy(feature).agg(F.count("*").alias("runs"), F.max("_p").alias("worst_p"), F.count_distinct(F.signum("pooled")).alias("_signs"))
    return r.select(feature, "runs", "worst_p", ((F.col("_signs") == 1) & (F.col("worst_p") < 0.05)).alias("robust"))


def gradient(df: DataFrame, feature: str, tissue_rank: str, effect: str, least: int = 4) -> DataFrame:
    """Spearman of ordinal tissue rank against effect, per feature seen in at least `least` tissues."""
    return spearman(df, tissue_rank, effect, [feature]).where(F.col("n") >= least)


def hypergeometric_overlap(hits: DataFrame, sets: DataFrame, universe: int) -> DataFrame:
    """Over-representation of the hits (gene) in each term (term, gene): overlap, size, p (upper hypergeometric tail). Terms without hits are left out."""
    h, s = hits.select("gene").distinct(), sets.select("term", "gene").distinct()
    n = h.agg(F.count("*").alias("hits"))
    size = s.groupBy("term").agg(F.count("*").alias("size"))
    o = s.join(h, "gene").groupBy("term").agg(F.count("*").alias("overlap")).join(size, "term").join(F.broadcast(n))  # one row
    return o.withColumn("p", _hypergeometric_tail(F.col("overlap"), F.col("size"), F.col("hits"), F.lit(universe))).select("term", "overlap", "size", "p")


@F.pandas_udf(DoubleType())
def _hypergeometric_tail(k: pd.Series, size: pd.Series, hits: pd.Series, universe: pd.Series) -> pd.Series:
    one = lambda k, m, n, u: float(min(1.0, np.exp(_hypergeometric_logs(_hypergeometric_range(k, m, n, u), m, n, u)).sum()))
    return pd.Series([one(*map(int, r)) for r in zip(k, size, hits, universe)], dtype="float64")


def enrichment_score(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """Running-sum enrichment of each term in a ranking (gene, score): weight |score| up for members, equal steps down for others; the extreme of the sum.

    Only members are touched: before the m-th member at place r the sum has fallen by (r - m) equal steps, so the extreme lies at a member or just before one.
    """
    places = row_numbers(ranked.select("gene", "score"), "score", [], ["gene"], "_r", descending=True)
    return _extremes(sets.select("term", "gene").distinct().join(places, "gene"), ["term"], ranked.count())


def permuted_enrichment(ranked: DataFrame, sets: DataFrame, permutations: int, least: int = 10, most: int = 500, seed: int = 0) -> DataFrame:
    """term, size, es, nes and p of the terms with `least` to `most` ranked genes, against permutations of the genes over the places of the ranking.

    p and nes rest on the permutations whose score has the sign of es: p = (those at least as large + 1) / (those + 1), nes = es / their mean size (null
    without any). A permutation orders all genes by a hash, so it comes out the same when a task is run again; members alone are joined to it.
    """
    genes = ranked.select("gene", "score")
    places = row_numbers(genes, "score", [], ["gene"], "_r", descending=True).select("_r", "score")
    members = sets.select("term", "gene").distinct().join(genes.select("gene"), "gene")
    size = members.groupBy("term").agg(F.count("*").alias("size")).where(F.col("size").between(least, most))
    members = members.join(size.select("term"), "term")
    dealt = genes.select("gene", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_draw")).withColumn("_h", hashed("_draw", "gene", seed=seed))
    dealt = row_numbers(dealt, "_h", ["_draw"], ["gene"], "_r").select("_draw", "gene", "_r")
    null = _extremes(members.join(dealt, "gene").join(places, "_r"), ["term", "_draw"], genes.count()).select("term", F.col("es").alias("_null"))
    es = _extremes(members.join(row_numbers(genes, "score", [], ["gene"], "_r", descending=True), "gene"), ["term"], genes.count())
    same = F.signum("_null") == F.signum("es")
    g = es.join(null, "term").groupBy("term", "size", "es").agg(F.count(F.when(same, 1)).alias("_n"), F.count(F.when(same & (F.abs("_null") >= F.abs("es")), 1)).alias("_k"), F.avg(F.when(same, F.abs("_null"))).alias("_mean"))
    return g.select("term", "size", "es", F.try_divide(F.col("es"), F.col("_mean")).alias("nes"), ((F.col("_k") + 1) / (F.col("_n") + 1)).alias("p"))


def _extremes(m: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, size and es from members with their places (_r, score) among n: before the k-th member at place r the sum has fallen by r - k equal steps."""
    w, every = Window.partitionBy(*by).orderBy("_r"), Window.partitionBy(*by)  # the members of a set
    m = m.withColumn("_k", F.row_number().over(w)).withColumn("_m", F.count("*").over(every)).withColumn("_up", F.sum(F.abs("score")).over(w)).withColumn("_all", F.sum(F.abs("score")).over(every))
    down = F.try_divide((F.col("_r") - F.col("_k")).cast("double"), F.lit(n) - F.col("_m"))
    g = m.withColumn("_after", F.col("_up") / F.col("_all") - down).withColumn("_before", (F.col("_up") - F.abs("score")) / F.col("_all") - down)
    g = g.groupBy(*by).agg(F.max("_m").alias("size"), F.max("_after").alias("_hi"), F.min("_before").alias("_lo"))
    return g.select(*by, "size", F.when(F.col("_hi") >= -F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("es"))
