"""Scaling, ranking and collapsing of long measurement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import joined, quantiles, row_numbers, running, with_midrank


def long_form(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    return df.unpivot(ids, features, "feature", "value")


def log_cpm(df: DataFrame, sample: list[str], value: str = "value") -> DataFrame:
    total = df.groupBy(*sample).agg(F.sum(value).alias("_total"))
    return joined(df, total, sample).withColumn("log_cpm", F.log1p(F.try_divide(1e6 * F.col(value), F.col("_total")))).drop("_total")


def log_cpm_of_columns(df: DataFrame, sample: list[str], features: list[str]) -> DataFrame:
    """sample, feature, value, log_cpm of features that lie in columns: summed per sample where they lie, made long after that, so a sample's rows are shuffled once. Null values have no row."""
    wide = df.groupBy(*sample).agg(*[F.sum(F.col(f).cast("double")).alias(f) for f in features])
    total = sum((F.coalesce(F.col(f), F.lit(0.0)) for f in features), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    long = wide.select(*sample, total.alias("_total"), F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("_c")).select(*sample, "_total", "_c.*")
    return long.withColumn("log_cpm", F.log1p(F.try_divide(1e6 * F.col("value"), F.col("_total")))).drop("_total")


def z_within(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """Population z; a spread of 0 counts as 1. Moments are aggregates joined back, so a large group is no single task."""
    m = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return joined(df, m, by).withColumn(out, (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def control_z(df: DataFrame, value: str, label: str, by: list[str], out: str = "z") -> DataFrame:
    """(x - mean of controls) / pooled spread within classes (two degrees less); a spread of 0 counts as 1."""
    c0, c1 = F.when(F.col(label) == 0, F.col(value)), F.when(F.col(label) == 1, F.col(value))
    ss = F.coalesce(F.var_pop(c0) * F.count(c0), F.lit(0.0)) + F.coalesce(F.var_pop(c1) * F.count(c1), F.lit(0.0))
    m = df.groupBy(*by).agg(F.avg(c0).alias("_m"), F.sqrt(F.try_divide(ss, F.count(value) - 2)).alias("_s"))
    return joined(df, m, by).withColumn(out, (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def quantile_normalise(df: DataFrame, value: str, column: str, key: str) -> DataFrame:
    """Each column's values become the mean, over columns, of the values of the same rank."""
    ranked = row_numbers(df, value, [column], [key], "_rank")
    profile = ranked.groupBy("_rank").agg(F.avg(value).alias("normalised"))
    return ranked.join(profile, "_rank").drop("_rank")


def collapse_by_mean(df: DataFrame, key: str, row: str, value: str) -> DataFrame:
    """Per key the row of highest mean; ties go to the smaller row."""
    means = df.groupBy(key, row).agg(F.avg(value).alias("mean"))
    best = Window.partitionBy(key).orderBy(F.desc("mean"), row)
    return means.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def deciles(df: DataFrame, value: str, out: str = "decile") -> DataFrame:
    """How many of the exact 10th to 90th percentiles a value reaches."""
    cuts = quantiles(df, value, [], [k / 10 for k in range(1, 10)])
    reached = sum([F.when(F.col(f"q{k}") <= F.col(value), 1).otherwise(0) for k in range(9)], F.lit(0))
    return df.join(F.broadcast(cuts)).withColumn(out, reached).drop(*[f"q{k}" for k in range(9)])  # one row


def median_split(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    cut = quantiles(df, value, by, [0.5])
    return joined(df, cut, by, "left").withColumn("half", F.when(F.col(value) >= F.col("q0"), "high").otherwise("low")).drop("q0")


def top_fraction(df: DataFrame, value: str, by: list[str], fraction: float) -> DataFrame:
    return joined(df, quantiles(df, value, by, [1 - fraction]), by).where(F.col(value) >= F.col("q0")).drop("q0")


def cumulative_gain(df: DataFrame, feature: str, gain: str, fraction: float) -> DataFrame:
    """The fewest features, best first, that hold the fraction of all gain."""
    total = df.agg(F.sum(gain).alias("_t"))
    kept = running(df, gain, [], [gain], descending=True, tie=[feature]).join(F.broadcast(total))  # one row
    return kept.where(F.col(f"{gain}_before") < fraction * F.col("_t")).drop("_t", f"{gain}_before")


def z_against(df: DataFrame, reference: DataFrame, feature: str, value: str, out: str = "z") -> DataFrame:
    """Population z by the reference rows' mean and spread per feature (fit on training rows, apply to others); a spread of 0 counts as 1."""
    fit = reference.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(fit, feature).withColumn(out, (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function by Acklam's rational approximation (relative error below 1.2e-9), plain arithmetic."""
    # The published coefficients of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(x, k, last=None):
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out if last is None else out * x + last

    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when(p < 0.02425, poly(low, c) / poly(low, d, 1.0)).when(p > 0.97575, -poly(high, c) / poly(high, d, 1.0)).otherwise(poly(r, a) * q / poly(r, b, 1.0))


def normal_scores(df: DataFrame, sample: str, value: str, out: str = "score") -> DataFrame:
    """Per sample, the normal quantile of midrank / (n + 1); null values have none."""
    n = df.groupBy(sample).agg(F.count(value).alias("_n"))
    ranked = joined(with_midrank(df, value, [sample], "_r"), n, [sample])
    return ranked.withColumn(out, normal_quantile(F.col("_r") / (F.col("_n") + 1))).drop("_r", "_n")


def break_even(df: DataFrame, k: str, metric: str) -> DataFrame:
    """The first k whose gain over the one before falls below the mean gain of the whole curve (one row per k: a curve, not a data table)."""
    gain = df.withColumn("_g", F.col(metric) - F.lag(metric).over(Window.orderBy(k)))
    mean = gain.agg(F.avg("_g").alias("_mean"))
    return gain.join(F.broadcast(mean)).where("_g < _mean").agg(F.min(k).alias(k))


def ratio_to_next(df: DataFrame, feature: str, kind: str, value: str, out: str = "margin") -> DataFrame:
    """Value minus the best value of any other kind for the same feature."""
    w = Window.partitionBy(feature)
    two = F.slice(F.sort_array(F.collect_list(value).over(w), asc=False), 1, 2)
    return df.withColumn("_t", two).withColumn(out, F.col(value) - F.when(F.col(value) == F.col("_t")[0], F.get("_t", F.lit(1))).otherwise(F.col("_t")[0])).drop("_t")


def filled(df: DataFrame, sample: str, feature: str, value: str, how: str, train: DataFrame | None = None) -> DataFrame:
    """The long table with null and NaN values filled: "zero", "column_mean" (the feature's mean), "row_median" (the sample's median) or "train_mean" (the
    feature's mean over the samples of train). A feature or sample without a known value is filled with 0."""
    v = F.col(value).cast("double")
    rows = df.withColumn(value, F.when(~F.isnan(v), v))
    if how == "zero":
        return rows.fillna(0.0, [value])
    if how == "row_median":
        fill, key = quantiles(rows, value, [sample], [0.5]).withColumnRenamed("q0", "_fill"), [sample]
    else:
        known = rows.join(train.select(sample).distinct(), sample, "left_semi") if how == "train_mean" else rows
        fill, key = known.groupBy(feature).agg(F.avg(value).alias("_fill")), [feature]
    return joined(rows, fill, key, "left").withColumn(value, F.coalesce(value, "_fill", F.lit(0.0))).drop("_fill")


def varying(df: DataFrame, feature: str, value: str, least_range: float = 1e-50) -> DataFrame:
    """Rows of the features whose finite values differ by more than least_range; a feature without finite values goes."""
    v = F.col(value).cast("double")
    fine = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    kept = df.groupBy(feature).agg((F.max(fine) - F.min(fine)).alias("_s")).where(F.col("_s") > least_range)
    return df.join(kept.select(feature), feature, "left_semi")


def expressed(df: DataFrame, feature: str, value: str, least: float, share: float) -> DataFrame:
    """Rows of the features that reach at least `least` in at least this share of their samples."""
    good = df.groupBy(feature).agg(F.avg(F.when(F.col(value) >= least, 1.0).otherwise(0.0)).alias("_s")).where(F.col("_s") >= share)
    return df.join(good.select(feature), feature, "left_semi")


def without_lowest(df: DataFrame, feature: str, value: str, fraction: float = 0.25) -> DataFrame:
    """Rows of the features whose mean lies above the given quantile of all features' means."""
    means = df.groupBy(feature).agg(F.avg(value).alias("_m"))
    cut = quantiles(means, "_m", [], [fraction])
    return df.join(means.join(F.broadcast(cut)).where("_m > q0").select(feature), feature, "left_semi")  # one row of cuts


def above_mean_gain(df: DataFrame, feature: str, gain: str) -> DataFrame:
    """The features whose gain reaches the mean gain."""
    return df.join(F.broadcast(df.agg(F.avg(gain).alias("_mean")))).where(F.col(gain) >= F.col("_mean")).select(feature, gain)  # one row


def log_where_raw(df: DataFrame, value: str, cohort: str, log_scale: list, out: str = "logged") -> DataFrame:
    """log1p of the values but for the cohorts that are on a log scale already, which stay."""
    return df.withColumn(out, F.when(F.col(cohort).isin(*log_scale), F.col(value)).otherwise(F.log1p(F.col(value))))


def fold_changes(df: DataFrame, value: str, label: str, by: list[str]) -> DataFrame:
    """by, ratio, pseudo, back: log2 fold changes of class means as plain ratio (null where either is not positive), with pseudo-count 1, and of means on a log1p scale taken back, with 1e-3."""
    m = df.groupBy(*by).agg(*[F.avg(F.when(F.col(label) == k, F.col(value))).alias(f"_m{k}") for k in (0, 1)])
    a, b = F.col("_m1"), F.col("_m0")
    return m.select(*by, F.when((a > 0) & (b > 0), F.log2(a / b)).alias("ratio"), F.log2((a + 1) / (b + 1)).alias("pseudo"), F.log2((F.expm1(a) + 1e-3) / (F.expm1(b) + 1e-3)).alias("back"))
