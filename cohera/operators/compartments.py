"""Cell-type scores, principal components of marker sets, batch correction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .ranks import joined, largest_group, with_midrank
from .stats import correlation


def module_scores(df: DataFrame, sample: str, feature: str, value: str, markers: DataFrame, kind: str) -> DataFrame:
    """Mean, per sample and kind, of the z scores (population spread, 1e-8 added) of the kind's markers. Only marker features are standardised."""
    m = df.join(markers.select(feature).distinct(), feature, "left_semi")
    spread = m.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = joined(m, spread, [feature]).withColumn("_z", (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-8))
    return z.join(markers.select(feature, kind), feature).groupBy(sample, kind).agg(F.avg("_z").alias("score"))


def best_kind(scores: DataFrame, sample: str, kind: str) -> DataFrame:
    """The kind of highest score per sample; ties go to the smaller name."""
    return scores.where("score is not null").groupBy(sample).agg(F.min(F.struct((-F.col("score")).alias("_o"), F.col(kind))).alias("_b")).select(sample, f"_b.{kind}")


def nearest_centroid(df: DataFrame, sample: str, feature: str, value: str, centroids: DataFrame, kind: str, reference: str) -> DataFrame:
    """Spearman of every sample with every kind's centroid over the features they share; the best kind and its rho."""
    j = df.select(sample, feature, value).join(centroids.select(feature, kind, reference), feature)
    size = largest_group(j, [sample, kind])
    r = with_midrank(with_midrank(j, value, [sample, kind], "_a", size=size), reference, [sample, kind], "_b", size=size)
    # twice a midrank is a whole number, so sums are exact and kinds of equal correlation are equal: ties go to the smaller kind whatever the order of the rows
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    a, b = (F.when(known, 2 * F.col(c)).cast("decimal(19,0)") for c in ("_a", "_b"))
    sums = r.groupBy(sample, kind).agg(*[F.sum(x).alias(name) for x, name in ((a, "_x"), (b, "_y"), (a * b, "_xy"), (a * a, "_xx"), (b * b, "_yy"))], F.count(a).alias("_n"))
    n = F.col("_n").cast("decimal(10,0)")
    moment = lambda xy, x, y: (n * F.col(xy).cast("decimal(27,0)") - F.col(x).cast("decimal(18,0)") * F.col(y).cast("decimal(18,0)")).cast("double")
    rho = sums.select(sample, kind, F.try_divide(moment("_xy", "_x", "_y"), F.sqrt(moment("_xx", "_x", "_x") * moment("_yy", "_y", "_y"))).alias("score"))
    return best_kind(rho, sample, kind).join(rho, [sample, kind]).withColumnRenamed("score", "rho")


def _known(c: str) -> Column:
    """A number, null where it is missing or NaN."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def first_component(df: DataFrame, sample: str, feature: str, value: str, markers: DataFrame, kind: str) -> DataFrame:
    """First principal component of every marker set over the samples: unit variance, sign of the mean marker. Missing values count as the marker's mean.

    Products of marker pairs are summed over the samples in Spark; only the markers x markers sums of a kind come to one group, and weights join back to the rows.
    """
    rows = df.join(markers.select(feature, kind), feature).select(kind, sample, feature, _known(value).alias("_v")).where("_v is not null").groupBy(kind, sample, feature).agg(F.avg("_v").alias("_v"))
    mean = rows.groupBy(kind, feature).agg(F.avg("_v").alias("_m"))
    x = rows.join(mean, [kind, feature]).select(kind, sample, feature, (F.col("_v") - F.col("_m")).alias("_x"))
    pairs = x.join(x.select(kind, sample, F.col(feature).alias("_g"), F.col("_x").alias("_y")), [kind, sample])
    sums = pairs.groupBy(kind, feature, "_g").agg(F.sum(F.col("_x") * F.col("_y")).alias("_c"))
    n = rows.groupBy(kind).agg(F.count_distinct(sample).cast("double").alias("_samples"))
    schema = StructType([markers.schema[kind], df.schema[feature], StructField("_w", DoubleType())])

    def weights(p: pd.DataFrame) -> pd.DataFrame:
        c = p.pivot(index=feature, columns="_g", values="_c").sort_index().sort_index(axis=1).fillna(0.0)
        size, vectors = np.linalg.eigh(c.to_numpy())
        v = vectors[:, -1] * (1.0 if vectors[:, -1] @ c.to_numpy().sum(axis=1) >= 0 else -1.0)
        spread = np.sqrt(max(size[-1], 0.0) / p["_samples"].iloc[0])
        return pd.DataFrame({kind: p[kind].iloc[0], feature: c.index, "_w": v / (spread or 1.0)})

    w = sums.join(n, kind).groupBy(kind).applyInPandas(weights, schema)
    return x.join(w, [kind, feature]).groupBy(kind, sample).agg(F.sum(F.col("_x") * F.col("_w")).alias("score"))


def residualise(df: DataFrame, sample: str, feature: str, value: str, covariates: DataFrame, names: list[str], train: DataFrame | None = None) -> DataFrame:
    """Every feature less its regression on the samples' covariates, fitted on the training samples (all where none are given) and applied to all.

    Means and centred cross products are summed in Spark; one row of sums per feature is solved, and the slopes join back to the rows. A covariate that does
    not vary in the training samples has slope 0; a feature without complete training rows stays as it is.
    """
    rows = df.select(sample, feature, _known(value).alias(value)).join(covariates.select(sample, *[_known(x).alias(x) for x in names]), sample)
    rows = rows.withColumn("_fit", F.lit(True)) if train is None else rows.join(train.select(sample).distinct().withColumn("_fit", F.lit(True)), sample, "left").withColumn("_fit", F.coalesce("_fit", F.lit(False)))
    k, same = len(names), F.col(feature).eqNullSafe(F.col("_feature"))
    used = rows.where("_fit").dropna(subset=[value, *names])
    mean = used.groupBy(F.col(feature).alias("_feature")).agg(F.avg(value).alias("_ym"), *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(names)])
    off = [F.col(x) - F.col(f"_m{i}") for i, x in enumerate(names)]
    products = [F.sum(off[i] * (off[j] if j < k else F.col(value) - F.col("_ym"))).alias(f"_s{i}_{j}") for i in range(k) for j in range(i, k + 1)]
    means = ["_ym", *[f"_m{i}" for i in range(k)]]
    sums = used.join(mean, same).groupBy("_feature", *means).agg(*products)
    schema = StructType([StructField("_feature", df.schema[feature].dataType), *[StructField(c, DoubleType()) for c in [*means, *[f"_b{i}" for i in range(k)]]]])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            xx = np.empty((len(p), k, k))
            for i in range(k):
                for j in range(i, k):
                    xx[:, i, j] = xx[:, j, i] = p[f"_s{i}_{j}"]
            size = np.sqrt(np.einsum("nii->ni", xx))
            size = np.where(size > 0, size, 1.0)
            xy = np.stack([p[f"_s{i}_{k}"].to_numpy(dtype=float) for i in range(k)], axis=1) / size
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(xx / size[:, :, None] / size[:, None, :], rcond=1e-10, hermitian=True), xy) / size
            yield p[["_feature", *means]].assign(**{f"_b{i}": beta[:, i] for i in range(k)})

    fitted = rows.join(sums.mapInPandas(solve, schema), same, "left")
    move = sum((F.col(f"_b{i}") * c for i, c in enumerate(off)), F.lit(0.0))
    return fitted.select(sample, feature, F.when(F.col("_ym").isNull(), F.col(value)).otherwise(F.col(value) - move).alias("residual"))


def combat(df: DataFrame, sample: str, feature: str, value: str, batch: str) -> DataFrame:
    """Parametric empirical-Bayes batch correction without covariates; all variances are population variances of at least 1e-8.

    Moments per feature and batch are aggregates; the fixed point of a batch runs over its vector of features as one group
    (features, not samples), and the adjustment is a join. With one feature variances are not shrunk.
    """
    floor = F.lit(1e-8)
    per = df.groupBy(feature, batch).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    grand = per.groupBy(feature).agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_g"), F.sqrt(F.greatest(F.sum(F.col("_n") * F.col("_v")) / F.sum("_n"), floor)).alias("_sd"))
    std = per.join(grand, feature).select(feature, batch, F.col("_n").cast("double"), ((F.col("_m") - F.col("_g")) / F.col("_sd")).alias("_gamma"), (F.col("_v") / F.col("_sd") ** 2).alias("_delta"))
    schema = StructType([df.schema[feature], df.schema[batch], StructField("_gs", DoubleType()), StructField("_ds", DoubleType())])

    def shrink(p: pd.DataFrame) -> pd.DataFrame:
        n, g, v = (p[c].to_numpy(dtype=float) for c in ("_n", "_gamma", "_delta"))
        d = np.maximum(v, 1e-8)
        gs, ds, mean, s2 = g, d, d.mean(), d.var()
        for _ in range(500 if s2 > 0 else 0):
            g1 = (g.var() * n * g + ds * g.mean()) / (g.var() * n + ds)
            d1 = ((mean * s2 + mean**3) / s2 + 0.5 * n * (v + (g - g1) ** 2)) / (n / 2 + (2 * s2 + mean**2) / s2 - 1)
            change = max((np.abs(g1 - gs) / (np.abs(gs) + 1e-12)).max(), (np.abs(d1 - ds) / (np.abs(ds) + 1e-12)).max())
            gs, ds = g1, d1
            if change <= 1e-4:
                break
        return pd.DataFrame({feature: p[feature], batch: p[batch], "_gs": gs, "_ds": ds})

    fixed = std.groupBy(batch).applyInPandas(shrink, schema)
    j = df.join(grand, feature).join(fixed, [feature, batch], "left")
    z = (F.col(value) - F.col("_g")) / F.col("_sd")
    new = F.coalesce((z - F.col("_gs")) / F.sqrt("_ds") * F.col("_sd") + F.col("_g"), F.col(value))
    return j.select(sample, feature, batch, new.alias("adjusted"))


def array_quality(df: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """Pearson correlation of each array with the median profile, over the upper half of the features by median."""
    med = df.groupBy(feature).agg(F.median(value).alias("_m"))
    cut = med.agg(F.median("_m").alias("_c"))
    upper = med.join(F.broadcast(cut)).where("_m >= _c")  # one row
    return df.join(upper, feature).groupBy(sample).agg(correlation(value, "_m").alias("r"))
