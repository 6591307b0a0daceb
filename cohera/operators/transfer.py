"""Panels tried on data that did not choose them: transfer, nested selection, trimming with one dataset held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .draws import hashed
from .matrix import z_against
from .ranks import joined
from .stats import two_group_auc


def mean_difference_weights(train: DataFrame, feature: str, value: str, label: str) -> DataFrame:
    """feature, weight: mean of class 1 less mean of class 0."""
    mean = lambda k: F.avg(F.when(F.col(label) == k, F.col(value)))
    return train.groupBy(feature).agg((mean(1) - mean(0)).alias("weight"))


def zero_shot(train: DataFrame, test: DataFrame, sample: str, feature: str, value: str, label: str, cohort: str) -> DataFrame:
    """cohort, n1, n0, auc: scaling and weights come from the training rows alone and are applied to other cohorts as they are.

    Features that either side lacks take no part. Everything is an aggregate joined back; no cohort is gathered.
    """
    shared = train.select(feature).distinct().join(test.select(feature).distinct(), feature)
    fit = train.join(shared, feature)
    weights = mean_difference_weights(z_against(fit, fit, feature, value, "_z"), feature, "_z", label)
    z = z_against(test, fit, feature, value, "_z").join(weights, feature)
    scores = z.groupBy(cohort, sample, label).agg(F.sum(F.col("_z") * F.col("weight")).alias("_score"))
    return two_group_auc(scores, "_score", label, [cohort]).select(cohort, "n1", "n0", "auc")


def _panel(aucs: DataFrame, feature: str, by: list[str], size: int) -> DataFrame:
    """by, feature, way: the features whose area lies farthest from one half, and the side on which it does."""
    best = Window.partitionBy(*by).orderBy(F.desc(F.round(F.abs(F.col("auc") - 0.5), 12)), feature)  # features of a fold
    top = aucs.where("auc is not null").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= size)
    return top.select(*by, feature, F.signum(F.col("auc") - 0.5).alias("_way"))


def nested_selection(df: DataFrame, sample: str, feature: str, value: str, label: str, fold: str, size: int) -> DataFrame:
    """fixed, nested, optimism (one row): the area of a panel chosen on all samples, that of panels chosen without each fold and tried on it, and their difference.

    Training rows are counted for each fold but their own, so the choice of all folds is one grouped aggregate.
    """
    folds = df.select(fold).distinct().withColumnRenamed(fold, "_held")  # a handful
    train = df.join(F.broadcast(folds), F.col(fold) != F.col("_held"))
    inner = _panel(two_group_auc(train, value, label, ["_held", feature]), feature, ["_held"], size).withColumnRenamed("_held", fold)
    outer = _panel(two_group_auc(df, value, label, [feature]), feature, [], size)
    area = lambda panel, keys, name: two_group_auc(df.join(panel, keys).groupBy(sample, label).agg(F.sum(F.col(value) * F.col("_way")).alias("_s")), "_s", label, []).select(F.col("auc").alias(name))
    both = area(outer, [feature], "fixed").join(F.broadcast(area(inner, [fold, feature], "nested")))  # one row each
    return both.withColumn("optimism", F.col("fixed") - F.col("nested"))


def trim_without_each(df: DataFrame, sample: str, feature: str, value: str, label: str, dataset: str, keep: int) -> list[tuple]:
    """(held-out dataset, step, dropped feature, score): for every dataset in turn, features go one by one, judged on the other datasets only.

    The score of a set is the mean, weighted by samples, of the datasets' areas of its summed values; the feature whose removal scores
    best goes (ties: the smallest). A step is one job for all held-out datasets; the driver sees a row per dataset.
    """
    spark = df.sparkSession
    names = sorted(r[0] for r in df.select(dataset).distinct().collect())  # datasets of a study
    features = sorted(r[0] for r in df.select(feature).distinct().collect())  # a panel
    active, out = {h: list(features) for h in names}, []
    for step in range(len(features) - keep):
        sets = spark.createDataFrame([(h, f) for h in names for f in active[h]], df.select(F.col(dataset).alias("_held"), feature).schema)
        rows = df.join(F.broadcast(sets), feature).where(F.col(dataset) != F.col("_held"))  # datasets x panel
        total = rows.groupBy("_held", dataset, sample).agg(F.sum(value).alias("_t"))
        tried = joined(rows, total, ["_held", dataset, sample]).withColumn("_left", F.col("_t") - F.col(value))
        areas = two_group_auc(tried, "_left", label, ["_held", feature, dataset]).where("auc is not null").withColumn("_n", F.col("n1") + F.col("n0"))
        score = areas.groupBy("_held", feature).agg((F.sum(F.col("auc") * F.col("_n")) / F.sum("_n")).alias("score"))
        best = score.groupBy("_held").agg(F.min(F.struct((-F.round("score", 12)).alias("o"), F.col(feature).alias("f"), F.col("score").alias("s"))).alias("b")).collect()
        for r in sorted(best):
            active[r["_held"]].remove(r["b"]["f"])
            out.append((r["_held"], step, r["b"]["f"], r["b"]["s"]))
    return out


ARMS = ("fixed", "full_data", "pool_fixed", "nested", "random_pool", "random_all")


def decomposition(df: DataFrame, sample: str, feature: str, value: str, label: str, fold: str, fixed: DataFrame, pool: DataFrame, size: int, draws: int, seed: int = 0) -> DataFrame:
    """One row: how much of a panel's held-out area is owed to choosing it on the samples that test it.

    Six arms on shared folds, each a panel tried on the fold that its weights have not seen: `fixed` (a given table of features), full_data (the `size` strongest on all samples), pool_fixed (on the
    training samples, among a given pool), nested (on the training samples, among all), random_pool and random_all (the mean of `draws` panels of least hash). A feature's strength is
    its weight: the difference of class means over the spread of the training samples; a sample's score is the weighted sum of its panel's scaled values. Columns: the arms' mean areas over folds,
    total = fixed - nested and its parts fixed - full_data, full_data - pool_fixed, pool_fixed - nested.

    A fold's training sums are all sums less its own, so every arm, fold and draw comes from one aggregate; panels are rows (arm, draw, fold, feature) and meet the long table once.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(label).isNotNull() & F.col(fold).isNotNull()).select(sample, feature, value, label, fold)
    v, y = F.col(value).cast("double"), F.col(label)
    own = checkpointed(rows.groupBy(fold, feature).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.sum(y).alias("n1"), F.sum(v * y).alias("s1")))
    sums = ["n", "s", "q", "n1", "s1"]
    total = own.groupBy(feature).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    held = own.select(fold).distinct()
    every = held.join(total.select(feature)).join(own, [fold, feature], "left").join(total, feature)  # folds x features
    less = {c: F.col(f"_{c}") - F.coalesce(c, F.lit(0)) for c in sums}

    def weights(table: DataFrame, keys: list[str], of: dict) -> DataFrame:
        spread = F.sqrt(F.greatest(of["q"] / of["n"] - (of["s"] / of["n"]) ** 2, F.lit(0.0)))
        gap = F.try_divide(of["s1"], of["n1"]) - F.try_divide(of["s"] - of["s1"], of["n"] - of["n1"])
        out = table.select(*keys, spread.alias("spread"), F.try_divide(gap, spread).alias("weight"))
        return checkpointed(out.where("weight is not null and spread > 0"))

    train = weights(every, [fold, feature], less)
    whole = weights(total, [feature], {c: F.col(f"_{c}") for c in sums})

    def strongest(table: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(F.round(F.abs("weight"), 12)), feature)  # features of a fold
        return table.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= size)

    def drawn(table: DataFrame) -> DataFrame:
        each = table.select(fold, feature, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
        order = Window.partitionBy(fold, "draw").orderBy(hashed("draw", fold, feature, seed=seed), feature)
        return each.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= size)

    among = train.join(pool.select(feature).distinct(), feature, "left_semi")
    panels = {
        "fixed": train.join(fixed.select(feature).distinct(), feature, "left_semi").withColumn("draw", F.lit(0)),
        "full_data": train.join(strongest(whole, []).select(feature), feature, "left_semi").withColumn("draw", F.lit(0)),
        "pool_fixed": strongest(among, [fold]).withColumn("draw", F.lit(0)),
        "nested": strongest(train, [fold]).withColumn("draw", F.lit(0)),
        "random_pool": drawn(among),
        "random_all": drawn(train),
    }
    chosen = None
    for arm, p in panels.items():
        p = p.select(F.lit(arm).alias("arm"), "draw", fold, feature)
        chosen = p if chosen is None else chosen.union(p)
    terms = rows.join(train, [fold, feature]).withColumn("_term", F.col("weight") * F.col(value) / F.col("spread")).join(chosen, [fold, feature])
    scores = terms.groupBy("arm", "draw", fold, sample, label).agg(F.round(F.sum("_term"), 10).alias("_score"))
    areas = two_group_auc(scores, "_score", label, ["arm", "draw", fold]).where("auc is not null")
    means = areas.groupBy("arm", fold).agg(F.avg("auc").alias("auc")).groupBy("arm").agg(F.avg("auc").alias("auc"))
    one = means.agg(*[F.max(F.when(F.col("arm") == a, F.col("auc"))).alias(a) for a in ARMS])
    gap = lambda a, b: F.col(a) - F.col(b)
    return one.select(*ARMS, gap("fixed", "nested").alias("total"), gap("fixed", "full_data").alias("approximation"), gap("full_data", "pool_fixed").alias("ranking"), gap("pool_fixed", "nested").alias("pooling"))


def forward_swaps(train: DataFrame, cohorts: DataFrame, slots: list[tuple], options: dict, objective: object, sample: str, feature: str, value: str, label: str, cohort: str, least: int = 5) -> list[dict]:
    """Swaps a panel's slots for their replacements one at a time, each time the one that gains most on the objective cohort, as long as any gains.

    slots: (slot, feature) in panel order; options: slot -> replacement. A slot counts in a cohort where both it and the training rows hold the feature that now fills it: a replacement that a cohort lacks
    drops the slot there, it does not bring the old feature back. A state with fewer than `least` slots in the objective cohort is not tried. Weights are the class means' difference of scaled
    training values, so a sample's score is the sum of its slots' terms: terms are made once, and a step is one job in which all candidates are rows (candidate, slot, feature). Steps: step, slot, replacement, gain, areas (by cohort).
    """
    spark = train.sparkSession
    scaled = z_against(train, train, feature, value, "_z")
    weights = mean_difference_weights(scaled, feature, "_z", label).where("weight is not null")
    terms = z_against(cohorts, train, feature, value, "_z").join(weights, feature).where("_z is not null")
    terms = checkpointed(terms.select(cohort, sample, label, F.col(feature).alias("_filled"), (F.col("_z") * F.col("weight")).alias("_term")).repartition(cohort, sample))  # a sample's terms are summed where they lie
    kind = train.schema[feature].dataType.simpleString()
    held = {(r[0], r[1]) for r in terms.select(cohort, "_filled").distinct().join(spark.createDataFrame([(f,) for f in {*(f for _, f in slots), *options.values()}], f"_filled {kind}"), "_filled").select(cohort, "_filled").collect()}  # cohorts x panel

    def areas(states: dict[int, dict], within: DataFrame) -> dict:
        filled = spark.createDataFrame([(k, n, f) for k, active in states.items() for n, f in enumerate(active.get(s, f) for s, f in slots)], f"_state int, _slot int, _filled {kind}")
        scores = within.join(F.broadcast(filled), "_filled").groupBy("_state", cohort, sample, label).agg(F.round(F.sum("_term"), 10).alias("_score"))  # states x panel rows
        return {(r["_state"], r[cohort]): r["auc"] for r in two_group_auc(scores, "_score", label, ["_state", cohort]).collect()}  # a row per state and cohort

    active: dict = {}
    now = areas({0: active}, terms).get((0, objective))
    out: list[dict] = []
    only = terms.where(F.col(cohort) == F.lit(objective))
    while True:
        tries = {k: {**active, s: options[s]} for k, (s, _) in enumerate(slots) if s in options and s not in active}
        tries = {k: a for k, a in tries.items() if sum((objective, a.get(s, f)) in held for s, f in slots) >= least}
        if not tries:
            return out
        found = areas(tries, only)
        gains = [(round(found[k, objective] - (now if now is not None else 0.0), 12), -k) for k in tries if found.get((k, objective)) is not None]
        gain, k = max(gains, default=(0.0, 0))
        if gain <= 0:
            return out
        slot = slots[-k][0]
        active = tries[-k]
        every = {c: a for (_, c), a in areas({0: active}, terms).items()}
        now = every[objective]
        out.append({"step": len(out) + 1, "slot": slot, "replacement": options[slot], "gain": gain, "areas": every})
