"""Identity of features, evidence about them and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import poisson_binomial_tail


def canonical_symbols(df: DataFrame, symbol: str, hits: DataFrame, curated: DataFrame, stable: str = "^ENSG[0-9]+") -> DataFrame:
    """Adds canonical: stable ids stay, curated names (alias, canonical) come first, then hits whose alias names one symbol alone, else the symbol itself."""
    sole = hits.groupBy(F.col("alias").alias(symbol)).agg(F.count_distinct("canonical").alias("_n"), F.min("canonical").alias("_hit")).where("_n = 1").drop("_n")
    named = curated.groupBy(F.col("alias").alias(symbol)).agg(F.min("canonical").alias("_curated"))
    out = df.join(named, symbol, "left").join(sole, symbol, "left")
    found = F.when(F.col(symbol).rlike(stable), F.col(symbol)).otherwise(F.coalesce("_curated", "_hit", symbol))
    return out.withColumn("canonical", found).drop("_curated", "_hit")


def probe_genes(hits: DataFrame, annotated: DataFrame) -> DataFrame:
    """probe, gene of probes that hit (probe, strand, gene) one gene alone on the strand that agrees most often with the annotation (probe, symbol).

    An annotated symbol of another gene vetoes its probe; probes without annotation stay. Of strands that agree equally often the least is taken.
    """
    sole = hits.groupBy("strand", "probe").agg(F.count_distinct("gene").alias("_n"), F.min("gene").alias("gene")).where("_n = 1").drop("_n")
    known = annotated.where("symbol is not null").groupBy("probe").agg(F.min("symbol").alias("_s"))
    told = sole.join(known, "probe", "left")
    votes = told.groupBy("strand").agg(F.count(F.when(F.col("gene") == F.col("_s"), 1)).alias("_agree"))
    best = votes.agg(F.min_by("strand", F.struct(-F.col("_agree"), "strand")).alias("strand"))
    return told.join(F.broadcast(best), "strand").where("_s is null or gene = _s").select("probe", "gene")  # one row


def with_sources(named: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys of any source, with the names of all their sources in order, joined by +."""
    rows = [df.select(key, F.lit(name).alias("_source")) for name, df in named.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("_source")), "+").alias("sources"))


MOST_TERMS = 2000  # that are sent to every task as one array


def literature_counts(docs: DataFrame, doc: str, text: str, terms: DataFrame, least: int) -> DataFrame:
    """term, documents (that hold it as a word, in any case), flagged (at least `least`). Up to MOST_TERMS terms are looked for in each text's own words before
    anything is exploded; more terms are joined to the words. Either way it is one pass."""
    wanted = terms.select("term", F.lower("term").alias("_w"))
    own = F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))
    few = [r[0] for r in wanted.select("_w").distinct().limit(MOST_TERMS + 1).collect()]
    if len(few) <= MOST_TERMS:
        own = F.array_intersect(own, F.array(*[F.lit(w) for w in few]) if few else F.array().cast("array<string>"))
    words = docs.select(F.col(doc).alias("_d"), F.explode(own).alias("_w"))
    n = words.join(wanted.select("_w").distinct(), "_w").groupBy("_w").agg(F.count_distinct("_d").alias("_n"))
    n = wanted.join(n, "_w", "left").withColumn("documents", F.coalesce("_n", F.lit(0)))
    return n.select("term", "documents", (F.col("documents") >= least).alias("flagged"))


def restores(direction: Column, action: Column) -> Column:
    """Whether an action undoes a change: activators what is down, inhibitors what is up; null for other actions or no change."""
    sign = F.when(action.rlike("(?i)activator|agonist|inducer") & ~action.rlike("(?i)antagonist"), 1).when(action.rlike("(?i)inhibitor|antagonist|blocker"), -1)
    return sign * F.sign(direction) < 0


def prioritised(pairs: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Per key the weighted sum of flags that any of its rows has (null counts as no)."""
    flags = pairs.groupBy(key).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in weights])
    score = sum((F.col(c).cast("double") * w for c, w in weights.items()), F.lit(0.0))
    return flags.withColumn("priority", score)


def reversal(signatures: DataFrame, need: DataFrame) -> DataFrame:
    """term, right, wrong, p: signature genes (term, gene, way) with the way that is needed (gene, way, chance), those against it, and the tail of as many right hits by chance."""
    hit = signatures.join(need.withColumnRenamed("way", "_need"), "gene")
    g = hit.groupBy("term").agg(F.count(F.when(F.col("way") == F.col("_need"), 1)).alias("right"), F.count(F.when(F.col("way") == -F.col("_need"), 1)).alias("wrong"), F.collect_list("chance").alias("_p"))
    return g.select("term", "right", "wrong", poisson_binomial_tail(F.col("_p"), F.col("right")).alias("p"))


def correlation_verdict(r: Column) -> Column:
    return F.when(r >= 0.85, "likely").when(r >= 0.6, "probable").when(r.isNotNull(), "unlikely")


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Both values of every key of either side and what was lost (a missing side counts 0)."""
    j = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    return j.withColumn("lost", F.coalesce("before", F.lit(0.0)) - F.coalesce("after", F.lit(0.0)))
