"""Queries on identity, evidence, feature search, order and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import annotation as an
from ..operators import matrix as mx
from ..operators import grids
from ..operators import models as md
from ..operators import resampling as rs
from ..operators import stats as st
from ..sources.tables import parquet
from .modelling import H
from .registry import query


@query("""WITH h AS (SELECT p_name AS alias, min(p_brand) AS c FROM part WHERE p_size < 8 GROUP BY 1 HAVING count(DISTINCT p_brand) = 1)
SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN p_name WHEN p_name = 'small ring' THEN 'RING1' ELSE coalesce(c, p_name) END AS canonical FROM part LEFT JOIN h ON alias = p_name""")
def canonical_symbols(spark, d):
    p = parquet(spark, d, "part")
    hits = p.where("p_size < 8").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("canonical"))
    curated = spark.createDataFrame([("small ring", "RING1")], "alias string, canonical string")
    return an.canonical_symbols(p.select("p_partkey", "p_name"), "p_name", hits, curated, "^red").select("p_partkey", "canonical")


@query("""WITH t AS (SELECT l_orderkey AS probe, l_returnflag AS strand, min(l_suppkey % 5) AS gene FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey % 5) = 1), k AS (SELECT t.*, a.symbol FROM t LEFT JOIN (SELECT o_orderkey, o_custkey % 5 AS symbol FROM orders WHERE o_orderstatus <> 'P') a ON probe = o_orderkey),
v AS (SELECT strand FROM k GROUP BY 1 ORDER BY count(*) FILTER (gene = symbol) DESC, strand LIMIT 1) SELECT probe, gene FROM k JOIN v USING (strand) WHERE symbol IS NULL OR symbol = gene""")
def probe_genes(spark, d):
    hits = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("probe"), F.col("l_returnflag").alias("strand"), (F.col("l_suppkey") % 5).alias("gene"))
    told = parquet(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("probe"), (F.col("o_custkey") % 5).alias("symbol"))
    return an.probe_genes(hits, told)


@query("WITH s AS (SELECT p_partkey AS gene, 'size' AS s FROM part WHERE p_size > 45 UNION SELECT p_partkey, 'price' FROM part WHERE p_retailprice > 940 UNION SELECT l_partkey, 'sold' FROM lineitem WHERE l_quantity > 49) SELECT gene, string_agg(s, '+' ORDER BY s) AS sources FROM s GROUP BY 1")
def exclusion_with_sources(spark, d):
    p = parquet(spark, d, "part").withColumnRenamed("p_partkey", "gene")
    sold = parquet(spark, d, "lineitem").where("l_quantity > 49").withColumnRenamed("l_partkey", "gene")
    return an.with_sources({"size": p.where("p_size > 45"), "price": p.where("p_retailprice > 940"), "sold": sold}, "gene")


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(translate(lower(text), chr(0), ' '), '[^a-z0-9]+')) AS w FROM documents), t AS (SELECT unnest(['la', 'the', 'License', 'EMAIL', 'qqqq']) AS term), n AS (SELECT w, count(DISTINCT doc_id) AS n FROM w GROUP BY 1)
SELECT term, coalesce(n, 0) AS documents, coalesce(n, 0) >= 5 AS flagged FROM t LEFT JOIN n ON lower(term) = w""")
def literature_flag(spark, d):
    terms = spark.createDataFrame([("la",), ("the",), ("License",), ("EMAIL",), ("qqqq",)], "term string")
    return an.literature_counts(parquet(spark, d, "documents"), "doc_id", "text", terms, 5)


@query("WITH e AS (SELECT p_partkey AS gene, p_size - 25 AS way, CASE p_type WHEN 'ECONOMY' THEN 'inhibitor' WHEN 'STANDARD' THEN 'activator' END AS action, p_retailprice > 920 AS approved FROM part) SELECT gene, (way > 0 AND action = 'inhibitor') OR (way < 0 AND action = 'activator') AS restores, approved FROM e WHERE action IS NOT NULL")
def drug_direction(spark, d):
    action = F.when(F.col("p_type") == "ECONOMY", "inhibitor").when(F.col("p_type") == "STANDARD", "activator")
    p = parquet(spark, d, "part").select(F.col("p_partkey").alias("gene"), an.restores(F.col("p_size") - 25, action).alias("restores"), (F.col("p_retailprice") > 920).alias("approved"))
    return p.where("restores is not null")


@query("SELECT p_brand, 2.0 * max(CAST(p_size > 40 AS INT)) + 1.0 * max(CAST(p_retailprice > 940 AS INT)) AS priority FROM part GROUP BY 1")
def composite_priority(spark, d):
    p = parquet(spark, d, "part").withColumn("large", F.col("p_size") > 40).withColumn("dear", F.col("p_retailprice") > 940)
    return an.prioritised(p, "p_brand", {"large": 2.0, "dear": 1.0}).select("p_brand", "priority")


@query("""WITH n AS (SELECT p_partkey, sign(p_size - 25) AS need FROM part WHERE p_size <> 25), s AS (SELECT DISTINCT l_suppkey AS term, l_partkey AS gene, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END AS way FROM lineitem),
g AS (SELECT term, count(*) FILTER (way = need) AS r, count(*) FILTER (way = -need) AS w FROM s JOIN n ON gene = p_partkey GROUP BY 1), k AS (SELECT *, r + w AS n, unnest(range(r, r + w + 1)) AS k FROM g),
p AS (SELECT term, r, w, least(1.0, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))) AS p FROM k GROUP BY 1, 2, 3), q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM p)
SELECT term, r AS "right", w AS wrong, round(p, 9) AS p, round(least(1.0, min(raw) OVER (ORDER BY p DESC, raw DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM q""")
def direction_reversal(spark, d):
    need = parquet(spark, d, "part").where("p_size <> 25").select(F.col("p_partkey").alias("gene"), F.sign(F.col("p_size") - 25).cast("int").alias("way"), F.lit(0.5).alias("chance"))
    s = parquet(spark, d, "lineitem").select(F.col("l_suppkey").alias("term"), F.col("l_partkey").alias("gene"), F.when(F.col("l_partkey") % 2 == 0, 1).otherwise(-1).alias("way")).distinct()
    hits = an.reversal(s, need).select("term", "right", "wrong")
    tested = st.adjusted(hits.withColumn("p", st.sign_test_p("right", "wrong")), "p")  # every gene's chance is one half
    return tested.select("term", "right", "wrong", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query("SELECT l_suppkey, r, CASE WHEN r >= 0.85 THEN 'likely' WHEN r >= 0.6 THEN 'probable' WHEN r IS NOT NULL THEN 'unlikely' END AS verdict FROM (SELECT l_suppkey, corr(l_extendedprice, l_quantity) AS r FROM lineitem GROUP BY 1)")
def correlation_verdict(spark, d):
    g = parquet(spark, d, "lineitem").groupBy("l_suppkey").agg(st.correlation("l_extendedprice", "l_quantity").alias("r"))
    return g.withColumn("verdict", an.correlation_verdict(F.col("r")))


@query("WITH b AS (SELECT p_brand, avg(CAST(p_size > 20 AS DOUBLE)) AS v FROM part GROUP BY 1), a AS (SELECT p_brand, avg(CAST(p_size > 20 AS DOUBLE)) AS v FROM part WHERE p_name NOT LIKE 'red%' GROUP BY 1) SELECT p_brand, b.v AS before, a.v AS after, coalesce(b.v, 0) - coalesce(a.v, 0) AS lost FROM b FULL JOIN a USING (p_brand)")
def clean_reaggregation(spark, d):
    p = parquet(spark, d, "part")
    rate = F.avg((F.col("p_size") > 20).cast("double")).alias("v")
    return an.before_after(p.groupBy("p_brand").agg(rate), p.where("p_name not like 'red%'").groupBy("p_brand").agg(rate), "p_brand", "v")


@query(f"""WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)), x AS (SELECT e.b, u.user_id, count(*) AS times FROM (SELECT *, unnest(range(40)) AS b FROM u) e JOIN u ON u.i = {H("0", "e.b", "e.i")} % e.n GROUP BY 1, 2),
g AS (SELECT b, event_type, abs(sum(value * times) FILTER (user_id % 2 = 1) / sum(times) FILTER (user_id % 2 = 1) - sum(value * times) FILTER (user_id % 2 = 0) / sum(times) FILTER (user_id % 2 = 0)) AS e FROM events JOIN x USING (user_id) GROUP BY 1, 2),
t AS (SELECT event_type FROM g WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY b ORDER BY e DESC, event_type) <= 2) SELECT event_type, count(*) / 40.0 AS frequency FROM t GROUP BY 1""")
def selection_stability(spark, d):
    e = parquet(spark, d, "events").withColumn("y", F.col("user_id") % 2)
    return rs.selection_stability(e, "user_id", "event_type", "value", "y", 2, 40)


@query(f"""WITH q AS (SELECT l_partkey AS f, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT f, n, unnest(range(60)) AS draw FROM q), k AS (SELECT draw, sum(n) AS v FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY draw ORDER BY {H("0", "draw", "f")}, f) <= 20) GROUP BY 1)
SELECT count(v) AS draws, (count(*) FILTER (v >= 620.0) + 1) / CAST(count(v) + 1 AS DOUBLE) AS p, (620.0 - avg(v)) / stddev_samp(v) AS z FROM k""")
def random_subset_sum(spark, d):
    q = parquet(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("f")).agg(F.count("*").alias("n"))
    return rs.empirical_p(rs.random_sets(q, "f", 20, 60).join(q, "f").groupBy("draw").agg(F.sum("n").alias("v")), "v", 620.0)


AUC = "(sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / CAST(sum(y) * sum(1 - y) AS DOUBLE)"
FEATURES = "e AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS f, CAST(unnest(embedding) AS DOUBLE) AS v, label % 2 AS y FROM embeddings WHERE label IS NOT NULL)"


def _ranked(keys: str, value: str, rows: str) -> str:
    return f"SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0 AS r FROM {rows}"


def _features(spark, d):
    e = parquet(spark, d, "embeddings").where("label is not null")
    return e.select("vec_id", F.posexplode("embedding").alias("f", "v"), (F.col("label") % 2).alias("y")).select("vec_id", (F.col("f") + 1).alias("f"), F.col("v").cast("double").alias("v"), "y")


@query(f"""WITH {FEATURES}, s AS (SELECT f, {AUC} AS auc FROM ({_ranked("f", "v", "e")}) GROUP BY 1), c AS (SELECT a.f AS a, b.f AS b, a.v + b.v AS v, a.y FROM e a JOIN e b USING (vec_id) WHERE a.f < b.f), p AS (SELECT a, b, {AUC} AS auc FROM ({_ranked("a, b", "v", "c")}) GROUP BY 1, 2)
SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, p.auc, p.auc - greatest(x.auc, z.auc) AS synergy FROM p JOIN s x ON x.f = a JOIN s z ON z.f = b""")
def pair_synergy(spark, d):
    e = _features(spark, d)
    single = st.two_group_auc(e, "v", "y", ["f"]).select(F.col("f").alias("feature"), "auc")
    wide = parquet(spark, d, "embeddings").where("label is not null").select("vec_id", "embedding", (F.col("label") % 2).alias("y"))
    pairs = md.pair_areas(wide.join(wide.select("vec_id", F.col("embedding").alias("other")), "vec_id"), "embedding", "other", "y")  # all pairs of a panel
    gain = md.combo_gain(single, pairs.select(F.array(F.col("a") + 1, F.col("b") + 1).alias("members"), "auc"))
    return gain.select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b"), "auc", "synergy")


@query(f"WITH {FEATURES}, c AS (SELECT f AS k, y, sum(v) OVER (PARTITION BY vec_id ORDER BY f) AS v FROM e) SELECT CAST(k AS INT) AS k, {AUC} AS auc FROM ({_ranked('k', 'v', 'c')}) GROUP BY 1")
def incremental_curve(spark, d):
    c = _features(spark, d).select(F.col("f").alias("k"), "y", F.sum("v").over(Window.partitionBy("vec_id").orderBy("f")).alias("v"))
    return st.two_group_auc(c, "v", "y", ["k"]).select("k", "auc")


@query(f"WITH {FEATURES}, c AS (SELECT f, y, sum(v) OVER (PARTITION BY vec_id) AS t, v FROM e), l AS (SELECT f, y, t - v AS v FROM c), w AS (SELECT {AUC} AS a FROM (SELECT y, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS r FROM c WHERE f = 1)) SELECT CAST(f AS INT) AS f, any_value(a) - {AUC} AS delta FROM ({_ranked('f', 'v', 'l')}), w GROUP BY 1")
def leave_one_feature_out(spark, d):
    c = _features(spark, d).withColumn("t", F.sum("v").over(Window.partitionBy("vec_id")))
    whole = st.two_group_auc(c.where("f = 1"), "t", "y", []).select(F.col("auc").alias("_a"))
    left = st.two_group_auc(c.withColumn("v", F.col("t") - F.col("v")), "v", "y", ["f"])
    return left.join(F.broadcast(whole)).select("f", (F.col("_a") - F.col("auc")).alias("delta"))  # one row


@query(f"""WITH {FEATURES}, t AS (SELECT vec_id, y, sum(v) AS t FROM e WHERE f <= 4 GROUP BY 1, 2), w AS (SELECT {AUC} AS a FROM (SELECT y, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS r FROM t)),
s AS (SELECT p.f AS slot, c.f AS candidate, t.y, t - p.v + c.v AS v FROM t JOIN e p USING (vec_id) JOIN e c USING (vec_id) WHERE p.f <= 4 AND c.f > 4), r AS (SELECT slot, candidate, {AUC} AS auc FROM ({_ranked('slot, candidate', 'v', 's')}) GROUP BY 1, 2)
SELECT CAST(slot AS INT) AS slot, CAST(candidate AS INT) AS candidate, auc FROM r, w WHERE auc >= a - 0.002""")
def replacement_screen(spark, d):
    e = _features(spark, d)  # slots: the panel of the first four; candidates: all others
    panel = e.where("f <= 4").withColumn("t", F.sum("v").over(Window.partitionBy("vec_id")))
    base = st.two_group_auc(panel.where("f = 1"), "t", "y", []).select(F.col("auc").alias("_a"))
    other = e.where("f > 4").select("vec_id", F.col("f").alias("candidate"), F.col("v").alias("w"))
    swapped = panel.join(other, "vec_id").select(F.col("f").alias("slot"), "candidate", (F.col("t") - F.col("v") + F.col("w")).alias("v"), "y")
    return st.two_group_auc(swapped, "v", "y", ["slot", "candidate"]).join(F.broadcast(base)).where("auc >= _a - 0.002").select("slot", "candidate", "auc")  # one row


@query()
def forward_selection(spark, d):
    """The first three of all dimensions."""
    e = _features(spark, d)
    n = e.agg(F.max("f")).first()[0] or 0

    def score(sets):
        grid = spark.createDataFrame([(k, f) for k, s in enumerate(sets) for f in s], "candidate int, f int")
        sums = e.join(F.broadcast(grid), "f").groupBy("candidate", "vec_id", "y").agg(F.sum("v").alias("v"))  # features x candidates
        return st.two_group_auc(sums, "v", "y", ["candidate"]).select("candidate", F.col("auc").alias("score"))

    return spark.createDataFrame(md.forward_selection(score, list(range(1, n + 1)), 3), "added int, score double")


@query()
def decontamination_fixpoint(spark, d):
    """Orders whose price stays within 1.8 standard deviations of the mean of their priority, once none falls out any more."""

    def step(now):
        return mx.z_within(now, "o_totalprice", ["o_orderpriority"], "_z").where("abs(_z) <= 1.8").drop("_z")

    return md.until_stable(parquet(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), step, "o_orderkey")[0]


@query()
def covariate_adjustment(spark, d):
    o = parquet(spark, d, "orders").select("o_orderstatus", (F.col("o_orderpriority") < "3").cast("int").alias("y"), "o_totalprice", (F.col("o_custkey") % 10).alias("age"))
    return grids.covariate_models(o, ["o_orderstatus"], "y", "o_totalprice", ["age"])


@query("""WITH g AS (SELECT o_orderstatus, 'all' AS rows_of, CAST(substr(o_orderpriority, 1, 1) AS INT) AS stage, o_totalprice AS s FROM orders UNION ALL SELECT o_orderstatus, 'cases', CAST(substr(o_orderpriority, 1, 1) AS INT), o_totalprice FROM orders WHERE substr(o_orderpriority, 1, 1) > '1'),
r AS (SELECT *, rank() OVER (PARTITION BY o_orderstatus, rows_of ORDER BY stage) + (count(*) OVER (PARTITION BY o_orderstatus, rows_of, stage) - 1) / 2.0 AS a, rank() OVER (PARTITION BY o_orderstatus, rows_of ORDER BY s) + (count(*) OVER (PARTITION BY o_orderstatus, rows_of, s) - 1) / 2.0 AS b FROM g) SELECT o_orderstatus, rows_of, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1, 2""")
def dose_response(spark, d):
    stage = F.substring("o_orderpriority", 1, 1).cast("int")
    kinds = F.when(stage > 1, F.array(F.lit("all"), F.lit("cases"))).otherwise(F.array(F.lit("all")))
    o = parquet(spark, d, "orders").select("o_orderstatus", F.explode(kinds).alias("rows_of"), stage.alias("stage"), F.col("o_totalprice").alias("s"))
    return st.spearman(o, "stage", "s", ["o_orderstatus", "rows_of"])


@query("WITH m AS (SELECT o_orderstatus, o_custkey % 2 AS y, median(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a.o_orderstatus, a.m - b.m AS difference FROM m a JOIN m b USING (o_orderstatus) WHERE a.y = 1 AND b.y = 0 AND a.n >= 3 AND b.n >= 3")
def region_contrast(spark, d):
    m = parquet(spark, d, "orders").groupBy("o_orderstatus").agg(*[F.expr(f"median(case when o_custkey % 2 = {y} then o_totalprice end)").alias(f"m{y}") for y in (0, 1)], *[F.count(F.when(F.col("o_custkey") % 2 == y, 1)).alias(f"n{y}") for y in (0, 1)])
    return m.where("n0 >= 3 and n1 >= 3").select("o_orderstatus", (F.col("m1") - F.col("m0")).alias("difference"))


@query("WITH c AS (SELECT o_orderpriority AS cohort, o_orderstatus AS model, avg(o_totalprice) AS auc FROM orders GROUP BY 1, 2) SELECT cohort, max(auc) FILTER (model = 'F') - max(auc) FILTER (model = 'O') AS gap FROM c GROUP BY 1")
def model_gap_per_cohort(spark, d):
    wide = parquet(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cohort")).pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return wide.select("cohort", (F.col("F") - F.col("O")).alias("gap"))


@query("SELECT p_brand, split_part(p_name, ' ', 1) AS prefix, count(*) AS n, quantile_cont(p_size, 0.25) AS low, median(p_size) AS middle, quantile_cont(p_size, 0.75) AS high FROM part GROUP BY 1, 2")
def prefix_quantiles(spark, d):
    q = F.percentile("p_size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = parquet(spark, d, "part").groupBy("p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"), q.alias("q"))
    return g.select("p_brand", "prefix", "n", *[F.col("q")[k].alias(c) for k, c in enumerate(("low", "middle", "high"))])


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) <= 5")
def capped_candidates(spark, d):
    return mx.top_n(parquet(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.abs("c_acctbal").desc(), "c_custkey"], 5).drop("rank")


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 9 END, c_custkey DESC LIMIT 40")
def ordinal_sort(spark, d):
    order = F.coalesce(F.try_element_at(F.create_map(F.lit("MACHINERY"), F.lit(0), F.lit("BUILDING"), F.lit(1)), F.col("c_mktsegment")), F.lit(9))
    return parquet(spark, d, "customer").orderBy(order, F.desc("c_custkey")).limit(40).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS in_large, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) AS in_cheap FROM part")
def set_membership_flags(spark, d):
    li, out = parquet(spark, d, "lineitem"), parquet(spark, d, "part").select("p_partkey")
    for name, rows in (("in_large", li.where("l_quantity > 49")), ("in_cheap", li.where("l_discount > 0.09"))):
        members = rows.select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias(name)).distinct()
        out = out.join(members, "p_partkey", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query("SELECT vec_id, embedding[1] + embedding[2] AS a, quality, toxic FROM embeddings LEFT JOIN labels ON doc_id = vec_id")
def column_concat(spark, d):
    e = parquet(spark, d, "embeddings").select("vec_id", (F.col("embedding")[0] + F.col("embedding")[1]).alias("a"))
    return e.join(parquet(spark, d, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id", "left").select("vec_id", "a", "quality", "toxic")


@query("SELECT count(*) * 1.0 AS tests, 0.05 / count(*) AS threshold, count(*) FILTER (p < 0.05 / n) AS kept FROM (SELECT (p_size % 47 + 1) / 20000.0 AS p, count(*) OVER () AS n FROM part)")
def bonferroni(spark, d):
    p = parquet(spark, d, "part").select(((F.col("p_size") % 47 + 1) / F.lit(20000.0)).alias("p"))
    n = p.agg(F.count("*").alias("n"))
    return p.join(F.broadcast(n)).agg(F.count("*").cast("double").alias("tests"), (F.lit(0.05) / F.count("*")).alias("threshold"), F.count(F.when(F.col("p") < 0.05 / F.col("n"), 1)).alias("kept"))  # one row


@query("SELECT user_id, bool_and(event_type = 'click') AS all_click, bool_or(event_type = 'error') AS any_error, count(DISTINCT event_type) = 1 AS all_equal, mode(user_id % 3) AS kind FROM events GROUP BY 1")
def conditions_per_group(spark, d):
    return parquet(spark, d, "events").groupBy("user_id").agg(F.bool_and(F.col("event_type") == "click").alias("all_click"), F.bool_or(F.col("event_type") == "error").alias("any_error"), (F.count_distinct("event_type") == 1).alias("all_equal"), F.mode(F.col("user_id") % 3).alias("kind"))


@query("SELECT c_custkey, len(regexp_extract_all(c_name || '#' || c_mktsegment, '[0-9]')) AS digits, regexp_extract(c_name, '#0*([0-9]+)', 1) AS number, array_to_string(list_slice(string_split(c_name || '-a-b', '-'), 1, 2), '-') AS short, round(c_acctbal / 7, 2) AS rounded, c_name LIKE '%1' AS ends FROM customer")
def regex_extraction(spark, d):
    parts = F.split(F.concat("c_name", F.lit("-a-b")), "-")
    digits = F.size(F.regexp_extract_all(F.concat("c_name", F.lit("#"), "c_mktsegment"), F.lit("[0-9]"), F.lit(0)))
    return parquet(spark, d, "customer").select("c_custkey", digits.alias("digits"), F.regexp_extract("c_name", "#0*([0-9]+)", 1).alias("number"), F.array_join(F.slice(parts, 1, 2), "-").alias("short"), F.round(F.col("c_acctbal") / 7, 2).alias("rounded"), F.col("c_name").endswith("1").alias("ends"))


@query("SELECT event_id, list_contains(['error', 'click'], event_type) AS listed, array_to_string(list_sort(list_distinct([event_type, 'click'])), '+') AS members, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS code FROM events WHERE event_type <> 'click'")
def array_and_map_functions(spark, d):
    kind = F.col("event_type")
    code = F.coalesce(F.try_element_at(F.create_map(F.lit("click"), F.lit(1), F.lit("error"), F.lit(2)), kind), F.lit(0))
    return parquet(spark, d, "events").where(kind != "click").select("event_id", kind.isin("error", "click").alias("listed"), F.array_join(F.array_sort(F.array_distinct(F.array(kind, F.lit("click")))), "+").alias("members"), code.alias("code"))
