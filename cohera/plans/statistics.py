"""Queries on two-group tests, correlations, pooled effects and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as st
from ..sources.tables import parquet
from .catalogue import AUC, HEDGES, LINES, _lines
from .registry import normal_p, query


@query(f"WITH {LINES}, {AUC} SELECT p_brand, greatest(auc, 1 - auc) AS auc FROM auc")
def folded_auc(spark, d):
    return st.two_group_auc(_lines(spark, d), "x", "label", ["p_brand"]).select("p_brand", F.greatest("auc", 1 - F.col("auc")).alias("auc"))


MWU = """r AS (SELECT p_brand, label, rank() OVER (PARTITION BY p_brand ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, y) - 1) / 2.0 AS r, CAST(count(*) OVER (PARTITION BY p_brand, y) AS DOUBLE) AS t FROM lines),
u AS (SELECT p_brand, CAST(sum(label) AS BIGINT) AS n1, CAST(sum(1 - label) AS BIGINT) AS n0, CAST(sum(r) FILTER (label = 1) AS DOUBLE) - sum(label) * (sum(label) + 1) / 2.0 AS u, sum(t * t - 1) AS ties FROM r GROUP BY 1),
z AS (SELECT p_brand, n1, n0, u, sign(u - CAST(n1 AS DOUBLE) * n0 / 2) * greatest(abs(u - CAST(n1 AS DOUBLE) * n0 / 2) - 0.5, 0) / sqrt(CAST(n1 AS DOUBLE) * n0 / 12 * (n1 + n0 + 1 - ties / (CAST(n1 + n0 AS DOUBLE) * (n1 + n0 - 1)))) AS z FROM u)"""


@query(f"WITH {LINES}, {MWU}, {normal_p('z', 'z')} SELECT * FROM p")
def mann_whitney_by_group(spark, d):
    return st.mann_whitney(_lines(spark, d), "y", "label", ["p_brand"])


@query(f"""WITH d AS (SELECT p_brand, l_quantity - 25 AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <> 25), r AS (SELECT p_brand, x, rank() OVER (PARTITION BY p_brand ORDER BY abs(x)) + (count(*) OVER (PARTITION BY p_brand, abs(x)) - 1) / 2.0 AS r, CAST(count(*) OVER (PARTITION BY p_brand, abs(x)) AS DOUBLE) AS t FROM d),
g AS (SELECT p_brand, count(*) AS n, CAST(sum(r) FILTER (x > 0) AS DOUBLE) AS w, sum(t * t - 1) AS ties FROM r GROUP BY 1), z AS (SELECT p_brand, n, w, (w - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM g), {normal_p('z', 'z')} SELECT * FROM p""")
def signed_rank_by_group(spark, d):
    return st.signed_rank(_lines(spark, d).select("p_brand", (F.col("y") - 25).alias("x")), "x", ["p_brand"])


@query("""WITH c AS (SELECT p_brand, count(*) FILTER (p_size <= 2 AND p_type = 'ECONOMY') AS a, count(*) FILTER (p_size <= 2 AND p_type <> 'ECONOMY') AS b, count(*) FILTER (p_size > 2 AND p_type = 'ECONOMY') AS c, count(*) FILTER (p_size > 2 AND p_type <> 'ECONOMY') AS d FROM part GROUP BY 1),
x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM c),
l AS (SELECT p_brand, a, x, lgamma(a + c + 1) - CASE WHEN x = 0 THEN 0 ELSE lgamma(x + 1) END - lgamma(a + c - x + 1) + lgamma(b + d + 1) - lgamma(a + b - x + 1) - lgamma(b + d - (a + b - x) + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + b + 1) - lgamma(c + d + 1)) AS l FROM x),
o AS (SELECT p_brand, any_value(l) FILTER (x = a) AS o FROM l GROUP BY 1) SELECT p_brand, least(1.0, sum(exp(l)) FILTER (exp(l) <= exp(o) * (1 + 1e-7))) AS p FROM l JOIN o USING (p_brand) GROUP BY 1""")
def fisher_exact_by_group(spark, d):
    small, eco = F.col("p_size") <= 2, F.col("p_type") == "ECONOMY"
    n = lambda c: F.count(F.when(c, 1))
    g = parquet(spark, d, "part").groupBy("p_brand").agg(n(small & eco).alias("a"), n(small & ~eco).alias("b"), n(~small & eco).alias("c"), n(~small & ~eco).alias("d"))
    return g.select("p_brand", st.fisher_exact_p("a", "b", "c", "d").alias("p"))


@query("""WITH w AS (SELECT user_id, count(*) FILTER (value > 20) AS w, count(*) FILTER (value < 20) AS l FROM events GROUP BY 1), k AS (SELECT user_id, w + l AS n, unnest(range(w, w + l + 1)) AS k FROM w)
SELECT user_id, least(1.0, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))) AS p FROM k GROUP BY 1""")
def sign_test(spark, d):
    g = parquet(spark, d, "events").groupBy("user_id").agg(F.count(F.when(F.col("value") > 20, 1)).alias("w"), F.count(F.when(F.col("value") < 20, 1)).alias("l"))
    return g.select("user_id", st.sign_test_p("w", "l").alias("p"))


@query()
def poisson_binomial(spark, d):
    p = parquet(spark, d, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_set("p_size")), lambda x: x / 51.0).alias("probs"))
    return p.select("p_brand", *[st.poisson_binomial_tail(F.col("probs"), F.lit(k)).alias(f"p{k}") for k in (0, 3, 5)])


PARTIAL = """r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY x) + (count(*) OVER (PARTITION BY p_brand, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY p_brand ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, y) - 1) / 2.0 AS y, CAST(rank() OVER (PARTITION BY p_brand ORDER BY label) + (count(*) OVER (PARTITION BY p_brand, label) - 1) / 2.0 AS DOUBLE) AS c FROM lines),
m AS (SELECT p_brand, regr_slope(x, c) AS bx, avg(x) AS mx, regr_slope(y, c) AS by, avg(y) AS my, avg(c) AS mc FROM r GROUP BY 1),
e AS (SELECT p_brand, round(x - mx - bx * (c - mc), 9) AS x, round(y - my - by * (c - mc), 9) AS y FROM r JOIN m USING (p_brand)),
k AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY x) + (count(*) OVER (PARTITION BY p_brand, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY p_brand ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, y) - 1) / 2.0 AS y FROM e)"""


@query(f"WITH {LINES}, {PARTIAL} SELECT p_brand, count(*) AS n, corr(x, y) AS rho FROM k GROUP BY 1".replace(" by,", " b_y,").replace("by * (c", "b_y * (c"))
def partial_spearman(spark, d):
    return st.partial_spearman(_lines(spark, d), "x", "y", "label", ["p_brand"])


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS f FROM embeddings), t AS (SELECT vec_id, v AS t FROM e WHERE f = 0), r AS (SELECT f AS feature, count(*) AS n, corr(CAST(v AS DOUBLE), CAST(t AS DOUBLE)) AS r FROM e JOIN t USING (vec_id) WHERE f > 0 GROUP BY 1)
SELECT CAST(feature AS INTEGER) AS feature, n, r FROM r WHERE abs(r) >= 0.02 ORDER BY abs(r) DESC, feature LIMIT 20""")
def pearson_screen(spark, d):
    e = parquet(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "v")).withColumn("v", F.col("v").cast("double"))
    target = e.where("feature = 0").select("vec_id", F.col("v").alias("t"))
    return st.pearson_screen(e.where("feature > 0"), "vec_id", "feature", "v", target, 0.02, 20, alpha=1e6).select("feature", "n", "r")


@query(f"""WITH lines AS (SELECT o_custkey % 5 AS unit, l_shipmode AS p_brand, x, label FROM (SELECT l_orderkey, l_linestatus AS l_shipmode, l_extendedprice AS x, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem) JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT unit, p_brand, avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0) AS v FROM lines GROUP BY 1, 2) SELECT a.unit, a.p_brand, a.v, b.v AS other FROM s a JOIN s b ON a.unit = 0 AND b.unit = 1 AND a.p_brand = b.p_brand AND sign(a.v) = sign(b.v) AND abs(a.v) >= 1 AND abs(b.v) >= 1""")
def sign_replication(spark, d):
    li, o = parquet(spark, d, "lineitem"), parquet(spark, d, "orders")
    x = F.col("l_extendedprice")
    s = li.join(o, li.l_orderkey == o.o_orderkey).groupBy((F.col("o_custkey") % 5).alias("unit"), F.col("l_linestatus").alias("p_brand")).agg((F.avg(F.when(F.col("l_returnflag") == "R", x)) - F.avg(F.when(F.col("l_returnflag") != "R", x))).alias("v"))
    return st.replicated(s.where("unit = 0"), s.where("unit = 1").drop("unit"), ["p_brand"], "v", 1.0).select("unit", "p_brand", "v", "other")


@query("""WITH m AS (SELECT event_type, user_id % 2 AS g, sum(value) / sum(value + 50) AS mu, sum(value) AS c, count(*) AS n FROM events GROUP BY 1, 2), x AS (SELECT e.event_type, sum((value - mu * (value + 50)) ** 2 / (mu * (value + 50))) AS x FROM events e JOIN m ON e.event_type = m.event_type AND e.user_id % 2 = g GROUP BY 1),
r AS (SELECT a.event_type, a.n + b.n AS n, log2(a.mu / b.mu) AS log2fc, x / (a.n + b.n - 2) AS dispersion, 1 / a.c + 1 / b.c AS inv FROM m a JOIN m b ON a.event_type = b.event_type AND a.g = 1 AND b.g = 0 JOIN x ON x.event_type = a.event_type) SELECT event_type, n, log2fc, dispersion, log2fc * ln(2) / sqrt(dispersion * inv) AS t FROM r""")
def quasi_poisson_two_group(spark, d):
    e = parquet(spark, d, "events").select("event_type", (F.col("user_id") % 2).alias("g"), "value", (F.col("value") + 50).alias("lib"))
    return st.quasi_poisson(e, "value", "lib", "g", ["event_type"]).drop("p")


@query("""WITH m AS (SELECT event_type, avg(hour(ts)) AS xm, regr_slope(value, hour(ts)) AS slope, var_pop(hour(ts)) * count(*) AS sxx, count(*) AS n FROM events GROUP BY 1), a AS (SELECT event_type, avg(value) AS ym FROM events GROUP BY 1),
u AS (SELECT event_type, user_id, sum((hour(ts) - xm) * (value - ym - slope * (hour(ts) - xm))) AS u FROM events JOIN m USING (event_type) JOIN a USING (event_type) GROUP BY 1, 2)
SELECT event_type, any_value(n) AS n, count(*) AS clusters, any_value(slope) AS slope, sqrt(count(*) / CAST(count(*) - 1 AS DOUBLE) * ((any_value(n) - 1) / CAST(any_value(n) - 2 AS DOUBLE)) * sum(u * u)) / any_value(sxx) AS se FROM u JOIN m USING (event_type) GROUP BY 1""")
def donor_clustered_slope(spark, d):
    e = parquet(spark, d, "events").select("event_type", "user_id", "value", F.hour("ts").cast("double").alias("h"))
    return st.clustered_ols(e, "value", "h", "user_id", ["event_type"])


@query(f"WITH {LINES}, {AUC}, w AS (SELECT *, 12.0 * n1 * n0 / (n1 + n0 + 1) AS w FROM auc) SELECT 'all' AS family, count(*) AS k, CAST(sum(w * auc) / sum(w) AS DOUBLE) AS pooled, sqrt(sum((w * 0.1) ** 2)) / sum(w) AS se FROM w")
def pooled_auc(spark, d):
    a = st.two_group_auc(_lines(spark, d), "x", "label", ["p_brand"]).withColumn("family", F.lit("all")).withColumn("sd", F.lit(0.1))
    return st.pooled_auc(a, "auc", "n1", "n0", "sd", ["family"])


@query(f"""WITH {LINES}, {HEDGES}, u AS (SELECT p_brand AS held_out FROM e), l AS (SELECT held_out, g, v FROM e JOIN u ON p_brand <> held_out), f AS (SELECT held_out, count(*) AS k, sum(1 / v) AS sw, sum(1 / v / v) AS sw2, sum(g / v) / sum(1 / v) AS fixed, sum(g * g / v) AS sgg FROM l GROUP BY 1),
t AS (SELECT held_out, greatest(0.0, (sgg - sw * fixed * fixed - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM f), r AS (SELECT held_out, sum(g / (v + tau2)) / sum(1 / (v + tau2)) AS pooled, sqrt(1 / sum(1 / (v + tau2))) AS se FROM l JOIN t USING (held_out) GROUP BY 1), zz AS (SELECT *, pooled / se AS z FROM r), {normal_p('zz', 'z')}
SELECT 'all' AS family, count(*) AS runs, max(p) AS worst_p, count(DISTINCT sign(pooled)) = 1 AND max(p) < 0.05 AS robust FROM p""")
def leave_one_out_meta(spark, d):
    e = st.hedges(_lines(spark, d), "x", "label", ["p_brand"]).withColumn("family", F.lit("all"))
    return st.leave_one_out_meta(e, "family", "p_brand", "g", "v")


@query("""WITH e AS (SELECT event_type AS gene, user_id % 6 AS tissue, avg(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT gene, rank() OVER (PARTITION BY gene ORDER BY tissue) AS a, rank() OVER (PARTITION BY gene ORDER BY v) AS b FROM e) SELECT gene, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1 HAVING count(*) >= 4""")
def tissue_gradient(spark, d):
    e = parquet(spark, d, "events").groupBy(F.col("event_type").alias("gene"), (F.col("user_id") % 6).alias("tissue")).agg(F.avg("value").alias("v"))
    return st.gradient(e, "gene", "tissue", "v")


@query("""WITH h AS (SELECT p_partkey AS gene FROM part WHERE p_size > 40), n AS (SELECT count(*) AS n FROM h), o AS (SELECT p_brand AS term, count(*) FILTER (p_size > 40) AS overlap, count(*) AS size FROM part GROUP BY 1 HAVING count(*) FILTER (p_size > 40) > 0), u AS (SELECT count(*) AS u FROM part),
k AS (SELECT *, unnest(range(overlap, least(size, n) + 1)) AS k FROM o, n, u) SELECT term, overlap, size, least(1.0, sum(exp(lgamma(size + 1) - lgamma(k + 1) - lgamma(size - k + 1) + lgamma(u - size + 1) - lgamma(n - k + 1) - lgamma(u - size - n + k + 1) - lgamma(u + 1) + lgamma(n + 1) + lgamma(u - n + 1)))) AS p FROM k GROUP BY 1, 2, 3""")
def over_representation(spark, d):
    p = parquet(spark, d, "part")
    sets = p.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene"))
    return st.hypergeometric_overlap(p.where("p_size > 40").select(F.col("p_partkey").alias("gene")), sets, p.count())


@query("""WITH g AS (SELECT p_partkey AS gene, p_brand AS term, p_size - 25.5 AS score FROM part), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene) AS r FROM g), n AS (SELECT count(*) AS n FROM g), t AS (SELECT term, count(*) AS m, sum(abs(score)) AS s FROM g GROUP BY 1),
w AS (SELECT t.term, m, r, sum(CASE WHEN r.term = t.term THEN abs(score) / s ELSE -1.0 / (n - m) END) OVER (PARTITION BY t.term ORDER BY r) AS es FROM r, t, n) SELECT term, any_value(m) AS size, CASE WHEN max(es) >= -min(es) THEN max(es) ELSE min(es) END AS es FROM w GROUP BY 1""")
def gene_set_enrichment(spark, d):
    p = parquet(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("term"), (F.col("p_size") - 25.5).alias("score"))
    return st.enrichment_score(p.select("gene", "score"), p.select("term", "gene"))


@query("SELECT user_id, avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'error') AS score, avg(value) FILTER (event_type = 'click') / avg(value) FILTER (event_type <> 'click') AS specificity FROM events GROUP BY 1")
def composite_direction_and_specificity(spark, d):
    up, down, rest = (F.avg(F.when(c, F.col("value"))) for c in (F.col("event_type") == "click", F.col("event_type") == "error", F.col("event_type") != "click"))
    return parquet(spark, d, "events").groupBy("user_id").agg((up - down).alias("score"), F.try_divide(up, rest).alias("specificity"))


@query("WITH c AS (SELECT p_brand, p_type, avg(p_retailprice) AS auc FROM part GROUP BY 1, 2) SELECT p_brand, p_type, best - auc AS gap FROM (SELECT *, max(auc) OVER (PARTITION BY p_brand) AS best FROM c) WHERE best - auc <= 40")
def near_ties(spark, d):
    c = parquet(spark, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("auc"))
    best = c.groupBy("p_brand").agg(F.max("auc").alias("best"))
    return c.join(best, "p_brand").select("p_brand", "p_type", (F.col("best") - F.col("auc")).alias("gap")).where("gap <= 40")
