"""Queries that combine tests, weigh cohorts, sweep margins and match samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import matrix as mx
from ..operators import relational as rel
from ..operators import resampling as rs
from ..operators import stats as st
from ..sources.tables import checkpointed, parquet
from .catalogue import AUC, LINES, _lines
from .modelling import EMB, H, _emb
from .registry import query
from .statistics import PARTIAL

RHO = "sr AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY x) + (count(*) OVER (PARTITION BY p_brand, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY p_brand ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, y) - 1) / 2.0 AS ry FROM lines)"


@query(f"""WITH {LINES}, {AUC}, {RHO}, {PARTIAL} SELECT p_brand, 'two_group' AS test, CAST(n1 + n0 AS BIGINT) AS n, auc AS value FROM auc UNION ALL SELECT p_brand, 'correlation', count(*), corr(rx, ry) FROM sr GROUP BY 1
UNION ALL SELECT p_brand, 'partial', count(*), corr(x, y) FROM k GROUP BY 1""".replace(" by,", " b_y,").replace("by * (c", "b_y * (c"))
def association_battery(spark, d):
    x = checkpointed(_lines(spark, d))  # three tests read it
    row = lambda df, name, n, value: df.select("p_brand", F.lit(name).alias("test"), n.alias("n"), F.col(value).alias("value"))
    two = row(st.two_group_auc(x, "x", "label", ["p_brand"]), "two_group", F.col("n1") + F.col("n0"), "auc")
    return two.union(row(st.spearman(x, "x", "y", ["p_brand"]), "correlation", F.col("n"), "rho")).union(row(st.partial_spearman(x, "x", "y", "label", ["p_brand"]), "partial", F.col("n"), "rho"))


@query("""WITH lines AS (SELECT p_brand, l_linestatus || l_shipmode AS unit, l_extendedprice AS x, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM (SELECT *, CASE WHEN l_tax < 0.03 THEN 'a' ELSE 'b' END AS l_shipmode FROM lineitem) JOIN part ON l_partkey = p_partkey),
m AS (SELECT p_brand, unit, sum(label) AS n1, sum(1 - label) AS n0, avg(x) FILTER (label = 1) AS m1, avg(x) FILTER (label = 0) AS m0, var_samp(x) FILTER (label = 1) AS v1, var_samp(x) FILTER (label = 0) AS v0 FROM lines GROUP BY 1, 2),
g AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) * (1 - 3.0 / (4 * (n1 + n0) - 9)) AS g FROM m WHERE n1 > 1 AND n0 > 1), e AS (SELECT p_brand, g, (n1 + n0) / (CAST(n1 AS DOUBLE) * n0) + g * g / (2 * (n1 + n0)) AS v FROM g),
f AS (SELECT p_brand, count(*) AS k, sum(1 / v) AS sw, sum(1 / v / v) AS sw2, sum(g / v) / sum(1 / v) AS fixed, sum(g * g / v) AS sgg, greatest(count(*) FILTER (g > 0), count(*) FILTER (g < 0)) AS same_sign FROM e GROUP BY 1),
t AS (SELECT *, greatest(0.0, (sgg - sw * fixed * fixed - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM f WHERE k >= 2) SELECT p_brand, any_value(k) AS k, any_value(same_sign) AS same_sign, sum(g / (v + tau2)) / sum(1 / (v + tau2)) AS pooled FROM e JOIN t USING (p_brand) GROUP BY 1""")
def meta_same_sign(spark, d):
    li, part = parquet(spark, d, "lineitem"), parquet(spark, d, "part")
    unit = F.concat("l_linestatus", F.when(F.col("l_tax") < 0.03, "a").otherwise("b"))
    x = li.join(part, li.l_partkey == part.p_partkey).select("p_brand", unit.alias("unit"), F.col("l_extendedprice").alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return st.sign_consistency(st.hedges(x, "x", "label", ["p_brand", "unit"]), "g", "v", ["p_brand"], 2).select("p_brand", "k", "same_sign", "pooled")


@query()
def exact_small_groups(spark, d):
    """Every third customer against the others of their nation and segment, by balance."""
    c = parquet(spark, d, "customer").select("c_nationkey", "c_mktsegment", F.round("c_acctbal", 2).alias("x"), (F.col("c_custkey") % 3 == 0).cast("int").alias("y"))
    return st.exact_mann_whitney(c, "x", "y", ["c_nationkey", "c_mktsegment"])


@query("""WITH c AS (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), h AS (SELECT DISTINCT n_nationkey AS held_out FROM c), u AS (SELECT held_out, n_regionkey, avg(m) AS m FROM c JOIN h ON n_nationkey <> held_out GROUP BY 1, 2)
SELECT held_out, avg(m) AS weighted_mean FROM u GROUP BY 1""")
def leave_one_cohort_means(spark, d):
    c, n = parquet(spark, d, "customer"), parquet(spark, d, "nation")
    return st.leave_one_cohort_means(c.join(n, c.c_nationkey == n.n_nationkey), "c_acctbal", "n_regionkey", "n_nationkey")


@query("WITH k AS (SELECT p_size AS k, quantile_cont(p_retailprice / 1000 / p_size, 0.95) AS u FROM part GROUP BY 1), m AS (SELECT unnest([0.02, 0.05, 0.1, 0.2]::DOUBLE[]) AS margin) SELECT margin, min(k) FILTER (u < margin) AS k FROM k, m GROUP BY 1")
def margin_sweep(spark, d):
    losses = parquet(spark, d, "part").select(F.col("p_size").alias("k"), (F.col("p_retailprice") / 1000 / F.col("p_size")).alias("loss"))
    return rs.noninferior_by_margin(losses, "k", "loss", [0.02, 0.05, 0.1, 0.2])


@query("WITH g AS (SELECT p_brand, sum(l_extendedprice) AS gain FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_brand, round(gain, 2) AS gain FROM g WHERE gain >= (SELECT avg(gain) FROM g)")
def mean_gain_mask(spark, d):
    g = parquet(spark, d, "lineitem").join(parquet(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_extendedprice").alias("gain"))
    return mx.above_mean_gain(g, "p_brand", "gain").select("p_brand", F.round("gain", 2).alias("gain"))


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus IN ('P') THEN o_totalprice ELSE ln(1 + o_totalprice) END AS logged FROM orders), m AS (SELECT o_orderpriority, avg(o_totalprice / 1e5) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice / 1e5) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY 1)
SELECT o_orderkey, logged, CASE WHEN a > 0 AND b > 0 THEN log2(a / b) END AS ratio, log2((a + 1) / (b + 1)) AS pseudo, log2((exp(a) - 1 + 1e-3) / (exp(b) - 1 + 1e-3)) AS back FROM l JOIN orders USING (o_orderkey) JOIN m USING (o_orderpriority)""")
def scale_and_fold_changes(spark, d):
    o = parquet(spark, d, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int")).withColumn("x", F.col("o_totalprice") / 1e5)
    return mx.log_where_raw(o, "o_totalprice", "o_orderstatus", ["P"]).join(mx.fold_changes(o, "x", "y", ["o_orderpriority"]), "o_orderpriority").select("o_orderkey", "logged", "ratio", "pseudo", "back")


@query("SELECT p_partkey, regexp_matches(upper(substr(p_name, 1, 2)) || 'P' || p_size, 'P[0-9]+$') AS pseudogene, CASE p_type WHEN 'ECONOMY' THEN 'economy class' WHEN 'PROMO' THEN 'promotion' ELSE p_type END AS spelling FROM part")
def symbol_suffix_and_spelling(spark, d):
    p = parquet(spark, d, "part")
    symbol = F.concat(F.upper(F.substring("p_name", 1, 2)), F.lit("P"), F.col("p_size").cast("string"))
    return p.select("p_partkey", tx.is_pseudogene(symbol).alias("pseudogene"), tx.respelt(F.col("p_type"), {"ECONOMY": "economy class", "PROMO": "promotion"}).alias("spelling"))


@query(f"""WITH s AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '+' ORDER BY o_orderpriority) AS pattern FROM orders GROUP BY 1), p AS (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal > 9000), w AS (SELECT pattern, count(*) AS m FROM s JOIN p USING (o_custkey) GROUP BY 1),
f AS (SELECT pattern, o_custkey, m, row_number() OVER (PARTITION BY pattern ORDER BY {H("0", "o_custkey")}, o_custkey) AS n FROM s JOIN w USING (pattern) WHERE o_custkey NOT IN (SELECT o_custkey FROM p)) SELECT pattern, o_custkey FROM f WHERE n <= m""")
def pattern_matched_sample(spark, d):
    s = rel.strata(parquet(spark, d, "orders"), "o_custkey", "o_orderpriority").select("o_custkey", "pattern")
    panel = parquet(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return rel.matched_sample(s, panel, "o_custkey", "pattern")


@query("SELECT l_orderkey, l_linenumber, l_discount + l_tax AS total FROM lineitem")
def columns_by_prefix(spark, d):
    li = parquet(spark, d, "lineitem")
    chosen = [c for c in li.columns if c.startswith(("l_disc", "l_tax"))]
    return li.select("l_orderkey", "l_linenumber", sum((F.col(c) for c in chosen[1:]), F.col(chosen[0])).alias("total"))


@query(f"""WITH {EMB}, r AS (SELECT f, vec_id, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2.0 AS r FROM e), u AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT vec_id FROM e)),
x AS (SELECT d.b, p.vec_id FROM (SELECT *, unnest(range(50)) AS b FROM u) d JOIN u p ON p.i = {H("0", "d.b", "d.i")} % d.n UNION ALL SELECT -1, vec_id FROM u),
c AS (SELECT b, g.f AS gene, k.f AS kind, corr(g.r, k.r) AS rho FROM x JOIN r g ON g.vec_id = x.vec_id AND g.f < 4 JOIN r k ON k.vec_id = x.vec_id AND k.f >= 61 GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY b, gene ORDER BY round(abs(rho), 12) DESC, kind) AS n FROM c),
p AS (SELECT gene, max(kind) FILTER (n = 1) AS top1, max(rho) FILTER (n = 1) AS rho1, max(kind) FILTER (n = 2) AS top2, max(rho) FILTER (n = 2) AS rho2 FROM o WHERE b = -1 GROUP BY 1),
d AS (SELECT b, gene, max(abs(rho)) FILTER (kind = top1) - max(abs(rho)) FILTER (kind = top2) AS gap, max(CASE WHEN n = 1 AND kind = top1 THEN 1.0 ELSE 0 END) AS win FROM o JOIN p USING (gene) WHERE b >= 0 GROUP BY 1, 2)
SELECT CAST(gene AS INTEGER) AS gene, CAST(any_value(top1) AS INTEGER) AS top1, any_value(rho1) AS rho1, CAST(any_value(top2) AS INTEGER) AS top2, any_value(rho2) AS rho2, quantile_cont(gap, 0.025) AS gap_low, quantile_cont(gap, 0.975) AS gap_high, avg(win) AS win_rate, quantile_cont(gap, 0.025) > 0 AND avg(win) >= 0.95 AS robust FROM d JOIN p USING (gene) GROUP BY 1""")
def composition_driver(spark, d):
    e = _emb(spark, d)
    genes, kinds = e.where("f < 4").withColumnRenamed("f", "gene"), e.where("f >= 61").select("vec_id", F.col("f").alias("kind"), F.col("v").alias("score"))
    return rs.composition_driver(genes, "vec_id", "gene", "v", kinds, "kind", "score", 50)
