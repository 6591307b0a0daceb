"""Every registered query and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import matrix as mx
from ..operators import relational as rel
from ..operators import stats as st
from ..sources.tables import parquet
from .registry import normal_p, query

def _lines(spark, d):
    li, part = parquet(spark, d, "lineitem"), parquet(spark, d, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select("p_brand", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


LINES = "lines AS (SELECT p_brand, l_extendedprice AS x, l_quantity AS y, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem JOIN part ON l_partkey = p_partkey)"
AUC = """ranked AS (SELECT p_brand, label, rank() OVER (PARTITION BY p_brand ORDER BY x) + (count(*) OVER (PARTITION BY p_brand, x) - 1) / 2.0 AS r FROM lines),
auc AS (SELECT p_brand, sum(label) AS n1, sum(1 - label) AS n0, (CAST(sum(r) FILTER (label = 1) AS DOUBLE) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) AS auc FROM ranked GROUP BY p_brand)"""


@query(f"""WITH {LINES}, {AUC}, z AS (SELECT *, 2 * auc - 1 AS rank_biserial, (auc - 0.5) * n1 * n0 / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0) AS z FROM auc),
{normal_p("z", "z")},
q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM p)
SELECT p_brand, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, auc, rank_biserial, p, least(1.0, min(raw) OVER (ORDER BY p DESC, raw DESC ROWS UNBOUNDED PRECEDING)) AS q FROM q""")
def label_two_group_auc_bh(spark, d):
    a = st.two_group_auc(_lines(spark, d), "x", "label", ["p_brand"])
    n1, n0 = F.col("n1"), F.col("n0")
    z = (F.col("auc") - 0.5) * n1 * n0 / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0)
    return st.adjusted(a.withColumn("p", st.normal_two_sided_p(z)), "p").select("p_brand", "n1", "n0", "auc", "rank_biserial", "p", "q")


HEDGES = """m AS (SELECT p_brand, sum(label) AS n1, sum(1 - label) AS n0, avg(x) FILTER (label = 1) AS m1, avg(x) FILTER (label = 0) AS m0, var_samp(x) FILTER (label = 1) AS v1, var_samp(x) FILTER (label = 0) AS v0 FROM lines GROUP BY p_brand),
g AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) * (1 - 3.0 / (4 * (n1 + n0) - 9)) AS g FROM m),
e AS (SELECT p_brand, n1, n0, g, (n1 + n0) / (CAST(n1 AS DOUBLE) * n0) + g * g / (2 * (n1 + n0)) AS v FROM g)"""


@query(f"WITH {LINES}, {HEDGES} SELECT p_brand, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, g, v FROM e")
def hedges_by_brand(spark, d):
    return st.hedges(_lines(spark, d), "x", "label", ["p_brand"])


@query(f"""WITH {LINES}, {HEDGES}, f AS (SELECT count(*) AS k, sum(1 / v) AS sw, sum(1 / v / v) AS sw2, sum(g / v) / sum(1 / v) AS fixed, sum(g * g / v) AS sgg FROM e),
t AS (SELECT *, sgg - sw * fixed * fixed AS q FROM f), u AS (SELECT *, greatest(0.0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM t)
SELECT 'all' AS family, any_value(k) AS k, any_value(fixed) AS fixed, any_value(q) AS q, any_value(tau2) AS tau2, sum(g / (v + tau2)) / sum(1 / (v + tau2)) AS pooled, sqrt(1 / sum(1 / (v + tau2))) AS se, greatest(0.0, (any_value(q) - (any_value(k) - 1)) / any_value(q)) AS i2 FROM e, u""")
def hedges_dl_meta(spark, d):
    e = st.hedges(_lines(spark, d), "x", "label", ["p_brand"]).withColumn("family", F.lit("all"))
    return st.random_effects(e, "g", "v", ["family"])


@query(f"WITH {LINES} SELECT p_brand, (avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0)) / sqrt(var_samp(x) FILTER (label = 1) / sum(label) + var_samp(x) FILTER (label = 0) / sum(1 - label)) AS t FROM lines GROUP BY p_brand")
def welch_t_by_feature(spark, d):
    return st.welch_t(_lines(spark, d), "x", "label", ["p_brand"])


@query(f"""WITH {LINES}, r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY x) + (count(*) OVER (PARTITION BY p_brand, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY p_brand ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, y) - 1) / 2.0 AS ry FROM lines)
SELECT p_brand, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY p_brand""")
def spearman_by_group(spark, d):
    return st.spearman(_lines(spark, d), "x", "y", ["p_brand"])


def _scores(spark, d):
    return parquet(spark, d, "labels").where("quality is not null").join(parquet(spark, d, "documents"), "doc_id").select((F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("s"), F.col("quality").alias("y"))


SCORES = "s AS (SELECT n_chars / (n_chars + 2000.0) AS s, quality AS y FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"
BINS = "b AS (SELECT least(CAST(floor(s * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(s) AS confidence, avg(CAST(y AS DOUBLE)) AS accuracy FROM s GROUP BY 1)"


@query(f"WITH {SCORES}, {BINS} SELECT * FROM b")
def reliability_bins(spark, d):
    return st.calibration(_scores(spark, d), "s", "y")


@query(f"WITH {SCORES}, {BINS} SELECT sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM b")
def calibration_ece(spark, d):
    return st.calibration_error(_scores(spark, d), "s", "y")


@query(f"WITH {SCORES}, c AS (SELECT s, y, least(greatest(s, 1e-7), 1 - 1e-7) AS p FROM s) SELECT avg((y - s) ** 2) AS brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss FROM c")
def brier_logloss(spark, d):
    return st.brier_log_loss(_scores(spark, d), "s", "y")


@query(f"""WITH {SCORES}, t AS (SELECT unnest([0.1, 0.25, 0.5, 0.75]::DOUBLE[]) AS threshold)
SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) / count(*) - count(*) FILTER (s >= threshold AND y = 0) / count(*) * (threshold / (1 - threshold)) AS net_benefit, avg(CAST(y AS DOUBLE)) - (1 - avg(CAST(y AS DOUBLE))) * (threshold / (1 - threshold)) AS treat_all FROM s, t GROUP BY threshold""")
def decision_curve(spark, d):
    return st.decision_curve(_scores(spark, d), "s", "y", [0.1, 0.25, 0.5, 0.75])


@query(f"""WITH {SCORES}, g AS (SELECT s AS threshold, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY s),
w AS (SELECT threshold, CAST(sum(p) OVER (ORDER BY threshold DESC) AS DOUBLE) / sum(p) OVER () AS tpr, CAST(sum(n) OVER (ORDER BY threshold DESC) AS DOUBLE) / sum(n) OVER () AS fpr FROM g) SELECT *, tpr - fpr AS youden FROM w""")
def roc_curve_youden(spark, d):
    return st.roc_points(_scores(spark, d), "s", "y")


@query("WITH m AS (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), u AS (SELECT n_regionkey, avg(m) AS m FROM m GROUP BY 1) SELECT count(*) AS units, avg(m) AS weighted_mean FROM u")
def weighted_unit_mean(spark, d):
    c, n = parquet(spark, d, "customer"), parquet(spark, d, "nation")
    per = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", "n_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return st.weighted_unit_mean(per, "m", "n_regionkey", "n_nationkey")


@query("""WITH l AS (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)
SELECT l_orderkey, feature, ln(1 + 1e6 * sum(value) / sum(sum(value)) OVER (PARTITION BY l_orderkey)) AS log_cpm FROM l GROUP BY l_orderkey, feature""")
def expression_unpivot_log1p_cpm(spark, d):
    f = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return mx.log_cpm_of_columns(parquet(spark, d, "lineitem"), ["l_orderkey"], f).select("l_orderkey", "feature", "log_cpm")


@query("""WITH z AS (SELECT o_custkey, (o_totalprice - avg(o_totalprice) OVER w) / CASE WHEN stddev_pop(o_totalprice) OVER w > 0 THEN stddev_pop(o_totalprice) OVER w ELSE 1 END AS z FROM orders WINDOW w AS (PARTITION BY o_orderpriority)) SELECT o_custkey, avg(z) AS z FROM z GROUP BY 1""")
def zscore_within_group_unit_mean(spark, d):
    return mx.z_within(parquet(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]).groupBy("o_custkey").agg(F.avg("z").alias("z"))


@query(f"""WITH {LINES}, s AS (SELECT p_brand, avg(x) FILTER (label = 0) AS m0, sqrt((var_pop(x) FILTER (label = 0) * sum(1 - label) + var_pop(x) FILTER (label = 1) * sum(label)) / (count(*) - 2)) AS sd FROM lines GROUP BY p_brand)
SELECT p_brand, label, avg((x - m0) / sd) AS z FROM lines JOIN s USING (p_brand) GROUP BY ALL""")
def control_referenced_z(spark, d):
    return mx.control_z(_lines(spark, d), "x", "label", ["p_brand"]).groupBy("p_brand", "label").agg(F.avg("z").alias("z"))


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k, o_totalprice FROM orders), p AS (SELECT k, avg(o_totalprice) AS normalised FROM r GROUP BY k)
SELECT o_orderkey, o_orderpriority, normalised FROM r JOIN p USING (k)""")
def quantile_normalise(spark, d):
    return mx.quantile_normalise(parquet(spark, d, "orders"), "o_totalprice", "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority", "normalised")


@query("""WITH m AS (SELECT p_brand, p_partkey, avg(l_extendedprice) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY mean DESC, p_partkey) AS n FROM m) SELECT p_brand, p_partkey, mean FROM r WHERE n = 1""")
def maxmean_collapse(spark, d):
    li, p = parquet(spark, d, "lineitem"), parquet(spark, d, "part")
    return mx.collapse_by_mean(li.join(p, li.l_partkey == p.p_partkey), "p_brand", "p_partkey", "l_extendedprice")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 10")
def top_n_per_group(spark, d):
    o = parquet(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return mx.top_n(o, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 10)


@query("WITH c AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM orders), d AS (SELECT o_orderkey, len(list_filter(c, lambda q: q <= o_totalprice)) AS decile FROM orders, c) SELECT o_orderkey, CAST(decile AS INTEGER) AS decile FROM d")
def decile_bins(spark, d):
    return mx.deciles(parquet(spark, d, "orders"), "o_totalprice").select("o_orderkey", "decile")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= median(o_totalprice) OVER (PARTITION BY o_orderpriority) THEN 'high' ELSE 'low' END AS half FROM orders")
def median_split(spark, d):
    return mx.median_split(parquet(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey", "half")


@query("WITH c AS (SELECT event_type, quantile_cont(value, 0.9) AS cut FROM events GROUP BY 1) SELECT event_id, event_type, value FROM events JOIN c USING (event_type) WHERE value >= cut")
def top_fraction_select(spark, d):
    return mx.top_fraction(parquet(spark, d, "events"), "value", ["event_type"], 0.1).select("event_id", "event_type", "value")


@query("WITH g AS (SELECT p_brand, sum(l_extendedprice) AS gain FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), w AS (SELECT *, coalesce(sum(gain) OVER (ORDER BY gain DESC, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(gain) OVER () AS total FROM g) SELECT p_brand, round(gain, 2) AS gain FROM w WHERE before < 0.8 * total")
def cumulative_gain_mask(spark, d):
    g = parquet(spark, d, "lineitem").join(parquet(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_extendedprice").alias("gain"))
    return mx.cumulative_gain(g, "p_brand", "gain", 0.8).select("p_brand", F.round("gain", 2).alias("gain"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def donor_disjoint_antijoin(spark, d):
    train = parquet(spark, d, "orders").where("o_orderpriority like '1%'").withColumnRenamed("o_custkey", "c_custkey")
    return rel.disjoint(parquet(spark, d, "customer"), train, "c_custkey").select("c_custkey")


@query("SELECT c.c_custkey, coalesce(a.n_name, b.n_name) AS n_name FROM customer c LEFT JOIN nation a ON a.n_nationkey = c.c_custkey LEFT JOIN nation b ON b.n_nationkey = c.c_nationkey")
def fallback_key_join(spark, d):
    c = parquet(spark, d, "customer").select("c_custkey", "c_nationkey")
    return rel.fallback_join(c, parquet(spark, d, "nation"), "c_custkey", "c_nationkey", "n_nationkey", "n_name").select("c_custkey", "n_name")


@query("WITH a AS (SELECT DISTINCT p_partkey FROM part WHERE p_size > 25), b AS (SELECT DISTINCT p_partkey FROM part WHERE p_retailprice > 1000) SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL THEN 'both' WHEN a.p_partkey IS NOT NULL THEN 'size' ELSE 'price' END AS source FROM a FULL JOIN b ON a.p_partkey = b.p_partkey")
def candidate_union_provenance(spark, d):
    p = parquet(spark, d, "part")
    return rel.union_with_provenance(p.where("p_size > 25"), p.where("p_retailprice > 1000"), "p_partkey", ("size", "price"))


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def vocabulary_intersection_all(spark, d):
    return rel.in_all(parquet(spark, d, "events"), "user_id", "event_type")


@query("WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events) SELECT user_id, count(DISTINCT day) / CAST((SELECT count(DISTINCT day) FROM e) AS DOUBLE) AS frequency FROM e GROUP BY 1")
def module_frequency(spark, d):
    return rel.membership_frequency(parquet(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day")


@query("WITH g AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2) SELECT user_id, event_type, n, n / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS fraction, CASE WHEN n >= 3 THEN m END AS mean FROM g")
def pseudobulk(spark, d):
    return rel.pseudobulk(parquet(spark, d, "events"), "user_id", "event_type", "value", 3)


@query("SELECT l_returnflag, avg(l_quantity) FILTER (l_linestatus = 'F') AS F, avg(l_quantity) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def pivot_metric(spark, d):
    return parquet(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_discount) AS discount FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def grouping_sets_summary(spark, d):
    li = parquet(spark, d, "lineitem")
    return li.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_discount").alias("discount"))


@query("SELECT c_custkey, split_part(c_name, '#', 2) AS id, CASE WHEN ltrim(split_part(c_name, '#', 2), '0') = '' THEN '0' ELSE ltrim(split_part(c_name, '#', 2), '0') END AS short, reverse(translate(upper(c_name), 'ACGT', 'TGCA')) AS flipped, upper(split_part(c_mktsegment, '.', 1)) AS base FROM customer")
def identifier_functions(spark, d):
    c, number = parquet(spark, d, "customer"), F.split_part("c_name", F.lit("#"), F.lit(2))
    return c.select("c_custkey", number.alias("id"), tx.without_leading_zeros(number).alias("short"), tx.reverse_complement(F.upper("c_name")).alias("flipped"), F.upper(tx.base_id(F.col("c_mktsegment"))).alias("base"))
