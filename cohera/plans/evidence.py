"""Queries on agreement, audits, grades of evidence and units left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import stats as st
from ..sources.tables import parquet
from .catalogue import LINES, _lines
from .registry import normal_p, query


@query()
def spearman_with_p(spark, d):
    """Rank correlation of price and quantity in every brand, with its p."""
    return ev.with_rank_p(st.spearman(_lines(spark, d), "x", "y", ["p_brand"]))


SCHEMES = ("equal_all", "by_rows_all", "equal_without", "by_rows_without")


@query(f"""WITH c AS (SELECT l_partkey, l_linenumber, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
w AS (SELECT l_partkey, round(avg(q / n), 6) AS equal_all, round(sum(q) / sum(n), 6) AS by_rows_all, round(avg(q / n) FILTER (l_linenumber <> 1), 6) AS equal_without,
  round(sum(q) FILTER (l_linenumber <> 1) / sum(n) FILTER (l_linenumber <> 1), 6) AS by_rows_without FROM c GROUP BY 1),
x AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(SCHEMES) for b in SCHEMES[i + 1:])}),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM x)
SELECT a, b, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1, 2""")
def scheme_correlations(spark, d):
    """Mean quantity of a part over line numbers, weighted four ways: how alike do the schemes rank the parts?"""
    c = parquet(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    n, q, mean, kept = F.col("n"), F.col("q"), F.col("q") / F.col("n"), F.col("l_linenumber") != 1
    some = lambda x: F.when(kept, x)
    w = c.groupBy("l_partkey").agg(F.round(F.avg(mean), 6).alias(SCHEMES[0]), F.round(F.sum(q) / F.sum(n), 6).alias(SCHEMES[1]), F.round(F.avg(some(mean)), 6).alias(SCHEMES[2]), F.round(F.sum(some(q)) / F.sum(some(n)), 6).alias(SCHEMES[3]))
    return ev.scheme_correlations(w, list(SCHEMES))


GAPS = """s AS (SELECT lang, source, n_chars / (n_chars + 2000.0) AS length, (n_chars % 97) / 97.0 AS residue, quality AS y FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
m AS (SELECT lang, source, y, 'length' AS model, length AS s FROM s UNION ALL SELECT lang, source, y, 'residue', residue FROM s),
r AS (SELECT lang, source, model, y, rank() OVER (PARTITION BY lang, source, model ORDER BY s) + (count(*) OVER (PARTITION BY lang, source, model, s) - 1) / 2.0 AS r FROM m),
a AS (SELECT lang, source, model, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (CAST(sum(r) FILTER (y = 1) AS DOUBLE) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END AS auc FROM r GROUP BY 1, 2, 3),
g AS (SELECT * FROM (SELECT lang, source, avg(auc) FILTER (model = 'length') - avg(auc) FILTER (model = 'residue') AS gap FROM a GROUP BY 1, 2) WHERE gap IS NOT NULL)"""


def _gaps(spark, d):
    j = parquet(spark, d, "labels").where("quality is not null").join(parquet(spark, d, "documents").where("n_chars is not null"), "doc_id")
    models = F.create_map(F.lit("length"), F.col("n_chars") / (F.col("n_chars") + 2000.0), F.lit("residue"), F.col("n_chars") % 97 / 97.0)
    rows = j.select("lang", "source", F.col("quality").alias("y"), F.explode(models).alias("model", "s"))
    return ev.model_gaps(st.two_group_auc(rows, "s", "y", ["lang", "source", "model"]), ["lang", "source"], "model", "auc", "length", "residue")


@query(f"WITH {GAPS} SELECT lang, count(*) AS cells, avg(gap) AS mean_gap FROM g GROUP BY 1")
def model_area_gaps(spark, d):
    """Area of one score less that of another, per language over its sources."""
    return ev.mean_gaps(_gaps(spark, d), "lang")


@query(f"""WITH {GAPS}, w AS (SELECT * FROM g ORDER BY abs(gap) DESC, lang NULLS FIRST, source NULLS FIRST LIMIT 1), n AS (SELECT count(*) AS cells, count(*) FILTER (abs(gap) <= 0.1) AS agreeing FROM g)
SELECT cells, agreeing, lang AS worst_lang, source AS worst_source, gap AS largest_gap, CASE WHEN cells > 0 THEN agreeing = cells END AS holds FROM n LEFT JOIN w ON true""")
def model_parity(spark, d):
    """Do two scores agree within 0.1 of area in every language and source?"""
    return ev.parity(_gaps(spark, d), ["lang", "source"], 0.1)


@query("""WITH f AS (SELECT p_partkey, starts_with(upper(p_name), 'RED') OR starts_with(upper(p_name), 'SM') AS by_symbol, lower(p_type) IN ('promo', 'unknown') AS by_kind, coalesce(p_name, '') = '' OR starts_with(p_name, 'blue') AS without_symbol FROM part),
l AS (SELECT l_partkey AS p_partkey, max(m) AS highest FROM (SELECT l_partkey, l_linenumber, median(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT p_partkey, by_symbol, by_kind, without_symbol, CASE WHEN by_symbol OR by_kind OR without_symbol THEN highest END AS highest,
CASE WHEN NOT (by_symbol OR by_kind OR without_symbol) THEN 'clean' WHEN highest IS NULL OR highest < 0 THEN 'no_level' WHEN highest < 40 THEN 'artifact' WHEN highest < 46 THEN 'borderline' ELSE 'expressed' END AS audit FROM f LEFT JOIN l USING (p_partkey)""")
def artifact_audit(spark, d):
    """Parts flagged by name or type, classed by the highest of their median quantities over line numbers."""
    medians = parquet(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), "l_linenumber").agg(F.median("l_quantity").alias("m"))
    out = ev.audited(parquet(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_partkey", "p_name", "p_type", medians, "m", ["red", "sm"], ["Promo", "unknown"], "blue", 40, 46)
    return out.drop("p_name", "p_type")


@query(f"""WITH {LINES}, ranked AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, y) - 1) / 2.0 AS r FROM lines),
a AS (SELECT p_brand, sum(label) AS n1, sum(1 - label) AS n0, avg(x) FILTER (label = 1) > avg(x) FILTER (label = 0) AS up, avg(y) FILTER (label = 1) - avg(y) FILTER (label = 0) AS change, (CAST(sum(r) FILTER (label = 1) AS DOUBLE) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) AS auc FROM ranked GROUP BY 1),
z AS (SELECT *, (auc - 0.5) * n1 * n0 / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0) AS z FROM a), {normal_p("z", "z")},
q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM p), f AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p DESC, raw DESC ROWS UNBOUNDED PRECEDING)) AS q FROM q),
g AS (SELECT *, CASE WHEN p >= 0.3 THEN 'none' WHEN (change > 0) <> up THEN 'opposite' WHEN q < 0.3 THEN 'confirmed' ELSE 'suggestive' END AS grade FROM f)
SELECT p_brand, up, p, q, grade, CASE grade WHEN 'confirmed' THEN 1 WHEN 'suggestive' THEN 2 ELSE 3 END AS tier, CASE WHEN p >= 0.3 THEN 'ambiguous' WHEN up <> (change > 0) THEN 'sign_reversal' ELSE 'composition_driven' END AS shift FROM g""")
def evidence_tiers(spark, d):
    """Brands whose price moves one way between the classes, graded by a test on quantity (level 0.3)."""
    lines = _lines(spark, d)
    case, ctrl = F.when(F.col("label") == 1, 1), F.when(F.col("label") == 0, 1)
    means = lines.groupBy("p_brand").agg((F.avg(case * F.col("x")) > F.avg(ctrl * F.col("x"))).alias("up"), (F.avg(case * F.col("y")) - F.avg(ctrl * F.col("y"))).alias("change"))
    a = st.two_group_auc(lines, "y", "label", ["p_brand"])
    n1, n0 = F.col("n1"), F.col("n0")
    z = (F.col("auc") - 0.5) * n1 * n0 / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0)
    t = st.adjusted(a.withColumn("p", st.normal_two_sided_p(z)), "p").join(means, "p_brand")
    shift = F.when(F.col("p") >= 0.3, "ns").when(F.col("change") > 0, "up").otherwise("down")
    t = t.withColumn("grade", ev.grade(F.col("up"), F.col("p"), F.col("q"), F.col("change"), 0.3))
    return t.select("p_brand", "up", "p", "q", "grade", ev.tier(F.col("grade")).alias("tier"), ev.shift_class(F.col("up"), shift).alias("shift"))


def _left_out(unit: str) -> str:
    return f"""(WITH r AS (SELECT sample, {unit} AS unit, feature, v, y FROM long WHERE v IS NOT NULL AND {unit} IS NOT NULL), o AS (SELECT unit, feature, count(*) AS n, sum(v) AS s, sum(v * v) AS q, sum(y) AS n1, sum(v * y) AS s1 FROM r GROUP BY 1, 2),
t AS (SELECT feature, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(n1) AS n1, sum(s1) AS s1 FROM o GROUP BY 1), x AS (SELECT o.unit, feature, t.n - o.n AS n, t.s - o.s AS s, t.q - o.q AS q, t.n1 - o.n1 AS n1, t.s1 - o.s1 AS s1 FROM o JOIN t USING (feature)),
w AS (SELECT unit, feature, (s1 / n1 - (s - s1) / (n - n1)) / (q / n - (s / n) * (s / n)) AS w FROM x), c AS (SELECT sample, y, round(sum(w * v), 10) AS score FROM r JOIN w USING (unit, feature) GROUP BY 1, 2),
k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM c)
SELECT '{unit}' AS left_out, CAST(sum(y) AS BIGINT) AS n1, CAST(sum(1 - y) AS BIGINT) AS n0, (CAST(sum(r) FILTER (y = 1) AS DOUBLE) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM k)"""


@query(f"""WITH o AS (SELECT o_custkey AS c_custkey, CAST(count(*) AS DOUBLE) AS orders, max(o_totalprice) AS dearest FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS sample, c_nationkey AS nation, n_regionkey AS region, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS y, c_acctbal AS balance, orders, dearest FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o USING (c_custkey)),
long AS ({" UNION ALL ".join(f"SELECT sample, nation, region, y, '{f}' AS feature, CAST({f} AS DOUBLE) / 1000 AS v FROM c" for f in ("balance", "orders", "dearest"))})
{_left_out("nation")} UNION ALL {_left_out("region")}""")
def leave_one_unit_out_auc(spark, d):
    """Market segment from a customer's figures, learnt without their nation, and without their region."""
    o = parquet(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("dearest"))
    n = parquet(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    c = parquet(spark, d, "customer").join(n, "c_nationkey").join(o, "c_custkey", "left")
    figures = F.create_map(*[x for f, of in (("balance", "c_acctbal"), ("orders", "orders"), ("dearest", "dearest")) for x in (F.lit(f), F.col(of).cast("double") / 1000)])
    long = c.select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("nation"), "region", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), F.explode(figures).alias("feature", "v"))
    scored = [ev.leave_one_unit_out(long, "sample", u, "feature", "v", "y").withColumn("left_out", F.lit(u)) for u in ("nation", "region")]
    return st.two_group_auc(scored[0].union(scored[1]), "score", "y", ["left_out"]).drop("rank_biserial")
