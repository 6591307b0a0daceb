"""Queries on missing values, filters of features, ROC grids, permuted enrichment, and panels tried on other data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrix as mx
from ..operators import resampling as rs
from ..operators import stats as st
from ..operators import transfer as tr
from ..operators.draws import hashed
from ..sources.tables import parquet
from .catalogue import SCORES, _scores
from .modelling import EMB, H, _emb, _sample
from .registry import query

HOLES = "h AS (SELECT vec_id, f, CASE WHEN (vec_id + f) % 7 <> 0 AND f <> 5 THEN v END AS v FROM e)"


def _holes(spark, d):
    return _emb(spark, d).withColumn("v", F.when(((F.col("vec_id") + F.col("f")) % 7 != 0) & (F.col("f") != 5), F.col("v")))


@query(f"""WITH {EMB}, {HOLES}, c AS (SELECT f, avg(v) AS c, avg(v) FILTER (vec_id % 2 = 0) AS t FROM h GROUP BY 1), r AS (SELECT vec_id, median(v) AS r FROM h GROUP BY 1)
SELECT vec_id, CAST(f AS INTEGER) AS f, coalesce(v, 0) AS zero, coalesce(v, c, 0) AS column_mean, coalesce(v, r, 0) AS row_median, coalesce(v, t, 0) AS train_mean FROM h JOIN c USING (f) JOIN r USING (vec_id)""")
def missing_value_fill(spark, d):
    h = _holes(spark, d)
    train, out = h.where("vec_id % 2 = 0"), None
    for how in ("zero", "column_mean", "row_median", "train_mean"):
        one = mx.filled(h, "vec_id", "f", "v", how, train).withColumnRenamed("v", how)
        out = one if out is None else out.join(one, ["vec_id", "f"])
    return out


@query("""WITH l AS (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_quantity * 0 + 3 AS l_flat FROM lineitem) ON l_quantity, l_discount, l_flat INTO NAME feature VALUE value), k AS (SELECT feature FROM l GROUP BY 1 HAVING max(value) - min(value) > 0)
SELECT feature, count(*) AS n, avg(value) AS mean FROM l JOIN k USING (feature) GROUP BY 1""")
def constant_column_removal(spark, d):
    li = parquet(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", (F.col("l_quantity") * 0 + 3).alias("l_flat"))
    kept = mx.varying(mx.long_form(li, ["l_orderkey"], ["l_quantity", "l_discount", "l_flat"]), "feature", "value")
    return kept.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


COUNTS = "x AS (SELECT l_suppkey AS sample, l_partkey % 200 AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2), p AS (SELECT *, 1e6 * value / sum(value) OVER (PARTITION BY sample) AS cpm FROM x)"


@query(f"""WITH {COUNTS}, s AS (SELECT feature FROM p GROUP BY 1 HAVING avg(CASE WHEN cpm >= 20000 THEN 1.0 ELSE 0 END) >= 0.25), m AS (SELECT feature, avg(value) AS m FROM x GROUP BY 1), q AS (SELECT feature FROM m WHERE m > (SELECT quantile_cont(m, 0.25) FROM m))
SELECT feature, feature IN (SELECT feature FROM s) AS expressed, feature IN (SELECT feature FROM q) AS above_lowest FROM m""")
def expression_filters(spark, d):
    x = parquet(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 200).alias("feature")).agg(F.sum("l_quantity").alias("value"))
    cpm = mx.log_cpm(x, ["sample"]).withColumn("cpm", F.expm1("log_cpm"))
    flag = lambda df, name: df.select("feature").distinct().withColumn(name, F.lit(True))
    out = x.select("feature").distinct().join(flag(mx.expressed(cpm, "feature", "cpm", 20000, 0.25), "expressed"), "feature", "left").join(flag(mx.without_lowest(x, "feature", "value"), "above_lowest"), "feature", "left")
    return out.select("feature", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("expressed", "above_lowest")])


@query(f"""WITH {SCORES}, g AS (SELECT s AS threshold, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY s), w AS (SELECT CAST(sum(p) OVER (ORDER BY threshold DESC) AS DOUBLE) / sum(p) OVER () AS tpr, CAST(sum(n) OVER (ORDER BY threshold DESC) AS DOUBLE) / sum(n) OVER () AS fpr FROM g),
c AS (SELECT fpr, min(tpr) AS low, max(tpr) AS high FROM (SELECT tpr, fpr FROM w UNION ALL SELECT 0.0, 0.0) GROUP BY 1), x AS (SELECT CAST(unnest(range(101)) AS DOUBLE) / 100 AS x), xs AS (SELECT x, x + 1e-11 AS e FROM x),
a AS (SELECT xs.x, xs.e, c.fpr, c.high FROM xs ASOF JOIN c ON xs.e >= c.fpr), b AS (SELECT a.*, c.fpr AS f2, c.low FROM a ASOF LEFT JOIN c ON a.e < c.fpr)
SELECT x AS fpr, CASE WHEN f2 IS NULL OR abs(x - fpr) < 1e-11 THEN high ELSE high + (low - high) * (x - fpr) / (f2 - fpr) END AS tpr FROM b""")
def roc_fixed_grid(spark, d):
    return st.roc_on_grid(_scores(spark, d), "s", "y", 100)


@query()
def roc_band(spark, d):
    return rs.roc_band(_sample(spark, d), "doc_id", "s", "y", 200, 50)


@query(f"""WITH g AS (SELECT p_partkey AS gene, p_brand AS term, p_size - 25.5 AS score FROM part), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene) AS r FROM g), n AS (SELECT count(*) AS n FROM g),
k AS (SELECT term FROM g GROUP BY 1 HAVING count(*) BETWEEN 10 AND 2000), dr AS (SELECT gene, term, unnest(range(100)) AS draw FROM g), pe AS (SELECT gene, term, draw, row_number() OVER (PARTITION BY draw ORDER BY {H("0", "draw", "gene")}, gene) AS r FROM dr),
m AS (SELECT pe.term, draw, r.r, abs(r.score) AS a FROM pe JOIN r USING (r) JOIN k ON k.term = pe.term UNION ALL SELECT r.term, -1, r.r, abs(r.score) FROM r JOIN k USING (term)),
w AS (SELECT term, draw, r, a, row_number() OVER (PARTITION BY term, draw ORDER BY r) AS k, count(*) OVER (PARTITION BY term, draw) AS m, sum(a) OVER (PARTITION BY term, draw ORDER BY r) AS up, sum(a) OVER (PARTITION BY term, draw) AS every FROM m),
s AS (SELECT term, draw, any_value(m) AS size, max(up / every - (r - k) / CAST(n - m AS DOUBLE)) AS hi, min((up - a) / every - (r - k) / CAST(n - m AS DOUBLE)) AS lo FROM w, n GROUP BY 1, 2), e AS (SELECT term, draw, size, CASE WHEN hi >= -lo THEN hi ELSE lo END AS es FROM s)
SELECT o.term, o.size, o.es, o.es / avg(abs(b.es)) FILTER (sign(b.es) = sign(o.es)) AS nes, (count(*) FILTER (sign(b.es) = sign(o.es) AND abs(b.es) >= abs(o.es)) + 1) / CAST(count(*) FILTER (sign(b.es) = sign(o.es)) + 1 AS DOUBLE) AS p
FROM e o JOIN e b ON o.term = b.term AND o.draw = -1 AND b.draw >= 0 GROUP BY 1, 2, 3""")
def permuted_enrichment(spark, d):
    p = parquet(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("term"), (F.col("p_size") - 25.5).alias("score"))
    return st.permuted_enrichment(p, p, 100, 10, 2000)


LABELLED = "e AS (SELECT vec_id, unnest(range(len(embedding))) AS f, CAST(unnest(embedding) AS DOUBLE) AS v, label % 2 AS y FROM embeddings WHERE label IS NOT NULL)"
AREA = "(sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / CAST(sum(y) * sum(1 - y) AS DOUBLE)"


def _ranked(keys: str, value: str, rows: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    tied = f"{keys}, {value}" if keys else value
    return f"SELECT {keys + ',' if keys else ''} y, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {tied}) - 1) / 2.0 AS r FROM {rows}"


def _labelled(spark, d):
    e = parquet(spark, d, "embeddings").where("label is not null").select("vec_id", (F.col("label") % 2).alias("y"), F.posexplode("embedding").alias("f", "v"))
    return e.withColumn("v", F.col("v").cast("double"))


@query(f"""WITH {LABELLED}, t AS (SELECT f, avg(v) AS m, stddev_pop(v) AS s FROM e WHERE vec_id % 4 = 0 GROUP BY 1), w AS (SELECT f, (avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / any_value(s) AS w FROM e JOIN t USING (f) WHERE vec_id % 4 = 0 GROUP BY 1),
s AS (SELECT vec_id % 4 AS cohort, vec_id, y, round(sum((v - m) / s * w), 9) AS s FROM e JOIN t USING (f) JOIN w USING (f) WHERE vec_id % 4 <> 0 GROUP BY 1, 2, 3) SELECT cohort, CAST(sum(y) AS BIGINT) AS n1, CAST(sum(1 - y) AS BIGINT) AS n0, {AREA} AS auc FROM ({_ranked("cohort", "s", "s")}) GROUP BY 1""")
def zero_shot_transfer(spark, d):
    e = _labelled(spark, d).withColumn("cohort", F.col("vec_id") % 4)
    return tr.zero_shot(e.where("cohort = 0"), e.where("cohort <> 0"), "vec_id", "f", "v", "y", "cohort")


TOP = "QUALIFY row_number() OVER ({0} ORDER BY round(abs(auc - 0.5), 12) DESC, f) <= 8"


@query(f"""WITH {LABELLED}, k AS (SELECT *, {H("0", "0", "vec_id")} % 3 AS fold FROM e), t AS (SELECT h.held, k.* FROM k JOIN (SELECT unnest([0, 1, 2]) AS held) h ON k.fold <> h.held),
i AS (SELECT held, f, sign(auc - 0.5) AS way FROM (SELECT held, f, {AREA} AS auc FROM ({_ranked("held, f", "v", "t")}) GROUP BY 1, 2) {TOP.format("PARTITION BY held")}), o AS (SELECT f, sign(auc - 0.5) AS way FROM (SELECT f, {AREA} AS auc FROM ({_ranked("f", "v", "k")}) GROUP BY 1) {TOP.format("")}),
a AS (SELECT vec_id, y, sum(v * way) AS s FROM k JOIN o USING (f) GROUP BY 1, 2), b AS (SELECT vec_id, y, sum(v * way) AS s FROM k JOIN i ON i.held = fold AND i.f = k.f GROUP BY 1, 2), x AS (SELECT {AREA} AS fixed FROM ({_ranked("", "s", "a")})), z AS (SELECT {AREA} AS nested FROM ({_ranked("", "s", "b")}))
SELECT fixed, nested, fixed - nested AS optimism FROM x, z""")
def nested_selection_optimism(spark, d):
    e = _labelled(spark, d).withColumn("fold", hashed(0, "vec_id") % 3)
    return tr.nested_selection(e, "vec_id", "f", "v", "y", "fold", 8)


@query()
def lodo_trim(spark, d):
    """The panel of all dimensions, without each of three datasets: the two that go first."""
    e = _labelled(spark, d).withColumn("dataset", F.col("vec_id") % 3)
    n = e.agg(F.max("f")).first()[0] or 0
    return spark.createDataFrame(tr.trim_without_each(e, "vec_id", "f", "v", "y", "dataset", n - 1), "held_out long, step int, dropped int, score double")
