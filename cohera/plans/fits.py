"""Queries on grids of fits, lasso neighbourhoods, skeletons and centrality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, lasso, panels
from ..operators import networks as nw
from ..operators import resampling as rs
from ..operators import stats as st
from ..operators import transfer as tr
from ..sources.tables import parquet
from .modelling import H, _sample
from .registry import normal_p, query


def _wide(spark, d):
    """Embeddings with a label, as rows of all their dimensions."""
    return parquet(spark, d, "embeddings").where("label is not null").select("vec_id", (F.col("label") % 2).alias("y"), "embedding")


def _dims(spark, d):
    n = parquet(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return [f"f{k}" for k in range(n)]


def _columns(df, names):
    return df.select("*", *[F.col("embedding")[k].cast("double").alias(f) for k, f in enumerate(names)])


@query()
def lasso_neighbourhoods(spark, d):
    """Neighbours of every dimension among vectors of even id, looked for again among the others."""
    e = parquet(spark, d, "embeddings")
    first, second = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")
    pairs = lasso.lasso_neighbours(first.withColumn("fold", grids.fold_column("vec_id", 5)), "embedding", "fold", 5)
    return lasso.replicated(pairs, lasso.correlations(first, "embedding"), lasso.correlations(second, "embedding"))


@query("""WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS f, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
c AS (SELECT vec_id % 2 AS half, CAST(x.f AS INTEGER) AS target, CAST(y.f AS INTEGER) AS neighbour, corr(x.v, y.v) AS r FROM e x JOIN e y USING (vec_id) WHERE x.f < y.f GROUP BY ALL)
SELECT target, neighbour, a.r AS r_first, b.r AS r_second, abs(b.r) >= 0.05 AND sign(a.r) = sign(b.r) AS replicated FROM c a JOIN c b USING (target, neighbour) WHERE a.half = 0 AND b.half = 1 AND abs(a.r) >= 0.05""")
def replicated_correlations(spark, d):
    e = parquet(spark, d, "embeddings")
    first, second = (lasso.correlations(e.where(F.col("vec_id") % 2 == k), "embedding") for k in (0, 1))
    pairs = first.where("abs(r) >= 0.05").select(F.col("a").alias("target"), F.col("b").alias("neighbour"))
    return lasso.replicated(pairs, first, second, 0.05)


@query()
def logistic_search_c(spark, d):
    e = _wide(spark, d).withColumn("fold", grids.fold_column("vec_id", 5))
    return grids.search_c(grids.Grid(e, "vec_id", "y", "embedding", ["fold"]), list(range(5)), [10.0 ** (-4 + 8 * k / 9) for k in range(10)])[0]


@query()
def seed_ensemble_auc(spark, d):
    """Area of scores averaged over seeds, each with a part of the rows and of the dimensions."""
    names = _dims(spark, d)
    e = _columns(_wide(spark, d), names).withColumn("fold", grids.fold_column("vec_id", 5))
    scores = grids.seed_ensemble(e, "vec_id", "y", names, "fold", list(range(5)), [1, 2, 3, 4], 24, 0.1, 1000)
    return grids.areas(scores.withColumn("fit", F.lit(0)))


@query()
def backward_elimination(spark, d):
    """Of all dimensions, the two that go first."""
    names = _dims(spark, d)
    e = _wide(spark, d).withColumn("fold", grids.fold_column("vec_id", 3))
    out = grids.eliminated(grids.Grid(e, "vec_id", "y", "embedding", ["fold"]), names, [0, 1, 2], keep=max(1, len(names) - 2))
    return spark.createDataFrame(out, "dropped string, score double")


@query()
def pooled_out_of_fold_auc(spark, d):
    f = rs.folds(_sample(spark, d), "doc_id", 5, ["y"], 2)
    wide = f.groupBy("doc_id", "s", "t", "y").agg(*[F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(f"fold{r}") for r in range(2)])
    grid = grids.Grid(wide, "doc_id", "y", ["s", "t"], ["fold0", "fold1"])
    fits = [grids.Fit(((r, k),), test=(r, k)) for r in range(2) for k in range(5)]
    scores = grid.scores(fits, grid.fitted(fits)).groupBy("key", "y").agg(F.avg("score").alias("score"))
    return grids.areas(scores.withColumn("fit", F.lit(0))).select("auc")


@query()
def weighted_betweenness(spark, d):
    """Brands and types of parts, linked by the mean price of the parts of both."""
    p = parquet(spark, d, "part").groupBy("p_brand", "p_type").agg((F.round(F.avg("p_retailprice"), 2) / 1000).alias("length"))
    return nw.betweenness(p, "p_brand", "p_type", "length")


def _deep(spark, d):
    e = parquet(spark, d, "embeddings")
    return nw.deep_skeleton(lasso.correlations(e, "embedding"), e.where("embedding is not null").count(), 3)


@query()
def deep_skeleton_edges(spark, d):
    return _deep(spark, d)[0]


@query()
def deep_skeleton_separations(spark, d):
    return _deep(spark, d)[1]


LONG = "e AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS f, CAST(unnest(embedding) AS DOUBLE) AS v, label % 2 AS y, vec_id % 5 AS fold FROM embeddings WHERE label IS NOT NULL)"
AREA = "SELECT arm, draw, fold, CAST((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) AS DOUBLE) / (sum(y) * sum(1 - y)) AS auc FROM (SELECT *, rank() OVER (PARTITION BY arm, draw, fold ORDER BY s) + (count(*) OVER (PARTITION BY arm, draw, fold, s) - 1) / 2.0 AS r FROM s) GROUP BY ALL"
WEIGHT = "sqrt(greatest(q / n - (s / n) * (s / n), 0.0)) AS spread, (s1 / n1 - (s - s1) / (n - n1)) / sqrt(greatest(q / n - (s / n) * (s / n), 0.0)) AS w"
BEST = "row_number() OVER (PARTITION BY {0} ORDER BY round(abs(w), 12) DESC, f) <= 8"


@query(f"""WITH {LONG}, o AS (SELECT fold, f, count(*) AS n, sum(v) AS s, sum(v * v) AS q, sum(y) AS n1, sum(v * y) AS s1 FROM e GROUP BY 1, 2),
t AS (SELECT f, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(n1) AS n1, sum(s1) AS s1 FROM o GROUP BY 1), x AS (SELECT o.fold, f, t.n - o.n AS n, t.s - o.s AS s, t.q - o.q AS q, t.n1 - o.n1 AS n1, t.s1 - o.s1 AS s1 FROM o JOIN t USING (f)),
w AS (SELECT fold, f, {WEIGHT} FROM x), a AS (SELECT f, {WEIGHT} FROM t), d AS (SELECT unnest(range(1, 6)) AS draw),
p AS (SELECT 'fixed' AS arm, 0 AS draw, fold, f FROM w WHERE f < 8
  UNION ALL SELECT 'full_data', 0, fold, f FROM w WHERE f IN (SELECT f FROM a QUALIFY {BEST.format('1')})
  UNION ALL (SELECT 'pool_fixed', 0, fold, f FROM w WHERE f % 2 = 0 QUALIFY {BEST.format('fold')}) UNION ALL (SELECT 'nested', 0, fold, f FROM w QUALIFY {BEST.format('fold')})
  UNION ALL (SELECT 'random_pool', draw, fold, f FROM w, d WHERE f % 2 = 0 QUALIFY row_number() OVER (PARTITION BY fold, draw ORDER BY {H("0", "draw", "fold", "f")}, f) <= 8)
  UNION ALL (SELECT 'random_all', draw, fold, f FROM w, d QUALIFY row_number() OVER (PARTITION BY fold, draw ORDER BY {H("0", "draw", "fold", "f")}, f) <= 8)),
s AS (SELECT arm, draw, fold, vec_id, y, round(sum(w * v / spread), 10) AS s FROM e JOIN w USING (fold, f) JOIN p USING (fold, f) GROUP BY ALL), u AS ({AREA}),
m AS (SELECT arm, avg(auc) AS auc FROM (SELECT arm, fold, avg(auc) AS auc FROM u GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT {', '.join(f"max(auc) FILTER (arm = '{k}') AS {k}" for k in tr.ARMS)} FROM m)
SELECT *, fixed - nested AS total, fixed - full_data AS approximation, full_data - pool_fixed AS ranking, pool_fixed - nested AS pooling FROM r""")
def selection_decomposition(spark, d):
    e = parquet(spark, d, "embeddings").where("label is not null").select("vec_id", (F.col("label") % 2).alias("y"), (F.col("vec_id") % 5).alias("fold"), F.posexplode("embedding").alias("f", "v"))
    e = e.withColumn("v", F.col("v").cast("double"))
    dims = e.select("f").distinct()
    return tr.decomposition(e, "vec_id", "f", "v", "y", "fold", dims.where("f < 8"), dims.where("f % 2 = 0"), 8, 5)


@query()
def forward_swaps(spark, d):
    """Every dimension of an even panel may be swapped for the next one; the second cohort lacks a quarter of the replacements."""
    e = parquet(spark, d, "embeddings").where("label is not null").select("vec_id", (F.col("label") % 2).alias("y"), F.posexplode("embedding").alias("f", "v")).withColumn("v", F.col("v").cast("double"))
    train, rest = e.where("vec_id % 3 = 0"), e.where("vec_id % 3 <> 0").withColumn("cohort", F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")))
    rest = rest.where("not (cohort = 'c2' and f % 8 = 1)")
    n = parquet(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    slots = [(k, 2 * k) for k in range(n // 2)]
    steps = tr.forward_swaps(train, rest, slots, {k: 2 * k + 1 for k, _ in slots}, "c1", "vec_id", "f", "v", "y", "cohort")
    rows = [(s["step"], s["slot"], s["replacement"], s["gain"], s["areas"].get("c1"), s["areas"].get("c2")) for s in steps]
    return spark.createDataFrame(rows, "step int, slot int, replacement int, gain double, auc_c1 double, auc_c2 double")


@query(f"""WITH x AS (SELECT p_brand, l_extendedprice AS x, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT p_brand, x, sum(y) AS p, sum(1 - y) AS q, count(*) AS t FROM x GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY p_brand ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
g AS (SELECT p_brand, CAST(sum(p) AS DOUBLE) AS n1, CAST(sum(q) AS DOUBLE) AS n0, CAST(sum(p * (below + q / 2.0)) AS DOUBLE) AS u, CAST(sum(t * (t * t - 1)) AS DOUBLE) AS ties FROM b GROUP BY 1),
o AS (SELECT *, u - n1 * n0 / 2 AS off, sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM g),
k AS (SELECT p_brand, 'less' AS side, (-off - 0.5) / sd AS z FROM o UNION ALL SELECT p_brand, 'greater', (off - 0.5) / sd FROM o), {normal_p('k', 'z')}
SELECT p_brand, max(CASE WHEN z >= 0 THEN p / 2 ELSE 1 - p / 2 END) FILTER (side = 'less') AS p_less, max(CASE WHEN z >= 0 THEN p / 2 ELSE 1 - p / 2 END) FILTER (side = 'greater') AS p_greater FROM p GROUP BY 1""")
def one_sided_rank_tests(spark, d):
    x = parquet(spark, d, "lineitem").join(parquet(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select("p_brand", F.col("l_extendedprice").alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return st.mann_whitney_sides(x, "x", "y", ["p_brand"]).select("p_brand", "p_less", "p_greater")


PANELS = "m AS (SELECT p_brand AS panel, p_name AS symbol, p_partkey AS feature, p_type NOT LIKE '%BRASS' AS coding, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS position FROM part QUALIFY position <= 25)"


def _panels(spark, d):
    return panels.panel_table(parquet(spark, d, "part"), "p_brand", "p_name", "p_partkey", [F.desc("p_retailprice"), "p_partkey"], ~F.col("p_type").like("%BRASS"), 25)


@query(f"WITH {PANELS} SELECT panel, position, symbol, feature FROM m WHERE position <= 7 AND coding")
def critical_panel_members(spark, d):
    return panels.members(_panels(spark, d), 7, True).select("panel", "position", "symbol", "feature")


@query(f"WITH {PANELS} SELECT panel, count(*) AS size, count(*) || '-gene core panel' AS label FROM m GROUP BY 1")
def panel_sizes(spark, d):
    return panels.sizes(_panels(spark, d), "core panel")


@query(f"WITH {PANELS}, e AS (SELECT l_partkey AS feature, avg(l_extendedprice) FILTER (l_returnflag = 'R') - avg(l_extendedprice) FILTER (l_returnflag <> 'R') AS e FROM lineitem GROUP BY 1) SELECT panel, symbol, CASE WHEN e > 0 THEN 'up' WHEN e < 0 THEN 'down' END AS direction FROM m LEFT JOIN e USING (feature)")
def panel_directions(spark, d):
    x = F.col("l_extendedprice")
    e = parquet(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg((F.avg(F.when(F.col("l_returnflag") == "R", x)) - F.avg(F.when(F.col("l_returnflag") != "R", x))).alias("effect"))
    return panels.directions(_panels(spark, d), e, "effect")
