"""Models over tasks: every (repeat, fold, candidate) is one fit of a grid, made from sums that Spark takes; the driver only steers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..sources.tables import checkpointed
from .ranks import LARGEST, MOST_RANGES, joined
from .resampling import weighted_auc


MOST_FITS = 20_000  # fits that are steered at once; the driver holds their coefficients and sums, never rows


def logistic_fits(rows: DataFrame, fit: list[str], label: str, features: list[str], c: float = 1.0, steps: int = 30) -> tuple[DataFrame, dict]:
    """Ridge logistic regressions, one per combination of the columns `fit`, by Newton steps whose gradients and curvatures are sums over rows.

    A step is one aggregate (combined before the shuffle); the driver solves a system of the features' size per fit. Features must be without nulls.
    Returns the coefficients as a frame (fit, _beta: intercept first, not shrunk; null for rows of one class) and as a dictionary with each fit's rate of class 1.
    """
    rows = checkpointed(rows.select(*fit, label, *features))  # read once per step
    spark, k = rows.sparkSession, len(features) + 1
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    sizes = rows.groupBy(*fit).agg(F.avg(F.col(label).cast("double")).alias("_rate")).limit(MOST_FITS + 1).collect() if fit else rows.agg(F.avg(F.col(label).cast("double")).alias("_rate")).collect()
    if len(sizes) > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} fits at once: take fewer candidates a step")
    rate = {tuple(r[f] for f in fit): r["_rate"] for r in sizes if r["_rate"] is not None}
    beta = {key: np.zeros(k) for key, v in rate.items() if 0 < v < 1}
    shrink = np.array([1e-9] + [1 / c] * (k - 1))
    schema = StructType([*[rows.schema[f] for f in fit], StructField("_beta", ArrayType(DoubleType()))])

    def frame(of: dict) -> DataFrame:
        return spark.createDataFrame([(*key, b.tolist()) for key, b in of.items()], schema)

    going = set(beta)
    for _ in range(steps):
        if not going:
            break
        now = joined(rows, F.broadcast(frame({key: beta[key] for key in going})), fit)  # at most MOST_FITS rows
        score = sum((F.col("_beta")[i] * v for i, v in enumerate(x)), F.lit(0.0))
        now = now.withColumn("_p", 1 / (1 + F.exp(-F.least(F.greatest(score, F.lit(-30.0)), F.lit(30.0)))))
        w, miss = F.col("_p") * (1 - F.col("_p")), F.col(label) - F.col("_p")
        sums = [F.sum(miss * v).alias(f"_g{i}") for i, v in enumerate(x)] + [F.sum(w * x[i] * x[j]).alias(f"_h{i}_{j}") for i in range(k) for j in range(i, k)]
        for r in now.groupBy(*fit).agg(*sums).collect():
            key = tuple(r[f] for f in fit)
            h = np.empty((k, k))
            for i in range(k):
                for j in range(i, k):
                    h[i, j] = h[j, i] = r[f"_h{i}_{j}"]
            move = np.linalg.solve(h + np.diag(shrink), np.array([r[f"_g{i}"] for i in range(k)]) - shrink * beta[key])
            beta[key] = beta[key] + move
            if np.abs(move).max() < 1e-9:
                going.discard(key)
    return frame(beta), rate


def out_of_fold(df: DataFrame, task: list[str], fold: str, key: str, label: str, features: list[str], c: float = 1.0) -> DataFrame:
    """Scores of rows by models that have not seen their fold: scaling and model are refitted per task and fold. task columns, key, label, score.

    Rows are counted for the fits of the other folds where they lie; only sums per task and fold are shuffled, so no cohort comes to one task.
    Null features count as the training mean; a fold whose training rows are of one class scores their rate.
    """
    known = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    rows = df.select(*task, fold, key, F.col(label).cast("double").alias(label), *[known(f).alias(f) for f in features])
    held = rows.select(*task, fold).distinct().withColumnRenamed(fold, "_held")
    train = joined(rows, held, task) if task else rows.join(F.broadcast(held))  # folds
    train = train.where(~F.col(fold).eqNullSafe(F.col("_held")))
    m = train.groupBy(*task, "_held").agg(*[a for f in features for a in (F.coalesce(F.avg(f), F.lit(0.0)).alias(f"_m_{f}"), F.stddev_pop(F.col(f)).alias(f"_s_{f}"), F.count("*").alias(f"_a_{f}"), F.count(f).alias(f"_k_{f}"))])
    # a null is the mean, which narrows the spread by the share of known values
    spread = {f: F.col(f"_s_{f}") * F.sqrt(F.col(f"_k_{f}") / F.col(f"_a_{f}")) for f in features}
    scaled = [(F.coalesce(F.col(f) - F.col(f"_m_{f}"), F.lit(0.0)) / F.when(spread[f] > 0, spread[f]).otherwise(1.0)).alias(f) for f in features]
    fitted = joined(train.where(F.col(label).isNotNull()), m, [*task, "_held"]).select(*task, "_held", label, *scaled)
    betas, rate = logistic_fits(fitted, [*task, "_held"], label, features, c)
    test = joined(rows.withColumn("_held", F.col(fold)), m, [*task, "_held"], "left").select(*task, "_held", key, label, *[F.coalesce(x, F.lit(0.0)).alias(f) for f, x in zip(features, scaled, strict=True)])
    score = sum((F.col("_beta")[i + 1] * F.col(f) for i, f in enumerate(features)), F.col("_beta")[0])
    rates = df.sparkSession.createDataFrame([(*k, float(v)) for k, v in rate.items()], StructType([*[rows.schema[t] for t in task], StructField("_held", rows.schema[fold].dataType), StructField("_rate", DoubleType())]))
    out = joined(joined(test, betas, [*task, "_held"], "left"), rates, [*task, "_held"], "left")
    fine = 1 / (1 + F.exp(-F.least(F.greatest(score, F.lit(-30.0)), F.lit(30.0))))
    return out.select(*task, key, label, F.coalesce(fine, "_rate", F.lit(0.5)).alias("score"))


def pooled_auc_of(scores: DataFrame, task: list[str], repeat: str | None, key: str, label: str) -> DataFrame:
    """Area per task of the scores averaged over repeats."""
    t = [c for c in task if c != repeat]
    m = scores.groupBy(*t, key, label).agg(F.avg("score").alias("score")).withColumn("_one", F.lit(1))
    return weighted_auc(m, "score", label, "_one", t)


def backward_elimination(score: Callable[[list[list[str]]], DataFrame], features: list[str], keep: int = 1, done: list[str] | None = None) -> list[tuple[str, float]]:
    """Drops, again and again, the feature whose removal scores best (ties: the first). score takes the candidate sets of a step and returns rows (candidate, score).

    One Spark job per step; the driver sees one row per candidate. Steps already done can be passed in to resume.
    """
    left = [f for f in features if f not in (done or [])]
    out = []
    while len(left) > keep:
        best = score([[g for g in left if g != f] for f in left]).orderBy(F.desc("score"), "candidate").limit(1).collect()[0]
        out.append((left.pop(best["candidate"]), float(best["score"])))
    return out


def forward_selection(score: Callable[[list[list[str]]], DataFrame], pool: list[str], size: int) -> list[tuple[str, float]]:
    """Adds, again and again, the feature that scores best together with those taken."""
    taken: list[str] = []
    out = []
    while len(taken) < size and len(taken) < len(pool):
        rest = [f for f in pool if f not in taken]
        best = score([[*taken, f] for f in rest]).orderBy(F.desc("score"), "candidate").limit(1).collect()[0]
        taken.append(rest[best["candidate"]])
        out.append((taken[-1], float(best["score"])))
    return out


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: str) -> tuple[DataFrame, int]:
    """Applies step (select, flag, discard) until no key is dropped any more; lineage is cut by checkpoint. Each round but the last drops a key, so it ends."""
    now, n, k = start, start.select(key).distinct().count(), 0
    while True:
        now, k = checkpointed(step(now)), k + 1
        m = now.select(key).distinct().count()
        if m == n:
            return now, k
        n = m


def combo_gain(single: DataFrame, combos: DataFrame) -> DataFrame:
    """Synergy of sets (members array, auc): their area less the best single member's (feature, auc)."""
    c = combos.withColumn("_m", F.array_sort("members")).dropDuplicates(["_m"])
    best = c.select("_m", F.explode("_m").alias("feature")).join(single.withColumnRenamed("auc", "_a"), "feature").groupBy("_m").agg(F.max("_a").alias("_best"))
    return c.join(best, "_m").select(F.col("_m").alias("members"), "auc", (F.col("auc") - F.col("_best")).alias("synergy"))


PAIR_SUMS = 1 << 25  # sums of two features that a task of pair_areas works out
_RUN = "a int, b int, range int, pos binary, pos_n binary, neg binary, neg_n binary"


def _distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The sorted distinct values and how often each occurs (None: once each)."""
    v = np.sort(v)
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    return (v, None) if len(first) == len(v) else (v[first], np.diff(np.append(first, len(v))))


def _merged(values: pa.ChunkedArray, times: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray | None]:
    """Runs as one sorted one."""
    runs = [np.frombuffer(x, "<f8") for x in values.to_pylist()]
    counts = [np.frombuffer(x, "<i8") for x in times.to_pylist()]
    v = np.concatenate(runs)
    if not any(len(c) for c in counts):
        return np.sort(v), None
    order = np.argsort(v)
    return v[order], np.concatenate([c if len(c) else np.ones(len(r), np.int64) for r, c in zip(runs, counts, strict=True)])[order]


def _areas_of_runs(t: pa.Table) -> pa.Table:
    """Of one pair and range: rows of class 1 and 0, and twice the number of pairs of rows in order (ties count half)."""
    (pos, pos_n), (neg, neg_n) = _merged(t["pos"], t["pos_n"]), _merged(t["neg"], t["neg_n"])
    below, upto = np.searchsorted(neg, pos, "left"), np.searchsorted(neg, pos, "right")
    if neg_n is not None:
        total = np.append(0, np.cumsum(neg_n))
        below, upto = total[below], total[upto]
    u = (below + upto) if pos_n is None else (below + upto) * pos_n
    sizes = [len(v) if n is None else int(n.sum()) for v, n in ((pos, pos_n), (neg, neg_n))]
    return pa.table({**{c: t[c].slice(0, 1) for c in ("a", "b", "range")}, "p": pa.array([sizes[0]], pa.int64()), "q": pa.array([sizes[1]], pa.int64()), "u": pa.array([int(u.sum())], pa.int64())})


def pair_areas(df: DataFrame, left: str, right: str, label: str, largest: int = LARGEST) -> DataFrame:
    """a, b (places from 0, a < b), auc: areas of left[a] + right[b], elements of two array columns, for all pairs of places. Rows without the label or one of the elements are left out.

    Tasks hold some rows and write, per pair and class, the sorted distinct sums as one binary; a pair's runs meet in as many tasks as its sums have ranges of about `largest` values. Ranges are cut
    at quantiles of a sample; any cuts give the same areas.
    """
    known = df.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(label).isNotNull())
    known = known.select(F.col(left).cast("array<double>").alias("x"), F.col(right).cast("array<double>").alias("w"), (F.col(label) == 1).alias("hit"))
    known = checkpointed(known)
    n, p = known.agg(F.count("*"), F.max(F.greatest(F.size("x"), F.size("w")))).first()
    p = p or 0
    sums = n * p * (p - 1) // 2
    ranges = min(MOST_RANGES, math.ceil(n / largest)) or 1

    def padded(c: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Elements, a place a row, and which there are."""
        size = np.asarray(c.value_lengths()).astype(np.int64)
        at = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat = c.flatten()
        v, there = np.zeros((p, len(size))), np.zeros((p, len(size)), bool)
        v[at[::-1]], there[at[::-1]] = flat.to_numpy(zero_copy_only=False), np.asarray(flat.is_valid())
        return v, there

    cuts = np.zeros((p, p, 0))
    if ranges > 1:
        sample = known.sample(min(1.0, min(4000, 1 + 4_000_000 // p) / n), seed=1).toArrow().combine_chunks()
        (x, _), (w, _) = (padded(sample[c].combine_chunks()) for c in ("x", "w"))
        if len(sample):
            places = len(sample) * np.arange(1, ranges) // ranges
            cuts = np.stack([np.sort(x[a] + w, axis=1)[:, places] for a in range(p)])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def made(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows).combine_chunks()
            (x, x_there), (w, w_there) = (padded(t[c].combine_chunks()) for c in ("x", "w"))
            hit = np.asarray(t["hit"].combine_chunks())
            whole = x_there.all() and w_there.all()
            sides = [[np.ascontiguousarray(m[:, k]) for m in (x, w, x_there, w_there)] for k in (np.flatnonzero(hit), np.flatnonzero(~hit))]
            out, size = [], 0
            for a in range(p):
                for b in range(a + 1, p):
                    found = []
                    for sx, sw, sx_there, sw_there in sides:
                        v = sx[a] + sw[b]
                        v, times = _distinct(v if whole else v[sx_there[a] & sw_there[b]])
                        found.append((v, times, [0, *np.searchsorted(v, cuts[a, b]).tolist(), len(v)]))
                    for k in range(cuts.shape[2] + 1):
                        row = {"a": a, "b": b, "range": k}
                        for name, (v, times, at) in zip(("pos", "neg"), found, strict=True):
                            row[name] = v[at[k] : at[k + 1]].tobytes()
                            row[f"{name}_n"] = b"" if times is None else times[at[k] : at[k + 1]].tobytes()
                        if row["pos"] or row["neg"]:
                            out.append(row)
                            size += sum(len(row[c]) for c in ("pos", "neg", "pos_n", "neg_n"))
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

        schema = pa.schema([*[(c, pa.int32()) for c in ("a", "b", "range")], *[(c, pa.binary()) for c in ("pos", "pos_n", "neg", "neg_n")]])
        for batch in batches:
            rows.append(batch)
            held += batch.num_rows
            if held * p > 1 << 21:
                yield from made(rows)
                rows, held = [], 0
        if held:
            yield from made(rows)

    dealt = known.repartition(1 + sums // PAIR_SUMS).mapInArrow(runs, _RUN)
    met = dealt.repartition(1 + sums // (PAIR_SUMS // 4), "a", "b", "range").groupBy("a", "b", "range").applyInArrow(_areas_of_runs, "a int, b int, range int, p long, q long, u long")
    before = F.coalesce(F.sum("q").over(Window.partitionBy("a", "b").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = met.withColumn("_before", before).groupBy("a", "b").agg(F.sum(F.col("u") + 2 * F.col("p") * F.col("_before")).alias("_u"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    return g.select("a", "b", F.try_divide(F.col("_u") / F.lit(2.0), (F.col("_p") * F.col("_q")).cast("double")).alias("auc"))
