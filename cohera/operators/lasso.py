"""Neighbourhoods by the lasso: each feature is explained by few others; links are then looked for in a second cohort.

Products of features are summed once, per fold, by the tasks that hold the rows. A fold is left out by subtracting its sums, so the path of every
(target, fold) needs no row again. Targets of a block descend together, coordinate by coordinate; blocks and folds are tasks. Sums are features squared
times folds: MOST_NUMBERS bounds them, and they go to the tasks as one broadcast value.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NUMBERS = 16_000_000
BLOCK = 64  # targets of a task


class Products(NamedTuple):
    """Per fold: rows, sums and products of features less `mean`, over `spread`."""

    n: np.ndarray
    sums: np.ndarray
    products: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def products(df: DataFrame, features: str, fold: str, folds: int) -> Products:
    """Sums over rows of an array column, scaled by all rows' mean and spread; rows with nulls or NaN are left out, constant features stay 0."""
    fine = df.where(F.col(features).isNotNull() & F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v))).select(F.col(features).cast("array<double>").alias("x"), F.col(fold).cast("int").alias("fold"))
    sizes = fine.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if sizes[0] is None or sizes[0] != sizes[1]:
        raise ValueError("rows are missing or have arrays of unequal length")
    p = sizes[0]
    if folds * p * p > MOST_NUMBERS:
        raise ValueError(f"{p} features in {folds} folds are more than {MOST_NUMBERS} products")

    def summed(width: int, make) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((folds, width))
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p)
                at = b.column(1).to_numpy(zero_copy_only=False)
                for f in range(folds):
                    if (at == f).any():
                        total[f] += make(x[at == f])
            i = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel()[i])], names=["at", "v"])

        got = fine.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(folds * width)
        flat[np.asarray(got["at"])] = np.asarray(got["v"])
        return flat.reshape(folds, width)

    first = summed(1 + p, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]))
    n = first[:, 0]
    mean = first[:, 1:].sum(axis=0) / n.sum()
    moved = summed(p + p * p, lambda x: np.concatenate([(x - mean).sum(axis=0), ((x - mean).T @ (x - mean)).ravel()]))
    cross = moved[:, p:].reshape(folds, p, p)
    variance = np.maximum(np.diag(cross.sum(axis=0)) / n.sum(), 0)
    spread = np.where(variance > 1e-24 * (1 + mean**2), np.sqrt(variance), np.inf)  # constant: 0 everywhere
    return Products(n, moved[:, :p] / spread, cross / np.outer(spread, spread), mean, spread)


def centred(s: Products, rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, means and mean products about the mean of the folds that `rows` selects."""
    n, m = s.n[rows].sum(), s.sums[rows].sum(axis=0)
    m = m / n
    return n, m, s.products[rows].sum(axis=0) / n - np.outer(m, m)


def descend(g: np.ndarray, targets: np.ndarray, alphas: np.ndarray, most: int = 20_000, tolerance: float = 1e-9) -> Iterator[np.ndarray]:
    """For each column of alphas (targets x path, falling): coefficients targets x features that minimise half the mean squared error plus alpha times their sizes.

    After every third round of coordinates, the features in use are solved for exactly; a target whose solution keeps their signs and meets the optimality conditions is settled.
    """
    p = len(g)
    w, c = np.zeros((len(targets), p)), g[targets]
    diagonal = np.diag(g)
    free = (np.arange(p) != targets[:, None]) & (diagonal > 1e-12)
    active = np.flatnonzero(diagonal > 1e-12)
    for a in range(alphas.shape[1]):
        alpha = alphas[:, a]
        live = np.arange(len(targets))
        for turn in range(most):
            v, largest = w[live], np.zeros(len(live))
            for j in active:
                rest = c[live, j] - v @ g[:, j] + v[:, j] * diagonal[j]
                new = np.where(free[live, j], np.sign(rest) * np.maximum(np.abs(rest) - alpha[live], 0) / diagonal[j], 0.0)
                largest = np.maximum(largest, np.abs(new - v[:, j]))
                v[:, j] = new
            w[live] = v
            settled = largest < tolerance
            if turn % 3 == 2:
                for k in np.flatnonzero(~settled):
                    t = live[k]
                    settled[k] = _solved(g, c[t], w[t], alpha[t], free[t])
            live = live[~settled]
            if not len(live):
                break
        else:
            raise ValueError(f"coordinate descent has not converged in {most} rounds")
        yield w.copy()


def _solved(g: np.ndarray, c: np.ndarray, w: np.ndarray, alpha: float, free: np.ndarray) -> bool:
    """Puts the exact solution for the features in use into w, if it is the minimum."""
    use = np.flatnonzero(w)
    sign = np.sign(w[use])
    try:
        exact = np.linalg.solve(g[np.ix_(use, use)], c[use] - alpha * sign)
    except np.linalg.LinAlgError:
        return False
    if not (np.sign(exact) == sign).all():
        return False
    rest = np.abs(c - g[:, use] @ exact)
    rest[use] = 0
    if (rest[free] > alpha * (1 + 1e-9) + 1e-12).any():
        return False
    w[use] = exact
    return True


def path_of(g: np.ndarray, targets: np.ndarray, length: int, least: float) -> np.ndarray:
    """Falling penalties per target, from the one that leaves nothing to `least` of it."""
    reach = np.abs(g[targets])
    reach[np.arange(len(targets)), targets] = 0
    top = np.maximum(reach.max(axis=1), 1e-12)
    return top[:, None] * least ** (np.arange(length) / max(1, length - 1))


def lasso_neighbours(df: DataFrame, features: str, fold: str, folds: int, length: int = 100, least: float = 1e-3) -> DataFrame:
    """target, neighbour, coefficient (of scaled features), alpha: the neighbours of every feature at the penalty whose mean squared error over held-out folds is least (ties: the largest)."""
    spark = df.sparkSession
    s = products(df, features, fold, folds)
    p = len(s.mean)
    shared = spark.sparkContext.broadcast(s)
    there = [f for f in range(folds) if s.n[f] > 0]
    if len(there) < 2:
        raise ValueError("fewer than two folds have rows")
    every = np.arange(folds) >= 0

    def errors(rows: pd.DataFrame) -> pd.DataFrame:
        s = shared.value
        block, held = int(rows["block"].iloc[0]), int(rows["held"].iloc[0])
        targets = np.arange(block * BLOCK, min(p, (block + 1) * BLOCK))
        alphas = path_of(centred(s, every)[2], targets, length, least)
        _, m, g = centred(s, np.arange(folds) != held)
        n, sums, q = s.n[held], s.sums[held], s.products[held]
        out = []
        for k, w in enumerate(descend(g, targets, alphas)):
            r = -w
            r[np.arange(len(targets)), targets] = 1.0  # what is left over is r x - base
            base = r @ m
            square = np.einsum("ti,ij,tj->t", r, q, r) - 2 * base * (r @ sums) + n * base**2
            out.append(pd.DataFrame({"target": targets, "step": k, "error": square / n}))
        return pd.concat(out)

    def refit(rows: pd.DataFrame) -> pd.DataFrame:
        s = shared.value
        rows = rows.sort_values("target")
        targets, steps = rows["target"].to_numpy(), rows["step"].to_numpy()
        _, _, g = centred(s, every)
        alphas = path_of(g, targets, length, least)
        out = []
        for k, w in enumerate(descend(g, targets, alphas[:, : steps.max() + 1])):
            for t in np.flatnonzero(steps == k):
                near = np.flatnonzero(w[t])
                out.append(pd.DataFrame({"target": targets[t], "neighbour": near, "coefficient": w[t, near], "alpha": alphas[t, k]}))
        return pd.concat(out)

    blocks = -(-p // BLOCK)
    tasks = spark.range(blocks * len(there)).select((F.col("id") % blocks).cast("int").alias("block"), F.element_at(F.array(*[F.lit(f) for f in there]), (F.floor(F.col("id") / blocks) + 1).cast("int")).alias("held"))
    held = tasks.groupBy("block", "held").applyInPandas(errors, "target int, step int, error double")
    mean = held.groupBy("target", "step").agg(F.round(F.avg("error"), 12).alias("error"))
    best = mean.groupBy("target").agg(F.min(F.struct("error", "step")).alias("b")).select("target", F.col("b.step").alias("step"))
    return best.groupBy(F.floor(F.col("target") / BLOCK).alias("block")).applyInPandas(refit, "target int, neighbour int, coefficient double, alpha double")


def replicated(pairs: DataFrame, first: DataFrame, second: DataFrame, least: float = 0.2) -> DataFrame:
    """pairs (target, neighbour and others) with r_first, r_second (from tables a, b, r that hold either order once) and whether the second cohort's correlation has the
    first one's sign and at least this size; a pair that a cohort lacks is not replicated."""
    def named(r: DataFrame, name: str) -> DataFrame:
        both = r.select("a", "b", "r").union(r.select(F.col("b"), F.col("a"), F.col("r")))
        return both.select(F.col("a").alias("target"), F.col("b").alias("neighbour"), F.col("r").alias(name))

    out = pairs.join(named(first, "r_first"), ["target", "neighbour"], "left").join(named(second, "r_second"), ["target", "neighbour"], "left")
    kept = (F.abs("r_second") >= least) & (F.signum("r_first") == F.signum("r_second"))
    return out.withColumn("replicated", F.coalesce(kept, F.lit(False)))


def correlations(df: DataFrame, features: str) -> DataFrame:
    """a, b (a < b), r of every pair of an array column's features, from the products of one reading; null where a feature is constant."""
    s = products(df.withColumn("_all", F.lit(0)), features, "_all", 1)
    _, _, g = centred(s, np.array([True]))
    d = np.sqrt(np.maximum(np.diag(g), 0))
    a, b = np.triu_indices(len(g), 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = g[a, b] / (d[a] * d[b])
    table = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "r": pa.array(r, mask=np.isnan(r))})
    return df.sparkSession.createDataFrame(table)
