"""Grids of logistic fits over one reading of the rows.

Rows are packed once (key, label, array of features, one fold per level) and written. A fit of the grid names what it leaves out (folds of levels), its penalty and the
features it uses; a pass over the rows feeds every fit: a task adds up each fit's loss, gradient and curvature over its own rows, so folds, penalties,
candidates and seeds cost no copies of rows. Sums per fit are combined by Spark; the driver steers coefficients only (MOST_NUMBERS bounds them), never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .draws import hashed
from .ranks import joined
from .resampling import weighted_auc

MOST_NUMBERS = 8_000_000  # sums of a pass, which a task and the driver hold


class Fit(NamedTuple):
    """out: (level, fold) pairs whose rows are no training rows; only: the pair whose rows alone are (None: all others); test: the pair whose rows are scored (None: all rows).
    c: strength of the coefficients' prior, or a function of the number of training rows; use: the features' places (None: all)."""

    out: tuple[tuple[int, int], ...] = ()
    c: float | Callable[[int], float] = 1.0
    use: tuple[int, ...] | None = None
    test: tuple[int, int] | None = None
    only: tuple[int, int] | None = None


class Model(NamedTuple):
    """beta: the intercept, then a coefficient per feature (0 where unused) of features less their mean over their spread."""

    beta: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    n: int
    rate: float
    converged: bool
    c: float


class Grid:
    """Rows for many fits. Rows without a label are scored but train nothing; null or NaN features count as the training mean."""

    def __init__(self, df: DataFrame, key: str, label: str, features: list[str] | str, folds: list[str] | None = None):
        """features: columns, or one column of arrays of equal length; folds: whole-number columns, one per level, where null belongs to no fold."""
        x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])
        levels = F.array(*[F.coalesce(F.col(f).cast("long"), F.lit(-1)) for f in folds or []]).cast("array<long>")
        self.rows = checkpointed(df.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"), x.alias("x"), levels.alias("folds")).where("x is not null"))
        sizes = self.rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
        if sizes[0] != sizes[1]:
            raise ValueError("rows have arrays of unequal length")
        self.width, self.levels = sizes[0] or 0, len(folds or [])

    def _summed(self, fits: list[Fit], size: int, make: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """fits x size: the sums of make(fit's number, x, y) over each fit's training rows."""
        if len(fits) * size > MOST_NUMBERS:
            raise ValueError(f"{len(fits)} fits of {size} sums are more than {MOST_NUMBERS} numbers: take fewer fits at once")
        outs, width = [(f.out, f.only) for f in fits], self.width

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(outs), size))
            for b in batches:
                y, x, folds = _unpacked(b, width)
                known = ~np.isnan(y)
                for k, (out, only) in enumerate(outs):
                    rows = known & ~_held(folds, out)
                    if only:
                        rows &= _held(folds, (only,))
                    if rows.any():
                        total[k] += make(k, x[rows], y[rows])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "v"])

        got = self.rows.select("y", "x", "folds").mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(len(fits) * size)
        flat[np.asarray(got["at"])] = np.asarray(got["v"])
        return flat.reshape(len(fits), size)

    def _moments(self, fits: list[Fit]) -> list[tuple[np.ndarray, np.ndarray, int, float]]:
        """Training mean and spread of each feature (null counts as the mean), rows and share of class 1, per distinct training set."""
        sets = list(dict.fromkeys((f.out, f.only) for f in fits))
        p = self.width
        at = self._summed([Fit()], 2 * p, lambda k, x, y: np.concatenate([(~np.isnan(x)).sum(axis=0), np.nansum(x, axis=0)]))[0]
        shift = at[p:] / np.maximum(at[:p], 1)

        def make(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            d = x - shift
            return np.concatenate([[len(y), y.sum()], (~np.isnan(d)).sum(axis=0), np.nansum(d, axis=0), np.nansum(d * d, axis=0)])

        of = {}
        for out, s in zip(sets, self._summed([Fit(o, only=i) for o, i in sets], 2 + 3 * p, make), strict=True):
            n, k, m, q = int(s[0]), s[2 : 2 + p], s[2 + p : 2 + 2 * p], s[2 + 2 * p :]
            mean = m / np.maximum(k, 1)
            spread = np.sqrt(np.maximum(q - k * mean**2, 0) / max(n, 1))
            of[out] = (mean + shift, np.where(spread > 1e-12 * (1 + np.abs(shift)), spread, 1.0), n, s[1] / n if n else 0.5)
        return [of[f.out, f.only] for f in fits]

    def fitted(self, fits: list[Fit], steps: int = 60, tolerance: float = 1e-8, strict: bool = True, start: list[np.ndarray] | None = None) -> list[Model]:
        """Newton's method on all fits at once, a pass a step; a step that makes the loss larger is halved. A fit of one class has coefficients 0 and counts as converged.

        Raises where a fit has not converged, unless strict is False (Model.converged tells)."""
        p = self.width
        moments = self._moments(fits)
        c = [f.c(m[2]) if callable(f.c) else f.c for f, m in zip(fits, moments, strict=True)]
        used = [np.concatenate([[0], 1 + np.arange(p) if f.use is None else 1 + np.array(f.use, int)]) for f in fits]
        shrink = [np.concatenate([[0.0], np.full(len(u) - 1, 1 / ck)]) for u, ck in zip(used, c, strict=True)]
        beta = [np.zeros(len(u)) if start is None else start[k][u] for k, u in enumerate(used)]
        move = [np.zeros(len(u)) for u in used]
        loss, done = [np.inf] * len(fits), [not 0 < m[3] < 1 for m in moments]
        size = 1 + max((len(u) for u in used), default=0) + max((len(u) ** 2 for u in used), default=0)
        for _ in range(steps):
            going = [k for k, d in enumerate(done) if not d]
            if not going:
                break
            now = [(beta[k], used[k], moments[k][0], moments[k][1]) for k in going]

            def make(k: int, x: np.ndarray, y: np.ndarray, now=now, size=size) -> np.ndarray:
                b, u, mean, spread = now[k]
                z = _scaled(x, mean, spread, u)
                line = z @ b
                e = 1 / (1 + np.exp(-np.clip(line, -500, 500)))
                g, h = z.T @ (y - e), (z * (e * (1 - e))[:, None]).T @ z
                out = np.zeros(size)
                out[0], out[1 : 1 + len(b)], out[1 + len(b) : 1 + len(b) + len(b) ** 2] = (np.logaddexp(0, line) - y * line).sum(), g, h.ravel()
                return out

            for k, s in zip(going, self._summed([fits[k] for k in going], size, make), strict=True):
                b, q = beta[k], len(beta[k])
                value = s[0] + 0.5 * (shrink[k] * b * b).sum()
                if value > loss[k] + 1e-9 * (1 + abs(loss[k])):
                    move[k] = move[k] / 2
                    beta[k] = b - move[k]
                    continue
                loss[k] = value
                h = s[1 + q : 1 + q + q * q].reshape(q, q) + np.diag(shrink[k] + 1e-12)
                move[k] = np.linalg.lstsq(h, s[1 : 1 + q] - shrink[k] * b, rcond=None)[0]
                if np.abs(move[k]).max() < tolerance:
                    done[k] = True
                beta[k] = b + move[k]
        if strict and not all(done):
            raise ValueError(f"{done.count(False)} of {len(fits)} fits have not converged in {steps} steps")
        models = []
        for b, u, m, d, ck in zip(beta, used, moments, done, c, strict=True):
            whole = np.zeros(p + 1)
            whole[u] = b
            if not 0 < m[3] < 1:
                whole[:] = 0
            models.append(Model(whole, m[0], m[1], m[2], m[3], d, ck))
        return models

    def scores(self, fits: list[Fit], models: list[Model], line: bool = False) -> DataFrame:
        """fit (its number), key, y, score of the rows that each fit is tested on; a fit of one class scores its rate. line: the linear value instead of the probability."""
        tests, width = [f.test for f in fits], self.width
        kind = self.rows.schema["key"].dataType.simpleString()

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y, x, folds = _unpacked(b, width)
                keys = b.column(b.schema.names.index("key"))
                for k, (test, m) in enumerate(zip(tests, models, strict=True)):
                    rows = np.flatnonzero(_held(folds, (test,)) if test else np.ones(len(y), bool))
                    if not len(rows):
                        continue
                    z = _scaled(x[rows], m.mean, m.spread, np.arange(width + 1))
                    s = z @ m.beta
                    if not line:
                        s = 1 / (1 + np.exp(-np.clip(s, -500, 500))) if 0 < m.rate < 1 else np.full(len(rows), m.rate)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), keys.take(pa.array(rows)), pa.array(y[rows], mask=np.isnan(y[rows])), pa.array(s)], names=["fit", "key", "y", "score"])

        return self.rows.mapInArrow(go, f"fit int, key {kind}, y double, score double")


def _unpacked(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = b.num_rows
    y = b.column(b.schema.names.index("y")).to_numpy(zero_copy_only=False).astype(float)
    x = b.column(b.schema.names.index("x")).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
    return y, x, b.column(b.schema.names.index("folds")).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _held(folds: np.ndarray, out: tuple[tuple[int, int], ...]) -> np.ndarray:
    held = np.zeros(len(folds), bool)
    for level, fold in out:
        held |= folds[:, level] == fold
    return held


def _scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, used: np.ndarray) -> np.ndarray:
    z = np.ones((len(x), len(used)))
    f = used[1:] - 1
    z[:, 1:] = np.nan_to_num((x[:, f] - mean[f]) / spread[f], nan=0.0)
    return z


def areas(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, auc of scored rows."""
    return weighted_auc(scores.where("y is not null").withColumn("_one", F.lit(1)), "score", "y", "_one", by or ["fit"])


def search_c(grid: Grid, folds: list[int], cs: list[float], level: int = 0, steps: int = 60) -> tuple[DataFrame, Model]:
    """The penalty whose mean area over held-out folds is best (ties: the strongest shrinking), and the model of all rows with it.

    Every fold and c is a fit of one grid; the last model starts from the chosen fits' mean. Frame: c, auc, converged, chosen; a fold of one class has no area and does not count.
    """
    cs = sorted(cs)
    fits = [Fit(((level, f),), c, None, (level, f)) for f in folds for c in cs]
    models = grid.fitted(fits, steps, strict=False)
    auc = {r["fit"]: r["auc"] for r in areas(grid.scores(fits, models)).collect()}  # a row per fit
    table = []
    for k, c in enumerate(cs):
        own = range(k, len(fits), len(cs))
        known = [auc[i] for i in own if auc.get(i) is not None]
        table.append((float(c), float(np.mean(known)) if known else None, all(models[i].converged for i in own)))
    fine = [(-a, c) for c, a, ok in table if a is not None and ok]
    if not fine:
        raise ValueError("no penalty has both converged fits and an area")
    best = min(fine)[1]
    first = np.mean([models[i].beta for i in range(cs.index(best), len(fits), len(cs))], axis=0)
    final = grid.fitted([Fit((), best)], steps, start=[first])[0]
    return grid.rows.sparkSession.createDataFrame([(*t, t[0] == best) for t in table], "c double, auc double, converged boolean, chosen boolean"), final


def subset_of(names: list[str], size: int, *seed: int) -> tuple[int, ...]:
    """Places of the `size` names whose hashes under the seeds are least."""
    import hashlib

    order = sorted(range(len(names)), key=lambda i: (hashlib.md5("|".join([*map(str, seed), names[i]]).encode()).hexdigest(), i))
    return tuple(sorted(order[: max(1, size)]))


def with_seed_levels(df: DataFrame, key: str, seeds: list[int], parts: int = 5) -> tuple[DataFrame, list[str]]:
    """Adds a fold column per seed; its fold 0 is what that seed's fits leave out besides their test rows."""
    names = [f"_seed{s}" for s in seeds]
    return df.withColumns({n: hashed(key, seed=s) % parts for n, s in zip(names, seeds, strict=True)}), names


def seed_ensemble(df: DataFrame, key: str, label: str, features: list[str], fold: str, folds: list[int], seeds: list[int], per_model: float, c: float, tuned_rows: int) -> DataFrame:
    """key, y, score: out-of-fold scores averaged over seeds. Each seed leaves out a fifth of the training rows and takes a part of the features of its own.

    Settings follow the size of what is fitted: `per_model` is how many features a model takes, so min(1, per_model / all) of them; c is meant for tuned_rows and grows with the
    training rows, so that the prior weighs alike against the data.
    """
    leveled, names = with_seed_levels(df, key, seeds)
    grid = Grid(leveled, key, label, features, [fold, *names])
    take = round(min(1.0, per_model / max(len(features), 1)) * len(features))
    fits = [Fit(((0, f), (1 + k, 0)), lambda n: c * n / tuned_rows, subset_of(features, take, s), (0, f)) for f in folds for k, s in enumerate(seeds)]
    return grid.scores(fits, grid.fitted(fits)).groupBy("key", "y").agg(F.avg("score").alias("score")).withColumnRenamed("key", key)


def eliminated(grid: Grid, names: list[str], folds: list[int], keep: int, c: float = 1.0, level: int = 0, done: list[str] | None = None) -> list[tuple[str, float]]:
    """Backward elimination over out-of-fold areas: (dropped, pooled area without it), ties to the first. A step fits every candidate and fold in the same passes. `done` resumes."""
    left = [n for n in names if n not in (done or [])]
    out: list[tuple[str, float]] = []
    while len(left) > keep:
        use = [tuple(names.index(g) for g in left if g != f) for f in left]
        fits = [Fit(((level, f),), c, u, (level, f)) for u in use for f in folds]
        scored = grid.scores(fits, grid.fitted(fits)).withColumn("candidate", F.floor(F.col("fit") / len(folds)))
        best = areas(scored, ["candidate"]).orderBy(F.desc("auc"), "candidate").first()
        out.append((left.pop(best["candidate"]), float(best["auc"])))
    return out


def fold_column(key: str, parts: int, seed: int = 0) -> Column:
    return (hashed(key, seed=seed) % parts).cast("int")


def covariate_models(df: DataFrame, by: list[str], label: str, score: str, covariates: list[str], c: float = 1.0) -> DataFrame:
    """by, model, coefficient of the standardised score (null in the covariates' own model), auc of the fitted values, for score, covariates and both. Incomplete rows are left out; one class alone gives no rows.

    All groups and all three models are fits of one grid, fed by the same passes; groups are as many as fits can be steered at once.
    """
    names = [score, *covariates]
    rows = df.select(*by, label, *names).dropna(subset=[label, *names])
    groups = checkpointed(rows.select(*by).distinct().withColumn("_g", F.monotonically_increasing_id()))
    number = {r["_g"]: k for k, r in enumerate(groups.select("_g").orderBy("_g").limit(MOST_NUMBERS // 64).collect())}
    dense = df.sparkSession.createDataFrame(list(number.items()), "_g long, _level long") if number else None
    if dense is None:
        return df.sparkSession.createDataFrame([], df.select(*by).schema).withColumns({"model": F.lit(""), "coefficient": F.lit(0.0), "auc": F.lit(0.0)})
    groups = groups.join(F.broadcast(dense), "_g").drop("_g")  # a row per group
    grid = Grid(joined(rows, groups, by).withColumn("_key", F.lit(0)), "_key", label, names, ["_level"])
    models = {"score": (0,), "covariates": tuple(range(1, len(names))), "both": tuple(range(len(names)))}
    fits = [Fit((), c, use, (0, g), (0, g)) for g in range(len(number)) for use in models.values()]
    made = grid.fitted(fits)
    auc = areas(grid.scores(fits, made, line=True).withColumn("score", F.round("score", 12)))
    kinds = list(models)
    table = [(k, k // 3, kinds[k % 3], float(m.beta[1]) if 0 in fits[k].use else None) for k, m in enumerate(made) if 0 < m.rate < 1]
    out = df.sparkSession.createDataFrame(table, "fit int, _level long, model string, coefficient double").join(auc, "fit").join(groups, "_level")
    return out.select(*by, "model", "coefficient", "auc")
