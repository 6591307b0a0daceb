"""Nearest neighbours by a block matrix join over int8 codes; with error bounds the answer is exact.

Queries are dealt into groups whose bytes are bounded, candidates into groups for the work they make; each pair of groups is one tile of a grid. A task
holds a group of queries and their k best so far, and candidates stream past in batches. Vectors become int8 codes (one scale a row); products of codes
are whole numbers, and the norms of what rounding took off bound how far a product can lie from the true one (Cauchy and Schwarz). A pair whose upper bound is
below the query's kth lower bound, or below its kth score so far, is dropped; the rest are scored on the original vectors, summed in
order of components, so that equal vectors score equally. Equal vectors of a batch are one column of the product, with their k + 1 smallest ids, each
k times at most: no more of them can be among k answers. Each tile gives at most k answers a query id; these sorted lists are merged by a heap.

Rules: vectors that are null, all zero or empty, or hold a null, NaN or infinite component, take no part, nor do rows with a null id; candidates are the vectors
of the query's own length; a row never answers for its own id, so rows repeating the query's id don't either; rows that repeat another id answer once each; equal query
rows are one query, and unequal ones of one id ask together: their answers are ranked in one list; ties go to the smaller id; a sum that overflows
both ways ranks last; other columns are left; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked, table, tune

QUERY_BYTES = 16 << 20  # of the vectors that a task holds
GROUP_BYTES = 1 << 20  # of candidates for which another task pays
TASK_WORK = 2e12  # products of components in a tile
QUERY_ROWS, EXACT = 512, 1024  # queries of one product; components whose int8 products a float32 adds without rounding
PAIRS = 1 << 16
FOUND = "query_id long, vec_id array<long>, score array<double>"
RESULT = "query_id long, rank int, vec_id long, score double"


class Codes:
    """int8 codes of vectors, as the float32 that a matrix product takes, and what bounds their error."""

    def __init__(self, v: np.ndarray):
        most = np.abs(v).max(axis=1)
        plain = (most > 1e100) | (most < 1e-100)  # squares would leave the range of doubles: no bound, always scored
        self.scale = np.where(plain, 1.0, most / 127)
        codes = np.where(plain[:, None], 0.0, np.rint(v / self.scale[:, None])).astype(np.int8)
        near = codes * self.scale[:, None]
        self.codes = codes.astype(np.float32)
        with np.errstate(over="ignore"):
            self.norm, self.near = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (v, near))
            off = np.where(plain[:, None], 0.0, v - near)
        self.off = np.where(plain, np.inf, np.sqrt(np.einsum("ij,ij->i", off, off)))


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of codes, exact: float32 holds the sum of EXACT products."""
    out = (a[:, :EXACT] @ b[:, :EXACT].T).astype(np.float64)
    for k in range(EXACT, a.shape[1], EXACT):
        out += a[:, k : k + EXACT] @ b[:, k : k + EXACT].T
    return out


class Asked:
    """Queries of one length with their best answers so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.code = Codes(vectors)
        self.by_component = np.ascontiguousarray(vectors.T)
        self.sorted = np.argsort(ids, kind="stable")
        self.best = np.full((len(ids), k), -np.inf)
        self.best_id = np.zeros((len(ids), k), np.int64)
        self.held = np.zeros(len(ids), np.int64)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A batch of candidates."""
        raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, of = np.unique(raw, return_index=True, return_inverse=True)
        order = np.lexsort((ids, of))
        starts = np.searchsorted(of[order], np.arange(len(first)))
        ids, of, v = ids[order], of[order], vectors[first]
        place = np.arange(len(ids))
        new = np.append(True, (ids[1:] != ids[:-1]) | (of[1:] != of[:-1]))
        which = np.cumsum(new) - 1  # distinct (vector, id) up to here
        few = (which - which[starts[of]] <= self.k) & (place - place[new][which] < self.k)
        ids, of = ids[few], of[few]
        starts = np.append(np.searchsorted(of, np.arange(len(first))), len(of))
        # columns that hold a query's own id
        low, high = (np.searchsorted(self.ids[self.sorted], ids, side=s) for s in ("left", "right"))
        own_at = np.repeat(np.arange(len(ids)), high - low)
        own_q = self.sorted[np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True) if b > a] or [np.zeros(0, np.int64)])]
        own_column = of[own_at]
        code, by_component = Codes(v), np.ascontiguousarray(v.T)
        for a in range(0, len(self.ids), QUERY_ROWS):
            z = min(len(self.ids), a + QUERY_ROWS)
            mine = (own_q >= a) & (own_q < z)
            q, column = self._near(a, z, code, own_q[mine] - a, own_column[mine])
            if len(q):
                self._take(q + a, column, by_component, ids, starts)

    def _near(self, a: int, z: int, code: Codes, own_q: np.ndarray, own_column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, column) that the bounds leave."""
        mine, k = self.code, self.k
        with np.errstate(invalid="ignore", over="ignore"):
            about = code_products(mine.codes[a:z], code.codes) * mine.scale[a:z, None] * code.scale
            off = (mine.off[a:z, None] * code.near + mine.norm[a:z, None] * code.off) * (1 + 1e-9) + 1e-12 * mine.norm[a:z, None] * code.norm
            least = self.best[a:z, -1].copy()
            open_ = np.flatnonzero(self.held[a:z] < k)
            if len(open_) and about.shape[1] > k:
                low = (about - off)[open_]
                low[np.isnan(low)] = -np.inf
                at = np.full(z - a, -1)
                at[open_] = np.arange(len(open_))
                has = at[own_q] >= 0
                low[at[own_q[has]], own_column[has]] = -np.inf
                kth = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
                least[open_] = np.maximum(least[open_], kth)
            return np.nonzero(~(about + off < least[:, None]))

    def _take(self, q: np.ndarray, column: np.ndarray, by_component: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        """Scores the pairs in full and keeps each query's k best."""
        score = np.zeros(len(q))
        with np.errstate(invalid="ignore", over="ignore"):
            for a in range(0, len(q), PAIRS):
                x, y, s = q[a : a + PAIRS], column[a : a + PAIRS], score[a : a + PAIRS]
                for left, right in zip(self.by_component, by_component, strict=True):
                    s += left[x] * right[y]
        score[np.isnan(score)] = -np.inf
        keep = (score >= self.best[q, -1]) | (self.held[q] < self.k)
        q, column, score = q[keep], column[keep], score[keep]
        many = starts[column + 1] - starts[column]
        at = np.repeat(starts[column] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        q, who, score = np.repeat(q, many), ids[at], np.repeat(score, many)
        other = who != self.ids[q]
        touched = np.unique(q[other])
        there = np.arange(self.k) < self.held[touched, None]
        q, who, score = (np.concatenate(x) for x in ((q[other], np.repeat(touched, self.held[touched])), (who[other], self.best_id[touched][there]), (score[other], self.best[touched][there])))
        q, who, score, place = ranked(q, who, score, self.k)
        self.best[touched], self.held[touched] = -np.inf, 0
        self.best[q, place], self.best_id[q, place] = score, who
        np.add.at(self.held, q, 1)

    def lists(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """query id, ids and scores, best first; queries of one id give one list."""
        there = np.arange(self.k) < self.held[:, None]
        q, who, score, place = ranked(np.repeat(self.ids, self.held), self.best_id[there], self.best[there], self.k)
        starts = [*np.flatnonzero(place == 0).tolist(), len(q)]
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            yield int(q[a]), who[a:z], score[a:z]


def ranked(q: np.ndarray, who: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each q, by falling score and rising id, and their places from 0."""
    order = np.lexsort((who, -score, q))
    q, who, score = q[order], who[order], score[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = place < k
    return q[keep], who[keep], score[keep], place[keep]


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products; is_query is a condition on the column vec_id."""
    spark = rows.sparkSession
    tune(spark)
    src = picked(rows, vec_id=id_col, v=vector_col).where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    if src.schema["v"].dataType.elementType.typeName() != "float":
        src = src.withColumn("v", F.col("v").cast("array<double>"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    src = src.where(fine)
    queries = src.where(is_query).dropDuplicates(["vec_id", "v"])
    wide = 8 * F.sum(F.size("v")).cast("double")
    n, size = src.agg(F.count("*"), wide).first()
    asked = queries.agg(wide).first()[0] or 0.0
    size, partitions = size or 0.0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, int(-(-asked // query_bytes)))
    tasks = max(2 * partitions, int(asked / 8 * (n or 0) / TASK_WORK))
    down = max(1, min(-(-tasks // across), int(-(-size // group_bytes))))
    many = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(m)).cast("int")
    left = queries.select(dealt(across, 1).alias("g"), many(down).alias("h"), F.lit(0).alias("passes"), "vec_id", "v")
    right = src.select(many(across).alias("g"), F.pmod(F.monotonically_increasing_id(), F.lit(down)).cast("int").alias("h"), F.lit(1).alias("passes"), "vec_id", "v")
    tiles = left.union(right).select((F.col("g").cast("long") * down + F.col("h")).alias("tile"), F.size("v").alias("size"), "passes", F.xxhash64("v").alias("same"), "vec_id", "v")
    tiles = tiles.repartition(min(across * down, 4 * tasks), "tile").sortWithinPartitions("tile", "size", "passes", "same").drop("same")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, held = None, [], [], None
        for b in batches:
            tile, size, passes, who = (np.asarray(b.column(c)) for c in range(4))
            flat = np.asarray(b.column(4).flatten()).astype(np.float64)
            ends = np.append(0, np.cumsum(size.astype(np.int64)))
            cut = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (size[1:] != size[:-1]) | (passes[1:] != passes[:-1])))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(tile)], strict=True):
                if (tile[a], size[a]) != now:
                    if held:
                        yield _batch(held)
                    now, ids, vectors, held = (tile[a], size[a]), [], [], None
                v = flat[ends[a] : ends[z]].reshape(z - a, size[a])
                if not passes[a]:
                    ids.append(who[a:z])
                    vectors.append(v)
                elif ids:
                    held = held or Asked(np.concatenate(ids), np.concatenate(vectors), k)
                    held.meet(who[a:z], v)
        if held:
            yield _batch(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted lists of one query follow one another; a heap takes k of them."""
        rows = ((q, zip((-s).tolist(), w.tolist(), strict=True)) for b in batches for q, w, s in zip(b.column(0).to_pylist(), _arrays(b.column(1)), _arrays(b.column(2)), strict=True))
        out: list[tuple] = []
        for q, of in groupby(rows, key=lambda r: r[0]):
            best: list = []
            for _, one in of:
                best = list(islice(heapq.merge(best, one), k))
            out += [(q, r, w, -s) for r, (s, w) in enumerate(best, 1)]
            if len(out) > 20_000:
                yield _answers(out)
                out = []
        if out:
            yield _answers(out)

    found = tiles.mapInArrow(search, FOUND)
    return found.repartition(partitions, "query_id").sortWithinPartitions("query_id").mapInArrow(merge, RESULT)


def _arrays(c: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in c]


def _batch(held: Asked) -> pa.RecordBatch:
    rows = list(held.lists())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["query_id", "vec_id", "score"])


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def op12_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
