"""Exact top-k inner products by the threshold algorithm.

Candidates are dealt into blocks; a task sorts a block's rows along every dimension once, and all queries then stream past it. A query walks
all its lists from their favourable ends, in rounds of doubling depth; candidates met for the first time are scored
in full, and the walk stops once the sum of the lists' current values cannot reach the kth score. A block keeps k rows a
query; the blocks' winners are ranked together per query. A candidate moves once; a query moves once per block of
BLOCK_ROWS candidates, or of BLOCK_BYTES where their vectors are long. A task holds one block and one batch of queries, whatever the input.

Rules: vectors that are null, or hold a null, NaN or infinite component, take no part; a query's candidates are the vectors of its own length
(an empty one's inner product is 0); scaled components and scores beyond a 64-bit integer are the nearest one, so ranks beyond it
go by id; rows with a null id take no part; a row never answers for its own id, so rows repeating the query's id don't either; rows
that repeat another id answer once each, ranked in no order between them; equal query rows are one query; ties go to the smaller id; other
columns are left; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, table, tune

BLOCK_ROWS, BLOCK_BYTES = 32768, 1 << 24  # of a block of candidates, whichever is less; its sorted lists take some five times the bytes
LONG = 2**63 - 1
RESULT = "query_id long, vec_id long, score long"


class Lists:
    """A block of candidates, sorted along every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.n, self.vectors = ids, len(ids), vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()  # dimensions x rows, ascending
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)
        self.largest = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))
        self.plain, self.wide = vectors.astype(np.float64), None

    def top(self, q: np.ndarray, query_id: int, k: int, first_depth: int = 16) -> list[tuple[int, int, int]]:
        """(query id, id, score) of the k best rows other than the query's own; ties to the smaller id."""
        exact = self.largest * max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * max(1, len(q)) < 2**52
        if not exact and self.wide is None:
            self.wide = self.vectors.astype(object)
        table, weight, kind = (self.plain, q.astype(np.float64), np.float64) if exact else (self.wide, q.astype(object), object)
        up, down, falling = np.flatnonzero(q > 0), np.flatnonzero(q < 0), self.order[:, ::-1]
        met = self.ids == query_id
        best_id, best = np.zeros(0, np.int64), np.zeros(0, kind)
        depth, done = min(first_depth, self.n), 0
        while True:
            fresh = np.zeros(self.n, bool)
            fresh[falling[up, done:depth]] = True
            fresh[self.order[down, done:depth]] = True
            if not len(up) and not len(down):
                fresh[:] = True  # every score is 0
            rows = np.flatnonzero(fresh & ~met)
            met[rows] = True
            found = table[rows] @ weight if len(q) else np.zeros(len(rows), kind)
            score = np.concatenate([best, found if exact else np.array([max(-LONG - 1, min(LONG, int(x))) for x in found], object)])
            who = np.concatenate([best_id, self.ids[rows]])
            if len(score) > 4 * k and exact:
                keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                score, who = score[keep], who[keep]
            keep = np.lexsort((who, -score))[:k]
            best, best_id = score[keep], who[keep]
            bound = self.values[up, self.n - depth].astype(kind) @ weight[up] + self.values[down, depth - 1].astype(kind) @ weight[down] if len(up) + len(down) else 0
            if depth == self.n or len(best) == k and best[-1] > bound:
                break
            done, depth = depth, min(2 * depth, self.n)
        return [(query_id, int(i), int(s)) for i, s in zip(best_id, best, strict=True)]


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score over floor(scale * x) of every component; is_query is a condition on the column vec_id."""
    tune(rows.sparkSession)
    src = picked(rows, vec_id=id_col, v=vector_col).where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = src.where(fine).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    n, components = src.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // block_rows), -(-8 * components // block_bytes))
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")  # rows that repeat are dealt apart
    cand = src.select(block, F.lit(0).alias("asks"), "vec_id", "v")
    asked = src.where(is_query).dropDuplicates(["vec_id", "v"]).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "v")
    n = min(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8)
    dealt = cand.union(asked).select("block", F.size("v").alias("size"), "asks", "vec_id", "v").repartition(n, "block").sortWithinPartitions("block", "size", "asks", "vec_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, lists = None, [], [], None
        for b in batches:
            block, size, asks, who = (np.asarray(b.column(c)) for c in range(4))
            flat, out = np.asarray(b.column(4).flatten()), []
            ends = np.append(0, np.cumsum(size.astype(np.int64)))
            cut = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (size[1:] != size[:-1]) | (asks[1:] != asks[:-1])))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(block)], strict=True):
                if (block[a], size[a]) != now:
                    now, ids, vectors, lists = (block[a], size[a]), [], [], None
                v = flat[ends[a] : ends[z]].reshape(z - a, size[a])
                if not asks[a]:
                    ids.append(who[a:z])
                    vectors.append(v)
                elif ids:
                    lists = lists or Lists(np.concatenate(ids), np.concatenate(vectors))
                    for q, w in zip(v, who[a:z].tolist(), strict=True):
                        out += lists.top(q, w, k)
            got = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, c]) for c in range(3)], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = dealt.mapInArrow(search, RESULT)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
