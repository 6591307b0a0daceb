"""A Merkle manifest of a dataset in an external-memory node store, with a proof for every row.

Rows become leaves, digests alone from there on. Leaves are sorted into runs by (tree, id) and written; the runs' counts give every leaf its
coordinate. The store is a Parquet folder partitioned by level. A task takes an aligned block of 2^BAND nodes in order of coordinate and
streams BAND levels above them, each from the one below; the topmost level of a band is read back as the next band's lowest, so
2^(4 BAND) leaves take four passes and no task holds more than a block. Roots of the trees, in order of their names, are the leaves of
one more tree, built by the same code.

Proofs go from the top down. A node's path (its siblings up to the root) is kept for the tops of blocks only; a band's scan merges blocks of the store with
the paths of their tops by coordinate and hands paths to the band below; the lowest one folds each leaf up to the root. Paths of leaves are
never stored or moved.

Rules: a null field is `-`, any other its UTF-8 byte count, `:` and its text; null trees come before all others, then bytewise; null ids come
first in a tree; rows of equal id go by their leaf, equal rows in any order (a random key spreads them over tasks), so that the set of results
is the same; a null id is never tampered with, a null count stays null; a tree of one leaf has that leaf as its root; other
columns are left and cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_text, picked, shared_dir, table, tune, written

BAND = 10
POSITION = (1 << 33) - 1  # what monotonically_increasing_id counts within a partition
FIELDS = {"doc_id": "doc_id", "source": "source", "lang": "lang", "n_chars": "n_chars", "text": "text"}
ALONE, RIGHT, LEFT = 0, 1, 2  # where a node's sibling stands


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def parent(*nodes: bytes) -> bytes:
    """The digest of digests, as hex text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def depth_of(n: int) -> int:
    return (n - 1).bit_length()


def coordinates(leaves: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """tree, at, n and keep: each leaf's place in its tree, ordered by keys, and the tree's size. Sorted runs are written; only their counts are summed."""
    n = max(1, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["tree", *[F.col(k).asc_nulls_first() for k in keys]]
    sorted_runs = leaves.repartitionByRange(n, *order).sortWithinPartitions(*order)
    runs = written(sorted_runs.select(F.spark_partition_id().alias("run"), F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION)).alias("pos"), "tree", *keep), "merkle-runs")
    counts = runs.groupBy("run", "tree").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    every = Window.partitionBy("tree")  # a row per run
    before = F.coalesce(F.sum("c").over(every.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("run", "tree", (before - F.col("first")).alias("shift"), F.sum("c").over(every).alias("n"))
    return runs.join(counts, ["run", "tree"]).select("tree", (F.col("pos") + F.col("shift")).alias("at"), "n", *keep)


class Store:
    """Levels of all trees, in Parquet by level; level 0 is the leaves' table itself, with its other columns."""

    def __init__(self, leaves: DataFrame, width: int = BAND):
        """leaves: tree, at, n, node and others; width: levels of a band."""
        self.width = width
        self.spark = leaves.sparkSession
        self.leaves = written(leaves, "merkle-leaves")
        self.most = self.leaves.agg(F.max("n")).first()[0] or 0
        self.bands = max(1, -(-depth_of(self.most) // width)) if self.most else 0
        self.path = f"{shared_dir(self.spark)}/merkle-levels-{uuid.uuid4().hex}"
        for band in range(self.bands if self.most > 1 else 0):
            self._build(band)

    def level(self, first: int, last: int) -> DataFrame:
        """tree, level, at, n, node of levels first to last, other than 0."""
        return self.spark.read.schema("tree string, at long, n long, node binary, level int").parquet(self.path).where(F.col("level").between(first, last))

    def _build(self, band: int) -> None:
        width, low = self.width, band * self.width

        def levels(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("at")
            tree, n, at, nodes, out = p["tree"].iloc[0], int(p["n"].iloc[0]), int(p["at"].iloc[0]), p["node"].tolist(), []
            for level in range(low + 1, min(low + width, depth_of(n)) + 1):
                at, nodes = at >> 1, [parent(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
                out.append(pd.DataFrame({"level": level, "tree": tree, "at": range(at, at + len(nodes)), "n": n, "node": nodes}))
            return pd.concat(out) if out else pd.DataFrame(columns=["level", "tree", "at", "n", "node"])

        base = self.leaves.where("n > 1").select("tree", "at", "n", "node") if band == 0 else self.level(low, low).where(F.col("n") > 1 << low).select("tree", "at", "n", "node")
        made = base.groupBy("tree", F.shiftright("at", width).alias("block")).applyInPandas(levels, "level int, tree string, at long, n long, node binary")
        made.write.partitionBy("level").mode("append").option("compression", "none").parquet(self.path)

    def roots(self) -> DataFrame:
        """tree, node, band: each tree's root and the band that it tops."""
        alone = self.leaves.where("n = 1").select("tree", "node", F.lit(0).alias("band"))
        if self.most <= 1:
            return alone
        # the depth of n nodes is the number of binary digits of n - 1
        top = F.length(F.bin(F.col("n") - 1)).cast("int")
        high = self.level(1, depth_of(self.most)).where((F.col("at") == 0) & (F.col("level") == top))
        return alone.union(high.select("tree", "node", F.floor((F.col("level") - 1) / self.width).cast("int").alias("band")))

    def fold(self, tops: DataFrame, last: Callable[[pd.DataFrame, list[list[tuple[int, bytes]]], pd.Series], pd.DataFrame], schema: str) -> DataFrame:
        """tops: tree, band, path, ends: the path of each tree's root. last makes the result of a block's leaves, their paths and the block's top row."""
        passed, width = None, self.width
        for band in reversed(range(self.bands)):
            low = band * width
            above = tops.where(F.col("band") == band).select("tree", F.lit(0).cast("long").alias("block"), "path", "ends")
            above = above if passed is None else above.union(passed)
            extra = [c for c in self.leaves.columns if c not in ("tree", "at", "n", "node")] if band == 0 else []
            base = self.leaves.select("tree", F.lit(0).alias("level"), "at", "n", "node", *extra) if band == 0 else self.level(low, low).where(F.col("n") > 1 << low).select("tree", "level", "at", "n", "node")
            if self.most > 1:
                upper = self.level(low + 1, low + width - 1).select("tree", "level", "at", "n", "node")
                base = base.unionByName(upper, allowMissingColumns=True)
            base = base.withColumn("block", F.expr(f"shiftright(at, {low + width} - level)"))

            got = base.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(_scan(low, width, last if band == 0 else _handed_down), schema if band == 0 else "tree string, block long, path binary, ends binary")
            if band == 0:
                return got
            passed = written(got, "merkle-paths")
        raise ValueError("an empty store has no paths")


def _handed_down(own: pd.DataFrame, paths: list[list[tuple[int, bytes]]], row: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"tree": own["tree"].to_numpy(), "block": own["at"].to_numpy(), "path": [_packed(x) + row["path"] for x in paths], "ends": row["ends"]})


def _scan(low: int, width: int, last: Callable) -> Callable:
    return lambda p, top: last(*_paths(p, low, width), top.iloc[0])


def _paths(p: pd.DataFrame, low: int, width: int) -> tuple[pd.DataFrame, list[list[tuple[int, bytes]]]]:
    """A block's lowest nodes in order, and for each its siblings within the block's band: nodes and coordinates are both sorted, so every level is one scan."""
    p = p.sort_values(["level", "at"])
    own = p[p["level"] == low]
    n, start = int(own["n"].iloc[0]), own["at"].to_numpy()
    paths: list[list[tuple[int, bytes]]] = [[] for _ in start]
    at, group = start, p.groupby("level")["node"].apply(list).to_dict()
    for level in range(low, min(low + width, depth_of(n))):
        nodes = group[level]
        base = int(at[0])
        for k, a in enumerate(at.tolist()):
            other = (a ^ 1) - base
            paths[k].append((LEFT if a & 1 else RIGHT, nodes[other]) if other < len(nodes) else (ALONE, b""))
        at = at >> 1
    return own, paths


def _packed(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + node for side, node in path)


def _unpacked(path: bytes) -> list[tuple[int, bytes]]:
    out, k = [], 0
    while k < len(path):
        size = 32 if path[k] else 0
        out.append((path[k], path[k + 1 : k + 1 + size]))
        k += 1 + size
    return out


def folded(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its path give."""
    for side, other in path:
        node = parent(node) if side == ALONE else parent(node, other) if side == RIGHT else parent(other, node)
    return node


def manifest(docs: DataFrame, tampered: Column | None = None, fields: dict[str, str] | None = None, tree_col: str = "lang", id_col: str = "doc_id", count_col: str = "n_chars", band: int = BAND) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row; `tampered`, a condition on the fields, adds 1 to their count before a row is checked."""
    spark = docs.sparkSession
    tune(spark)
    fields = fields or FIELDS
    src = picked(docs, **fields)
    changed = F.coalesce(tampered if tampered is not None else F.lit(False), F.lit(False))
    other = digest(*[field(F.col(c) + 1 if c == count_col else F.col(c)) for c in fields])
    tree = F.coalesce(F.concat(F.lit("s"), F.col(tree_col).cast("string")), F.lit("n"))  # names a null tree, and keeps the order
    leaves = src.select(tree.alias("tree"), F.col(id_col).cast("long").alias("doc_id"), digest(*[field(F.col(c)) for c in fields]).alias("node"), F.when(changed, other).alias("shown"), F.rand(7).alias("spread"))
    leaves = written(leaves, "merkle-digests")
    low = Store(coordinates(leaves, ["doc_id", "node", "spread"], ["doc_id", "node", "shown"]).withColumn("doc_id", F.col("doc_id").cast("string")), band)  # pandas has no long with nulls
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not low.bands:
        return spark.createDataFrame([], schema).withColumn("doc_id", F.col("doc_id").cast("long"))
    roots = written(low.roots(), "merkle-roots")
    names = roots.select(F.lit("root").alias("tree"), F.col("tree").alias("name"), "node", "band")
    high = Store(coordinates(names, ["name"], ["name", "node", "band"]), band)
    whole = high.roots().select("tree", "band", F.lit(b"").alias("path"), F.col("node").alias("ends"))

    def tops(own: pd.DataFrame, paths: list, row: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tree": own["name"], "band": own["band"].astype("int32"), "path": [_packed(x) + row["path"] for x in paths], "ends": [n + row["ends"] for n in own["node"]]})

    def proofs(own: pd.DataFrame, paths: list, row: pd.Series) -> pd.DataFrame:
        above, subroot, root, out = _unpacked(row["path"]), row["ends"][:32].hex(), row["ends"][32:].hex(), []
        for node, shown, path in zip(own["node"], own["shown"], paths, strict=True):
            path = path + above
            got = folded(node if shown is None else shown, path).hex()
            out.append((node.hex(), subroot, root, parent(*[x for _, x in path]).hex(), got, got == root))
        made = pd.DataFrame(out, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        made.insert(0, "doc_id", own["doc_id"].reset_index(drop=True))
        return made

    under = written(high.fold(whole, tops, "tree string, band int, path binary, ends binary"), "merkle-tops")
    return low.fold(under, proofs, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), F.pmod(crc32_text(F.col("doc_id")), F.lit(7)) == 0)


CRC32 = """(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda b: ascii(b)::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT))"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field('text')}) AS leaf,
         CASE WHEN {CRC32.format('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('(n_chars + 1)')} || {_field('text')}) END AS shown
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
        UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subs AS (SELECT lang, level AS depth, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS sub_at, count(*) OVER () AS n_subs FROM low WHERE n = 1),
high AS (SELECT 0 AS level, sub_at AS pos, n_subs AS n, subroot AS node FROM subs
         UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (SELECT lang, 0 AS half, level, pos, n, node FROM low WHERE n > 1),
path AS (
  SELECT p.doc_id, p.lang, p.pos AS leaf_at, p.leaf, p.shown, s.subroot, s.sub_at, s.depth FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang),
sides AS (
  SELECT p.lang, p.leaf_at, k.level, (p.leaf_at >> k.level) % 2 AS odd, s.node
  FROM path p JOIN (SELECT DISTINCT lang, level FROM steps) k ON p.lang IS NOT DISTINCT FROM k.lang
  LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = k.level AND s.pos = xor(p.leaf_at >> k.level, 1)
  UNION ALL
  SELECT p.lang, p.leaf_at, p.depth + k.level, (p.sub_at >> k.level) % 2, s.node
  FROM path p CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) k LEFT JOIN high s ON s.level = k.level AND s.pos = xor(p.sub_at >> k.level, 1)),
proofs AS (SELECT lang, leaf_at, list(struct_pack(odd := odd, node := coalesce(node, '')) ORDER BY level) AS steps FROM sides GROUP BY lang, leaf_at),
whole AS (
  SELECT p.*, coalesce(q.steps, []) AS steps, (SELECT node FROM high WHERE n = 1) AS root
  FROM path p LEFT JOIN proofs q ON p.lang IS NOT DISTINCT FROM q.lang AND p.leaf_at = q.leaf_at),
folds AS (
  SELECT *, sha256(array_to_string(list_transform(steps, lambda x: x.node), '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(shown, leaf), list_transform(steps, lambda x: x.odd || x.node)),
                     lambda a, b: sha256(CASE WHEN b[1] = '1' THEN b[2:] || a ELSE a || b[2:] END)) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""
