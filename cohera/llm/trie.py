"""The prefix trie of conversations by partition refinement.

Turns become digests (SHA-256 of role and text) where they are read, so texts are never moved. All conversations start in one class; every round splits the
classes still active by the digest of their next turn, and the counts per (class, digest), combined before the shuffle, are the trie's nodes of that
depth. A class is named by its smallest member, so (name, depth) names a node. A class of one member retires: its other turns are a unary chain, one
row each, made by a single join at the end. So does a class whose members agree in all their turns: its chain has them all as members, and many
copies of a long conversation cost no rounds. Rounds therefore end at the deepest place where conversations part. Then totals fold
back, a depth at a time; chains fold by a running sum.

Agreement of whole conversations is told by 180 bits (three sums of pieces of a SHA-256 of each turn and its place) and the number of turns.

No task takes a class: members meet their class's new name by a join that deals large classes over many tasks, and a conversation's turns are numbered by ranges
where one is long. A node's list of ending members is hashed as sorted stretches of text, which stream through one task in order, since a
SHA-256 has no parts.

Rules: rows with a null conversation id take no part; turns go by number, null first, equal ones by digest; null roles and texts are empty; the remainders keep the
sign of the id; a conversation left without turns belongs to the root alone; equal rows are turns of their own; other columns are left; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers, running
from .common import crc32_text, join_salted, picked, table, tune, written
from .merkle import CRC32

PIECES = [1, 16, 31]  # of 15 hexadecimal digits each
SHAPES = [f"shape{k}" for k in range(len(PIECES))]
HEADS, FAMILY = 6, 100


def numbered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, i (from 1), digest, chars: each conversation's turns in order."""
    src = picked(rows, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    src = written(src.select(F.col("conv").cast("long").alias("conv"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars")), "trie-turns")
    return row_numbers(src, "turn", ["conv"], ["digest"], "i").select("conv", F.col("i").cast("long").alias("i"), "digest", "chars")


def with_shared_heads(turns: DataFrame, heads: int = HEADS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, digest, chars) and conversations (conv, length) after each first h turns are those of the family's first conversation; h = crc32 of the id, modulo heads."""
    turns = written(turns, "trie-numbered")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = sizes.select("conv", "n", F.pmod(crc32_text(F.col("conv")), F.lit(heads)).alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    taken = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    convs = written(convs.select("conv", "base", "n", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    first = turns.where((F.col("i") < heads) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    lent = first.join(convs.where("taken > 0").select("conv", "base", "taken"), "base").where("i <= taken").select("conv", F.col("i").alias("pos"), "digest", "chars")
    own = join_salted(turns, convs.select("conv", "h", "taken", "n"), ["conv"], "n", ["i"], turns.count()).where("i > h")
    own = own.select("conv", (F.col("taken") + F.col("i") - F.col("h")).alias("pos"), "digest", "chars")
    return written(lent.union(own), "trie-rebuilt"), convs.select("conv", "length")


def _alike() -> Column:
    """Of a group of members: whether they agree in all their turns."""
    same = F.min("length") == F.max("length")
    for s in SHAPES:
        same = same & (F.min(s) == F.max(s))
    return same


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of turns (conv, pos from 1, digest, chars) of the conversations (conv, length)."""
    tune(turns.sparkSession)
    spot = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("digest")).cast("binary"), 256)
    shapes = turns.select("conv", spot.alias("s")).groupBy("conv").agg(*[F.sum(F.conv(F.substring("s", p, 15), 16, 10).cast("decimal(38,0)")).alias(c) for p, c in zip(PIECES, SHAPES, strict=True)])
    members = written(convs.join(shapes, "conv", "left").select("conv", "length", *[F.coalesce(c, F.lit(0)).cast("decimal(38,0)").alias(c) for c in SHAPES]), "trie-members")
    root = members.agg(F.min("conv").alias("node"), F.count("*").alias("n"), F.max("length").alias("longest"), _alike().alias("alike"))
    root = written(root.where("n > 0").select("node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("binary").alias("digest"), "n", F.lit(0).cast("long").alias("chars"), "longest", "alike"), "trie-nodes")
    top = root.first()
    levels, depth = [root], 0
    if top is None:
        return _result(root.select(F.col("node").alias("conv_id"), *[F.lit(0).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]), None)
    own = F.lit(top["node"]).cast("long").alias("node")
    ended = [members.where(F.lit(top["alike"]) | (F.col("length") == 0)).select(own, "length", "conv")]
    active = members.where(F.lit(not top["alike"]) & (F.col("length") > 0)).select("conv", "length", *SHAPES, own)
    live, total = not top["alike"], top["n"]
    while live:
        depth += 1
        met = active.withColumnRenamed("node", "parent").join(turns.where(F.col("pos") == depth).select("conv", "digest", "chars"), "conv")
        level = met.groupBy("parent", "digest").agg(F.min("conv").alias("node"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("length").alias("longest"), _alike().alias("alike"))
        level = written(level.select("node", "parent", "digest", "n", "chars", "longest", "alike"), "trie-nodes")
        levels.append(level)
        named = join_salted(met.drop("chars"), level.select("parent", "digest", "node", "alike", "n"), ["parent", "digest"], "n", ["conv"], total)
        named = written(named.select("conv", "length", *SHAPES, "node", "alike"), "trie-members")
        ended.append(named.where(F.col("alike") | (F.col("length") == depth)).select("node", "length", "conv"))
        active = named.where(~F.col("alike") & (F.col("length") > depth)).drop("alike")
        live, total = level.agg(F.coalesce(F.bool_or(~F.col("alike") & (F.col("longest") > depth)), F.lit(False)), F.sum("n")).first()
    chains = _chains(turns, levels)
    tails = chains.where("n > 1").groupBy("node").agg(F.sum("chars").alias("tail"))
    done, below = [chains.select("node", "depth", F.col("node").alias("parent"), "n", F.when(F.col("depth") < F.col("longest"), 1).otherwise(0).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), "saved")], None
    for depth in reversed(range(len(levels))):
        here = levels[depth].join(tails, "node", "left")
        if below is None:
            here = here.select("*", *[F.lit(None).cast("long").alias(c) for c in ("_children", "_leaves", "_saved")])
        else:
            here = here.join(below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_children"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved")), "node", "left")
        chain = F.when(F.col("alike") & (F.col("longest") > depth), 1).otherwise(0).cast("long")
        saved = (F.col("n") - 1) * (F.col("chars") + F.coalesce("tail", F.lit(0))) + F.coalesce("_saved", F.lit(0))
        below = here.select("node", F.lit(depth).cast("long").alias("depth"), "parent", "n", F.coalesce("_children", chain).alias("children"), F.coalesce("_leaves", F.lit(1)).cast("long").alias("leaves"), saved.alias("saved"))
        below = written(below, "trie-folded")
        done.append(below)
    nodes = done[0]
    for d in done[1:]:
        nodes = nodes.unionByName(d)
    ends = ended[0]
    for e in ended[1:]:
        ends = ends.union(e)
    names = {"node": "conv_id", "parent": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
    return _result(nodes.withColumnsRenamed(names), hashed_lists(written(ends, "trie-ends")))


def _chains(turns: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """node, depth, n, chars, longest, saved: the turns of retired classes below the depth where they retired."""
    retired = [x.where("alike").select(F.col("node").alias("conv"), F.lit(d).cast("long").alias("at"), "n", "longest") for d, x in enumerate(levels)]
    every = retired[0]
    for r in retired[1:]:
        every = every.union(r)
    tail = join_salted(turns, every.where(F.col("longest") > F.col("at")).withColumn("_many", F.col("longest")), ["conv"], "_many", ["pos"], turns.count()).where("pos > at")
    tail = written(tail.select(F.col("conv").alias("node"), F.col("pos").alias("depth"), "n", "chars", "longest"), "trie-chains")
    shared = running(tail.where("n > 1"), "depth", ["node"], ["chars"], descending=True)
    one = tail.where("n = 1").withColumn("saved", F.lit(0).cast("long"))
    return one.unionByName(shared.withColumn("saved", ((F.col("n") - 1) * (F.col("chars") + F.col("chars_before"))).cast("long")).drop("chars_before"))


def hashed_lists(ends: DataFrame) -> DataFrame:
    """node, length, sha256 of the members (conv) of each, as ascending decimals joined by commas."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, length, conv = (b.column(k).to_pylist() for k in range(3))
            rows, a = [], 0
            for z in range(1, len(node) + 1):
                if z == len(node) or node[z] != node[a] or length[z] != length[a]:
                    rows.append((node[a], length[a], conv[a], ",".join(map(str, conv[a:z]))))
                    a = z
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["node", "length", "first", "part"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node", "length", "sha"])

        for b in batches:
            rows = []
            for node, length, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (node, length) == now:
                    state.update(b"," + part.encode())
                    continue
                if now:
                    rows.append((*now, state.hexdigest()))
                now, state = (node, length), hashlib.sha256(part.encode())
            if rows:
                yield batch(rows)
        if now:
            yield batch([(*now, state.hexdigest())])

    n = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["node", "length", "conv"]
    parts = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(stretches, "node long, length long, first long, part string")
    return parts.repartition(n, "node", "length").sortWithinPartitions("node", "length", "first").mapInArrow(hashes, "node long, length long, sha string")


def _result(nodes: DataFrame, ends: DataFrame | None) -> DataFrame:
    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    if ends is None:
        return nodes.select(*numbers, none.alias("ends_sha256"))
    ends = ends.select(F.col("node").alias("conv_id"), F.col("length").alias("depth"), "sha")
    return nodes.join(ends, ["conv_id", "depth"], "left").select(*[F.col(c).cast("long").alias(c) for c in numbers], F.coalesce("sha", none).alias("ends_sha256"))


def op11_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_heads(numbered(table(spark, sf_dir, "conversations"))))


OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, c - c % 100 AS base, {CRC32.format('CAST(c AS VARCHAR)')} % 6 AS h FROM t GROUP BY c),
k AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS taken FROM n a LEFT JOIN n b ON b.c = a.base),
r AS (SELECT k.c, t.i AS pos, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.i <= k.taken
      UNION ALL SELECT k.c, k.taken + t.i - k.h, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.i > k.h),
p AS (SELECT c, pos AS depth, length(text) AS chars,
             sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos)) AS prefix FROM r
      UNION ALL SELECT c, 0, 0, '' FROM k),
nodes AS (SELECT depth, prefix, min(c) AS conv_id, count(*) AS n, max(chars) AS chars FROM p GROUP BY depth, prefix),
last AS (SELECT c, max(depth) AS depth FROM p GROUP BY c),
ends AS (SELECT p.depth, p.prefix, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM p JOIN last USING (c, depth) GROUP BY ALL),
up AS (SELECT x.depth, x.conv_id, p.prefix AS parent_prefix FROM nodes x JOIN p ON p.c = x.conv_id AND p.depth = x.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent_prefix AS prefix, count(*) AS n_children FROM up GROUP BY ALL),
full_ AS (SELECT x.*, coalesce(n_children, 0) AS n_children FROM nodes x LEFT JOIN kids USING (depth, prefix)),
under AS (SELECT p.depth, p.prefix, sum((x.n_children = 0)::BIGINT) AS n_leaves, sum((x.n - 1) * x.chars) AS saved
          FROM full_ x JOIN p ON p.c = x.conv_id AND p.depth <= x.depth GROUP BY ALL)
SELECT x.conv_id, x.depth, q.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM full_ x JOIN under USING (depth, prefix) LEFT JOIN ends USING (depth, prefix)
LEFT JOIN up ON up.depth = x.depth AND up.conv_id = x.conv_id LEFT JOIN nodes q ON q.depth = x.depth - 1 AND q.prefix = up.parent_prefix
"""
