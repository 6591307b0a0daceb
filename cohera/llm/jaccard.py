"""N-gram Jaccard join: an exact similarity join of documents on their sets of word n-grams, and its components.

The join is a sparse product of the incidence matrix of documents by n-grams with its transpose, by blocks, in which overlap counts accumulate
and decide. Texts are read where they lie, to make the matrix, and never moved: rows that are equal (documents with one set) are one row.

1. Head columns. N-grams are ordered rarest first. Of n n-grams, two rows that reach the threshold share one of the first
   n - ceil(t n) + 1, so only those columns are multiplied to find pairs, in blocks by hash of the n-gram. Counts of a pair add up within a block
   and then over blocks; with what is left of both rows after the last common column they bound its whole overlap, and pairs whose bound
   is below what their sizes ask for are discarded, as are those that signatures (bit maps of two to four bits an n-gram) rule out.
2. Whole rows. Rows of pairs that are left are made again with all their n-grams, which takes less than keeping all rows. For each pair left, a block of rows meets the row it is paired with (a block of sparse rows times one column of the transpose), and the overlap
   that accumulates there decides. A row paired with very many others is copied to as many blocks as they fill.

   Where those places of rows in blocks are few (MOST_ASKED, counted first) they are broadcast to the texts' tasks, so a row moves once, to its block; beyond
   that rows and places are shuffled to meet first.

Not all pairs of a group are made. First each row meets the rows that lead most of its head columns (stars); links make
components; only columns with more than one component stay for the next round and are multiplied in full in the last, and only across components. So a large group of
near copies costs a few pairs per document, and no link between components is missed; links inside a component are not counted.

The order of n-grams takes their rarity from a sketch of fixed size over the whole corpus; any order gives the same result. An n-gram is 48 bits of
a hash in a kept row: two different ones of a pair of rows of n n-grams meet with odds of n * n / 2 ** 48.

Rules: a null text is an empty set; empty sets link with nothing; rows that share a doc_id are one node; a row without doc_id
gets its size, links with nothing and has no component; other columns are left; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_salted, picked, table, tune, written
from .encoders import buffered
from .graphs import components
from .words import MOST_BITS, in_bitmap, key_bitmap, maybe_in, runs, split_words

BUCKETS = 1 << 18  # of the sketch of n-gram counts
CHUNK = 1 << 14
LEAST_BITS = 1024  # of a set's signature, which has two to four bits an n-gram beyond that
BLOCK_ROWS = 1000  # of the rows that meet one other in a block
MOST_ASKED = 1 << 19  # places of rows in blocks that are broadcast, some 100 bytes each; beyond it whole rows are shuffled to their places' key first
STAR_HUBS = (1, 4)  # hubs per row in each star round


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text, the sorted hashes of its distinct n-grams (ASCII letters in lower case); a shorter text is one n-gram."""
    h, at, _ = split_words(texts, lower=True)
    grams, out = runs(h, words), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(runs(h[a:b], b - a)[:1])
    return out


def signature(grams: np.ndarray) -> bytes:
    """A bit map of the n-grams; its size is a power of two, so one folds onto a smaller one."""
    size = max(LEAST_BITS, 1 << (2 * len(grams) - 1).bit_length()) if len(grams) else LEAST_BITS
    bits = np.zeros(size, bool)
    bits[(grams >> np.uint64(32) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def most_shared(x: bytes, y: bytes, n: int, m: int) -> int:
    """No fewer than the n-grams that sets of n and m share: each bit that one has alone is an n-gram that the other lacks."""
    least = min(len(x), len(y)) // 8
    x, y = (np.bitwise_or.reduce(np.frombuffer(s, np.uint64).reshape(-1, least), axis=0) for s in (x, y))
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _sketch(src: DataFrame, words: int) -> np.ndarray:
    """How many n-grams of all documents fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for t in buffered(batches, 3 << 20):
            sets = shingle_sets(t["text"].combine_chunks(), words)
            if sets:
                total += np.bincount((np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        rows = [total[a : a + CHUNK].astype("<i8").tobytes() for a in range(0, BUCKETS, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["chunk", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in pdf.n)
        return pd.DataFrame({"chunk": pdf.chunk.iloc[:1], "n": [total.tobytes()]})

    parts = src.select("text").mapInArrow(count, "chunk int, n binary").groupBy("chunk").applyInPandas(add, "chunk int, n binary").collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in parts:
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(bytes(r.n), "<i8")
    return out


def packed(gram: np.ndarray) -> np.ndarray:
    """48 bits of each hash as 6 bytes."""
    return np.ascontiguousarray((gram >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def unpacked(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def incidence(src: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (size of the set), set_key (its digest), head (the n-grams that the bound leaves, rarest first), and bits (its signature)."""
    counts = src.sparkSession.sparkContext.broadcast(_sketch(src, words))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buffered(batches, 3 << 20):
            sets = shingle_sets(t["text"].combine_chunks(), words)
            heads = []
            for s in sets:
                n = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                heads.append(s[np.lexsort((s, counts.value[(s % np.uint64(BUCKETS)).astype(np.int64)]))[:n]].view(np.int64))
            bits = [signature(s) for s in sets]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n", "set_key", "head", "bits"])

    return src.mapInArrow(rows, "doc_id long, n long, set_key binary, head array<long>, bits binary")


def whole_rows(src: DataFrame, wanted: DataFrame, words: int, most_bits: int) -> DataFrame:
    """first, set_key and grams (all n-grams, 6 bytes each) of the nodes in wanted (and of a few more)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buffered(batches, 3 << 20):
            sets = shingle_sets(t["text"].combine_chunks(), words)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(keys, pa.binary()), pa.array([packed(s).tobytes() for s in sets], pa.binary())], names=["first", "set_key", "grams"])

    return maybe_in(src, "doc_id", key_bitmap(wanted, "first", most_bits)).mapInArrow(rows, "first long, set_key binary, grams binary")


def _postings(nodes: DataFrame, bitmap: np.ndarray | None, shared: DataFrame) -> DataFrame:
    """gram, rep, n, left (n-grams from this one on) for the columns that have, or by the bit map may have, more than one row."""
    sent = nodes.sparkSession.sparkContext.broadcast(bitmap)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head = b.column(2)
            gram, size = np.asarray(head.flatten()), np.diff(np.asarray(head.offsets))
            hit = np.ones(len(gram), bool) if sent.value is None else in_bitmap(gram.view(np.uint64), sent.value)
            row = np.repeat(np.arange(b.num_rows), size)
            place = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
            n = np.asarray(b.column(1))[row]
            yield pa.RecordBatch.from_arrays([pa.array(gram[hit]), pa.array(np.asarray(b.column(0))[row[hit]]), pa.array(n[hit]), pa.array((n - place)[hit])], names=["gram", "rep", "n", "left"])

    out = nodes.select("rep", "n", "head").mapInArrow(pick, "gram long, rep long, n long, left long")
    return out if bitmap is not None else out.join(shared.select("gram"), "gram")


def _of_pairs(pairs: DataFrame, nodes: DataFrame, most_bits: int) -> DataFrame:
    """The nodes of pairs, and a few more: others do not move."""
    return maybe_in(nodes, "rep", key_bitmap(pairs.select(F.explode(F.array("row", "hub")).alias("rep")).distinct(), "rep", most_bits))


def _near(pairs: DataFrame, nodes: DataFrame, percent: int, most_bits: int) -> DataFrame:
    """The pairs (row, hub) that their signatures leave."""
    nodes = _of_pairs(pairs, nodes, most_bits)
    side = lambda x: nodes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("row"), "row").join(side("hub"), "hub").select("row", "hub", "n_row", "n_hub", "bits_row", "bits_hub")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buffered(batches, 3 << 20):
            n, m = np.asarray(t["n_row"]), np.asarray(t["n_hub"])
            most = np.array([most_shared(*x) for x in zip(t["bits_row"].to_pylist(), t["bits_hub"].to_pylist(), n.tolist(), m.tolist(), strict=True)], np.int64)
            good = pa.array((100 + percent) * most >= percent * (n + m))
            yield pa.RecordBatch.from_arrays([t["row"].combine_chunks().filter(good), t["hub"].combine_chunks().filter(good)], names=["row", "hub"])

    return both.mapInArrow(pick, "row long, hub long")


def _product(pairs: DataFrame, nodes: DataFrame, src: DataFrame, words: int, percent: int, most_bits: int, most_asked: int) -> DataFrame:
    """The pairs (row, hub) whose accumulated overlap reaches the threshold, as links (a, b)."""
    hubs = pairs.groupBy("hub").agg(F.count("*").alias("k")).withColumn("blocks", F.ceil(F.col("k") / BLOCK_ROWS))
    hubs = written(hubs, "hubs")
    dealt = join_salted(pairs, hubs, ["hub"], "k", ["row"], pairs.count()).select("hub", F.pmod(F.xxhash64("row"), "blocks").alias("block"), F.lit(1).alias("kind"), F.col("row").alias("rep"))
    copies = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("hub").alias("rep"))
    asked = written(dealt.union(copies).join(_of_pairs(pairs, nodes.select("rep", "first", "set_key"), most_bits), "rep"), "asked")
    rows = whole_rows(src, asked.select("first").distinct(), words, most_bits)
    sent = F.broadcast(asked) if asked.count() <= most_asked else asked
    blocks = rows.join(sent, ["first", "set_key"]).select("hub", "block", "kind", "rep", "grams").repartition("hub", "block").sortWithinPartitions("hub", "block", "kind")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, np.zeros(0, np.uint64)
        for b in batches:
            head, block, kind, row = (np.asarray(b.column(c)) for c in range(4))
            grams, out = b.column(4), []
            cut = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(head)], strict=True):
                if not kind[a]:
                    now, hub = head[a], np.sort(unpacked(np.frombuffer(grams[a].as_py(), np.uint8)))
                    continue
                if head[a] != now:
                    raise ValueError("a block of rows without its column")
                parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in grams.slice(a, z - a)]
                size = np.array([len(x) // 6 for x in parts])
                flat = unpacked(np.concatenate(parts))
                hit = hub[np.minimum(np.searchsorted(hub, flat), len(hub) - 1)] == flat
                overlap = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
                good = 100 * overlap >= percent * (size + len(hub) - overlap)
                out += [(min(x, int(now)), max(x, int(now))) for x in row[a:z][good].tolist()]
            got = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return blocks.mapInArrow(multiply, "a long, b long").distinct()


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS, most_asked: int = MOST_ASKED) -> DataFrame:
    """doc_id, n_shingles, component_id: two documents link when percent * union <= 100 * intersection. A row per row of docs."""
    tune(docs.sparkSession)
    src = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = written(incidence(src, words, percent), "incidence")
    known = made.where("doc_id is not null and n > 0")
    # a distinct set is a node, with a number of its own: one doc_id may be the first of several sets
    sets = known.groupBy("set_key").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "head", "bits")])  # one set, one head
    nodes = written(sets.withColumn("rep", F.monotonically_increasing_id()).select("set_key", "first", "rep", "n", "head", "bits"), "nodes")
    reps = nodes.select("set_key", "first", "rep")
    shared = written(nodes.select(F.explode("head").alias("gram")).groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "columns")
    grams = written(_postings(nodes, key_bitmap(shared, "gram", most_bits), shared).withColumn("component", F.col("rep")), "shared")
    reach = lambda rest, x, y: rest * (100 + percent) >= percent * (x + y)
    links = None
    for k, most in enumerate([*STAR_HUBS, None]):
        if k:
            found = components(links)
            grams = written(rest.select("gram", "rep", "n", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("gram", "rep", "n", "left", F.coalesce("component", "rep").alias("component")), "shared")
        # a hub: the row with most n-grams still to come, so the one with fewest of its own; in later rounds any
        row, rank = F.struct("rep", "component", "n", "left"), F.xxhash64("rep", F.lit(k)) if k else F.struct(F.col("n") - F.col("left"), F.col("rep"))
        mixed = grams.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least_n"), F.min_by(row, rank).alias("lead"), F.count("*").alias("k")).where("lo < hi")
        # at the first n-gram that two rows share, the shorter rest of the two bounds the overlap; sums stand for unions
        fits = lambda x, y, rx, ry: reach(F.least(rx, ry), x, y)
        rest = join_salted(grams, written(mixed, "mixed"), ["gram"], "k", ["rep"], grams.count()).where(reach(F.col("left"), F.col("n"), F.greatest(F.col("least_n"), F.ceil(F.col("n") * percent / 100))))
        if most:
            rest = written(rest, "rest")  # the next round's: what has left a column cannot pair there again, and a column of one component stays so
            star = rest.where((F.col("rep") != F.col("lead.rep")) & (F.col("component") != F.col("lead.component")) & fits(F.col("n"), F.col("lead.n"), F.col("left"), F.col("lead.left")))
            counted = star.groupBy(F.col("rep").alias("row"), F.col("lead.rep").alias("hub")).agg(F.count("*").alias("overlap"))
            best = counted.groupBy("row").agg(F.slice(F.sort_array(F.collect_list(F.struct("overlap", "hub")), asc=False), 1, most).alias("best"))  # no more hubs than a row has n-grams
            pairs = best.select("row", F.explode("best.hub").alias("hub"))
        else:
            # the product of the head columns across components: counts add up per pair, and with the rest after the last common column bound its overlap
            x, y = rest.select("gram", "rep", "component", "n", "left").alias("x"), rest.select("gram", "rep", "component", "n", "left").alias("y")
            both = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") < F.col("y.component")) & fits(F.col("x.n"), F.col("y.n"), F.col("x.left"), F.col("y.left")))
            summed = both.groupBy(F.col("x.rep").alias("row"), F.col("y.rep").alias("hub")).agg(F.count("*").alias("overlap"), F.min(F.least("x.left", "y.left")).alias("after"), F.min(F.col("x.n") + F.col("y.n")).alias("sizes"))
            pairs = summed.where(reach(F.col("overlap") + F.col("after") - 1, F.col("sizes"), F.lit(0))).select("row", "hub")
        good = _product(written(_near(written(pairs, "candidates"), nodes.select("rep", "n", "bits"), percent, most_bits), "pairs"), nodes, src, words, percent, most_bits, most_asked)
        links = written(good if links is None else links.union(good), "links")
    same = known.select("doc_id", "n", "set_key").join(reps, "set_key").select("doc_id", "n", "rep", "first")
    twice = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").join(same, "doc_id").select("a", F.col("rep").alias("b"))
    found = components(links.union(twice))
    least = reps.join(found.withColumnRenamed("node", "rep"), "rep").groupBy("component").agg(F.min("first").alias("component_id"))
    grouped = found.join(least, "component").select(F.col("node").alias("rep"), "component_id")
    lone = made.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = same.join(grouped, "rep", "left").select("doc_id", "n", F.coalesce("component_id", "first").alias("component_id"))
    return out.union(lone).withColumnRenamed("n", "n_shingles")


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), words=4, percent=85)


OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM s),
c AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
h AS (SELECT g.* FROM g SEMI JOIN c USING (gram)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common_n, any_value(x.n) AS na, any_value(y.n) AS nb
      FROM h x JOIN h y ON x.gram = y.gram AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common_n >= 85 * (na + nb - common_n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
f AS (WITH RECURSIVE t(node, seen) AS (SELECT a, a FROM e UNION SELECT t.node, e.b FROM t JOIN e ON t.seen = e.a)
      SELECT node, min(seen) AS m FROM t GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(f.m, s.doc_id) AS component_id FROM s LEFT JOIN f ON s.doc_id = f.node
"""
