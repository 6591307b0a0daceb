"""Line dedup with content-defined chunks, in DataFrame functions alone.

A text is cut into lines. After each line a rolling hash of the last WINDOW line hashes is taken; where DIVISOR divides it, a
chunk ends. Boundaries thus depend on nearby lines only, so equal stretches are cut alike wherever they stand. A
chunk of several lines that has appeared before (by doc_id, then text hash, then line) is removed, once its bytes have been
compared with the other's.

Plan: narrow rows (hash, place) find hashes that repeat; the places go back to their documents, which are shuffled once by key and give the
chunks' bytes; grouping by hash and bytes is the comparison, combined before the shuffle; what is to go is joined to the documents, whose
shuffle is reused. A chunk that very many documents share is dealt over many tasks in the joins on its hash.

Rules: a null text is an empty one; chunks of one line, and blank ones, stay; rows equal in doc_id and text are one document
and get equal results; a null doc_id comes before all others; lines that remain keep their order; other columns are carried
and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_salted, table, written

WINDOW = 2
DIVISOR = 3
FACTOR = 31


def _once(value: Column) -> Column:
    """The value, computed once per row however often later expressions name it."""
    return F.explode(F.array(value))


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _chunked(df: DataFrame, window: int, divisor: int) -> DataFrame:
    """_lines for _text, and _spans (first and last line of each chunk, from 1)."""
    df = df.select("*", _once(F.split(F.coalesce("_text", F.lit("")), "\n")).alias("_lines"))
    df = df.select("*", _once(F.transform("_lines", _line_hash)).alias("_hashes"))

    def rolling(i: Column) -> Column:
        total = F.lit(0).cast("long")
        for back in range(window):
            total = total + F.element_at("_hashes", i - F.lit(back)) * F.lit(FACTOR**back)
        return total

    ends = F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: (i == F.size("_lines")) | F.when(i >= window, F.pmod(rolling(i), F.lit(divisor)) == 0).otherwise(False))
    df = df.select("*", _once(ends).alias("_ends"))
    spans = F.transform("_ends", lambda e, k: F.struct(F.when(k == 0, F.lit(1)).otherwise(F.get("_ends", k - 1) + 1).alias("s"), e.alias("t")))
    return df.select(*[c for c in df.columns if c not in ("_text", "_hashes", "_ends")], _once(spans).alias("_spans"))


def _body(s: Column, t: Column) -> Column:
    return F.array_join(F.slice("_lines", s, t - s + 1), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR, count_cols: bool = False) -> DataFrame:
    """The same rows and columns, less the repeated chunks; with count_cols also n_lines and n_removed."""
    others = [c for c in docs.columns if c != text_col]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    src = src.withColumn("_key", F.xxhash64("_text"))
    places = _chunked(src.select("_id", "_key", "_text"), window, divisor).select("_id", "_key", "_lines", F.explode("_spans").alias("_c"))
    places = places.where("_c.t > _c.s").select("_id", "_key", F.col("_c.s").alias("_s"), F.col("_c.t").alias("_t"), _body(F.col("_c.s"), F.col("_c.t")).alias("_b"))
    places = places.where("trim(replace(_b, '\n', '')) <> ''").select("_id", "_key", "_s", "_t", F.xxhash64("_b").alias("_h"))
    places = written(places, "places")
    often = written(places.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    total = places.count()
    back = join_salted(places, often, ["_h"], "n", ["_id", "_key", "_s"], total).groupBy("_id", "_key").agg(F.collect_set(F.struct("_s", "_t", "_h")).alias("_maybe"))
    joined = src.join(back.withColumnsRenamed({"_id": "_i", "_key": "_k"}), F.col("_id").eqNullSafe(F.col("_i")) & F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_i", "_k")
    cut = joined.where("_maybe is not null").select("_id", "_key", "_maybe", _once(F.split("_text", "\n")).alias("_lines"))
    cut = cut.select("_id", "_key", "_lines", F.explode("_maybe").alias("_c")).select("_id", "_key", F.col("_c._s").alias("_s"), F.col("_c._t").alias("_t"), F.col("_c._h").alias("_h"), _body(F.col("_c._s"), F.col("_c._t")).alias("_b"))
    first = cut.groupBy("_h", "_b").agg(F.min(F.struct("_id", "_key", "_s")).alias("_first"), F.count("*").alias("n")).where("n > 1").select("_h", F.sha2("_b", 256).alias("_d"), "_first", "n")
    gone = join_salted(cut.select("_id", "_key", "_s", "_t", "_h", F.sha2("_b", 256).alias("_d")), written(first, "first"), ["_h", "_d"], "n", ["_id", "_key", "_s"], total).where(~F.struct("_id", "_key", "_s").eqNullSafe(F.col("_first")))
    gone = gone.groupBy("_id", "_key").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("_s", "_t")))).alias("_gone")).withColumnsRenamed({"_id": "_i", "_key": "_k"})
    out = joined.drop("_maybe").join(gone, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    out = out.select("_row", "_text", "_gone", _once(F.when(F.col("_gone").isNotNull(), F.split("_text", "\n"))).alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(1), F.size("_lines")), "_gone")
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("_lines", i)), "\n")).alias(text_col)
    n_lines = F.length(F.coalesce("_text", F.lit(""))) - F.length(F.replace(F.coalesce("_text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    counts = [n_lines.cast("long").alias("n_lines"), F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long").alias("n_removed")] if count_cols else []
    named = {c: F.col("_row")[c].alias(c) for c in others if not count_cols or c not in ("n_lines", "n_removed")} | {text_col: text}
    return out.select(*[named[c] for c in docs.columns if c in named], *counts)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, count_cols=True).select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


OP1_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (SELECT *, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)) AS h FROM l),
e AS (SELECT doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR (i >= 2 AND (h[i] + 31 * h[i - 1]) % 3 = 0)) AS ends FROM h),
c AS (SELECT doc_id, lines, ends, unnest(range(1, len(ends) + 1)) AS j FROM e),
s AS (SELECT doc_id, lines, CASE WHEN j = 1 THEN 1 ELSE ends[j - 1] + 1 END AS s, ends[j] AS t FROM c),
b AS (SELECT doc_id, len(lines) AS n_lines, s, t, array_to_string(lines[s:t], chr(10)) AS body FROM s),
r AS (SELECT *, CASE WHEN t > s AND trim(replace(body, chr(10), '')) <> '' THEN row_number() OVER (PARTITION BY body, t > s ORDER BY doc_id, s) ELSE 1 END AS nth FROM b)
SELECT doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, CAST(coalesce(sum(t - s + 1) FILTER (nth > 1), 0) AS BIGINT) AS n_removed,
       coalesce(string_agg(body, chr(10) ORDER BY s) FILTER (nth = 1), '') AS text
FROM r GROUP BY doc_id
"""
