"""Substring dedup: passages that recur across documents are found by Aho-Corasick automata and removed but for their first place.

A window is WINDOW consecutive words. Each window has an anchor, the run of ANCHOR words in it with the least hash, so equal
windows have equal anchors.

1. Anchors seen in one document alone rule their windows out. The others go to the tasks as a Bloom filter sized by their number; where that would
   pass MOST_BITS, each document is joined with the list of its own instead.
2. The remaining windows are confirmed: those in two documents at least get the least doc_id that holds them. Counting is by
   128-bit hashes, combined before the shuffle, so a passage that a third of all documents share stays one row per task.
3. Each first document gives its confirmed windows as passages: windows side by side with one anchor are one record of text.
4. Documents are dealt into groups of bounded expected bytes. Each group gets the passages whose anchors its documents hold, compiles them
   into its own automaton (pyahocorasick, over word numbers), and streams its whole documents through it. A record's pattern is what all of
   its windows share; around a hit, words are compared on both sides, so removal rests on the words themselves.

So no automaton outgrows its group, and every document passes through one automaton.

Rules: a null text has no words; rows without doc_id are kept whole and make nobody else lose words; rows that share a doc_id do
not count as each other's earlier document; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_salted, picked, table, tune, written
from .encoders import buffered
from .words import MOST_BITS, PRIME, in_bitmap, key_bitmap, maybe_in, mixed, runs, split_words

WINDOW, ANCHOR = 50, 8
GROUP_BYTES = 3 << 20  # expected text of a group
BATCH = 3 << 20
# an odd multiplier, and its inverse modulo 2**64, for hashes of windows from running sums
STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def least_of(x: np.ndarray, k: int) -> np.ndarray:
    """The least of the k numbers from each place on (shorter by k - 1)."""
    if len(x) < k:
        return x[:0]
    width, out = 1, x
    while 2 * width <= k:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    if width < k:
        out = np.minimum(out[: len(x) - k + 1], out[k - width : k - width + len(x) - k + 1])
    return out


def window_anchors(h: np.ndarray, at: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, document and anchor of every window of a batch."""
    least = least_of(runs(h, anchor)[: max(0, len(h) - anchor + 1)], window - anchor + 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(np.arange(len(least)) + window <= at[1:][doc[: len(least)]]) if len(least) else np.zeros(0, np.int64)
    return start, doc[start], least[start]


def window_hashes(h: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for step in STEPS:
        powers = np.ones(len(h) + 1, np.uint64)
        powers[1:] = np.cumprod(np.full(len(h), step, np.uint64))
        back = np.cumprod(np.append(np.uint64(1), np.full(len(h), pow(step, -1, 1 << 64), np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(mixed(h + np.uint64(step)) * powers[:-1]))
        out.append(mixed((sums[start + window] - sums[start]) * back[start]).view(np.int64))
    return out[0], out[1]


def _anchor_rows(src: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, anchor: every anchor of a document once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buffered(batches, BATCH):
            h, at, _ = split_words(t["text"].combine_chunks())
            _, doc, a = window_anchors(h, at, window, anchor)
            new = np.append(True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])) if len(a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(pa.array(doc[new])), pa.array(a[new].view(np.int64))], names=["doc_id", "anchor"])

    return src.mapInArrow(rows, "doc_id long, anchor long")


def _marked(src: DataFrame, held: DataFrame, total: int, keys: DataFrame, most_bits: int) -> tuple[DataFrame, np.ndarray | None]:
    """src and a bit map of the anchors in keys (anchor, n); or, where they are too many, src with the list `marks` of each document's own."""
    bitmap = key_bitmap(keys, "anchor", most_bits)
    if bitmap is not None:
        return src, bitmap
    own = join_salted(held, keys.select("anchor", "n"), ["anchor"], "n", ["doc_id"], total).groupBy("doc_id").agg(F.collect_set("anchor").alias("marks"))
    return src.join(own, "doc_id", "left"), None


def _recur(t: pa.Table, doc: np.ndarray, anchors: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
    """Which of a batch's anchors may be among the keys."""
    if bitmap is not None:
        return in_bitmap(anchors, bitmap)
    marks = t["marks"].combine_chunks()
    row = np.repeat(np.arange(len(t), dtype=np.uint64), np.asarray(pc.fill_null(pc.list_value_length(marks), 0)))
    return np.isin(mixed(anchors ^ doc.astype(np.uint64) * PRIME), mixed(np.asarray(marks.flatten()).view(np.uint64) ^ row * PRIME))


def _window_rows(src: DataFrame, bitmap: np.ndarray | None, window: int, anchor: int) -> DataFrame:
    """doc_id, h, g: the hashes of every window whose anchor may recur."""
    sent = src.sparkSession.sparkContext.broadcast(bitmap)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buffered(batches, BATCH):
            h, at, _ = split_words(t["text"].combine_chunks())
            start, doc, a = window_anchors(h, at, window, anchor)
            hit = _recur(t, doc, a, sent.value)
            some = np.zeros(len(at) - 1, bool)
            some[doc[hit]] = True
            words = np.repeat(some, np.diff(at))  # of the documents concerned
            x, y = window_hashes(h[words], (np.cumsum(words) - 1)[start[hit]], window)
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(pa.array(doc[hit])), pa.array(x), pa.array(y)], names=["doc_id", "h", "g"])

    return src.mapInArrow(rows, "doc_id long, h long, g long")


def _passages(owners: DataFrame, window: int, anchor: int) -> DataFrame:
    """anchor, first, run, words: side-by-side confirmed windows of one anchor, as text, from rows of doc_id, text and own (hashes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buffered(batches, BATCH):
            h, at, words = split_words(t["text"].combine_chunks())
            start, doc, a = window_anchors(h, at, window, anchor)
            x, _ = window_hashes(h, start, window)
            grams, out = runs(h, anchor), []
            words = words.to_pylist()
            bounds = np.searchsorted(doc, np.arange(len(t) + 1))
            for k, (d, own) in enumerate(zip(t["doc_id"].to_pylist(), t["own"].to_pylist(), strict=True)):
                s = slice(bounds[k], bounds[k + 1])
                pick = start[s][np.isin(x[s], own)]
                if not len(pick):
                    continue
                place = pick + np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1)[pick].argmin(axis=1)
                cut = np.flatnonzero(np.append(True, (np.diff(pick) != 1) | (np.diff(place) != 0)))
                for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(pick)], strict=True):
                    out.append((int(grams[place[i]].view(np.int64)), d, j - i, " ".join(words[pick[i] : pick[j - 1] + window])))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["anchor", "first", "run", "words"]), schema=pa.schema([("anchor", pa.int64()), ("first", pa.int64()), ("run", pa.int32()), ("words", pa.string())]), preserve_index=False)

    return owners.mapInArrow(rows, "anchor long, first long, run int, words string")


def _routed(src: DataFrame, bitmap: np.ndarray | None, window: int, anchor: int) -> DataFrame:
    """doc_id, n_words, kept, removed: whole documents; those without recurring anchors are done, the others carry text for their automaton."""
    sent = src.sparkSession.sparkContext.broadcast(bitmap)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buffered(batches, BATCH):
            h, at, words = split_words(t["text"].combine_chunks())
            _, doc, a = window_anchors(h, at, window, anchor)
            hit = np.bincount(doc[_recur(t, doc, a, sent.value)], minlength=len(t)) > 0
            whole = pc.binary_join(pa.ListArray.from_arrays(at.astype(np.int32), words), pa.scalar(" ", pa.large_string()))
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(np.diff(at)), whole.cast(pa.string()), pa.array(hit)], names=["doc_id", "n_words", "kept", "open"])

    return src.mapInArrow(rows, "doc_id long, n_words long, kept string, open boolean")


class Automaton:
    """Passages over numbered words."""

    def __init__(self, passages: pd.DataFrame, window: int):
        self.window, self.number, self.records = window, {}, []
        number, by_core = self.number, defaultdict(list)
        for first, run, text in zip(passages["first"].tolist(), passages["run"].tolist(), passages["words"].tolist(), strict=True):
            words = tuple([number.setdefault(w, len(number) + 1) for w in text.split(" ")])
            by_core[words[run - 1 : window]].append((first, run, words))
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for core, records in by_core.items():
            self.found.add_word(core, (len(core), records))
        self.found.make_automaton()

    def covered(self, doc_id: int, words: list[str]) -> np.ndarray:
        """Which words lie in a window that starts in an earlier document."""
        get = self.number.get
        doc, out = tuple([get(w, 0) for w in words]), np.zeros(len(words), bool)
        for end, (size, records) in self.found.iter(doc):
            a, b = end - size + 1, end + 1
            for first, run, text in records:
                if first >= doc_id:
                    continue
                left = right = run - 1
                if a < left or doc[a - left : b + right] != text:
                    left = right = 0
                    while left < run - 1 and a - left > 0 and doc[a - left - 1] == text[run - 2 - left]:
                        left += 1
                    while right < run - 1 and b + right < len(doc) and doc[b + right] == text[self.window + right]:
                        right += 1
                    if left + right < run - 1:
                        continue
                out[a - left : b + right] = True
        return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, group_bytes: int = GROUP_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space); a row per row of docs."""
    tune(docs.sparkSession)
    src = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dated = src.where("doc_id is not null")
    held = written(_anchor_rows(dated, window, anchor), "anchors")
    total = held.count()
    recurring = held.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n")
    recurring = written(recurring, "recurring")
    windows = _window_rows(*_marked(dated, held, total, recurring, most_bits), window, anchor)
    firsts = windows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    own = written(firsts.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("h").alias("own")), "firsts")  # no more than the document has windows
    owners = maybe_in(dated, "doc_id", key_bitmap(own, "doc_id", most_bits)).join(own, "doc_id")
    passages = written(_passages(owners, window, anchor), "passages")
    known = written(passages.groupBy("anchor").agg(F.min("first").alias("first")).join(recurring, "anchor"), "known")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("group")
    later = join_salted(held, known, ["anchor"], "n", ["doc_id"], total).where("doc_id > first")
    where = later.select("anchor", group).distinct()
    needed = where.join(passages, "anchor").select("group", "first", "run", "words")
    routed = _routed(*_marked(src, held, total, known, most_bits), window, anchor)

    def locate(pdf: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
        out, removed = pdf["kept"].tolist(), np.zeros(len(pdf), np.int64)
        if len(patterns) and pdf["open"].any():
            automaton = Automaton(patterns.drop_duplicates(), window)
            for k in np.flatnonzero(pdf["open"].to_numpy() & pdf["doc_id"].notna().to_numpy()).tolist():
                words = out[k].split(" ")
                gone = automaton.covered(int(pdf["doc_id"].iloc[k]), words)
                removed[k] = gone.sum()
                if removed[k]:
                    out[k] = " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": pdf["n_words"], "n_removed": removed, "kept": out})

    schema = "doc_id long, n_words long, n_removed long, kept string"
    open_docs = routed.withColumn("group", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("kept"), F.lit(groups)).cast("int")).otherwise(group))
    return open_docs.groupBy("group").cogroup(needed.groupBy("group")).applyInPandas(locate, schema)


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
