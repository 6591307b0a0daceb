"""Packing token sequences into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows; the rest of each goes, longest first, into the open window with the least
room that still holds it. A segment tree indexed by remaining room finds that window. Each task packs the documents it reads, a
load of about LOAD bytes of text at a time, and closes the windows that are full or lack at most a SLACK-th. The pieces of all
other windows are packed again, in groups of about REST ids whatever the partitions were: only they are shuffled, by a hash of
their place, so no key can be hot, and memory is bounded in bytes. Many tiny partitions fill as well as few large ones.
A sequence_id is the number of the task, or of the group with bit 62 set, and the window's number in it.

Ids are those of the tokenizers library as it stands: a special marker in a text is its own id (markers=False: plain text).

Rules: a null text is an empty text and still has its end id; rows that repeat a doc_id are documents of their own; a null
doc_id is kept; other columns are left; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, table, tune, vocabulary, written
from .encoders import ByteLevel, buffered, encoder, with_end

WINDOW = 1024
LOAD = 3 << 20  # bytes of text that are packed together
REST, SLACK = 1 << 18, 128  # ids that are packed together the second time; windows that lack no more than this part are closed
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """Counts of open windows by remaining room; best(n) is the least room >= n that some window has, or -1."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def pop(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()

    def best(self, least: int) -> int:
        at, count = self.leaves + least, self.count
        if count[at]:
            return least
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return -1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each length (1 to size): its window's number and its offset there."""
    tree, used = RoomTree(size), []
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        room = tree.best(n)
        if room < 0:
            w, room = len(used), size
            used.append(0)
        else:
            w = tree.pop(room)
        window[k], offset[k] = w, used[w]
        used[w] += n
        if room > n:
            tree.push(room - n, w)
    return window, offset


def _again(rests: DataFrame, window: int, rest: int) -> DataFrame:
    """The pieces of windows that were left open, with a new sequence_id and offset."""
    groups = max(1, -(-(rests.agg(F.sum("length")).first()[0] or 0) // rest))
    tasks = min(groups, 8 * int(rests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(groups)).alias("_group")
    dealt = rests.select(group, *rests.columns).repartition(tasks, "_group").sortWithinPartitions("_group")

    def placed(held: list[pa.RecordBatch], group: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().drop_columns("_group")
        place, offset = best_fit_decreasing(np.asarray(t["length"]), window)
        t = t.set_column(t.column_names.index("sequence_id"), "sequence_id", pa.array((1 << 62 | group << 40) + place))
        return t.set_column(t.column_names.index("offset"), "offset", pa.array(offset)).to_batches()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            key = np.asarray(b.column(0))
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
                if held and key[a] != now:
                    yield placed(held, now)
                    held = []
                now = int(key[a])
                held.append(b.slice(a, z - a))
        if held:
            yield placed(held, now)

    return dealt.mapInArrow(pack, rests.schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, digest: bool = False, markers: bool = True, load: int = LOAD, rest: int = REST) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (binary, 4 bytes each); with digest ids_crc32 instead."""
    tune(docs.sparkSession)
    path = vocabulary("byte_bpe_50k.json")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(ByteLevel, path, markers), TaskContext.get().partitionId() << 40
        for t in buffered(batches, load):
            ids, sizes = with_end(*enc.encode(t["text"].combine_chunks()), end_id)
            n = -(-sizes // window)
            of = np.repeat(np.arange(len(n)), n)
            start = window * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
            length = np.minimum(window, sizes[of] - start)
            place, offset = best_fit_decreasing(length, window)
            closed = pa.array(np.bincount(place, length)[place] >= window - window // SLACK) if len(place) else pa.array([], pa.bool_())
            ends = np.append(0, 4 * np.cumsum(length))
            if digest:
                raw = memoryview(ids).cast("B") if len(ids) else b""
                own = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
            else:
                own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(ids)]).cast(pa.binary())
            columns = [t["doc_id"].combine_chunks().take(of), pa.array(start), pa.array(length), pa.array(sizes[of]), pa.array(base + place), pa.array(offset), own, closed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digest else "ids", "closed"])
            base += int(place.max()) + 1 if len(place) else 0

    src = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = written(src.mapInArrow(pack, f"{PIECES}, {'ids_crc32 long' if digest else 'ids binary'}, closed boolean"), "pieces")
    return pieces.where("closed").drop("closed").union(_again(pieces.where("not closed").drop("closed"), window, rest))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), digest=True)
