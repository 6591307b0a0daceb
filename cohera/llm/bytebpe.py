"""Byte-level BPE with vectorised pre-tokenisation.

Every code point has a class; with one or two code points of look-ahead the class becomes a function from scanner state to
scanner state. Such functions compose associatively, so the state before each code point comes from a prefix scan in numpy:
inside short blocks, then over the blocks' totals, then both together. A table says for (state, class) whether a piece starts
there. No regular expression runs. Pieces, as slices of the UTF-8 bytes, go through a cache of merged ids.

The classes and rules below are the published pattern's: contractions, letters, numbers, others (each with one space before),
white space that leaves its last character to what follows.

Encoding keeps, beside the ids, where each id's bytes end; decoding puts the ids' bytes there.

Rules: a null text is an empty text with no ids; a null doc_id stays null; rows are independent, so repeated rows give repeated results;
an empty table gives no rows; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_characters, picked, table, tune, vocabulary

# states
FREE, LETTER, NUMBER, OTHER, SPACE, WHITE, ONE, TWO = range(8)
# classes: letters first (plain; s t m d; r v; e; l), then number, other, apostrophes by what follows, spaces and white space by what follows, end of a text
PLAIN, STMD, RV, E, L, NUM, OTH, AP0, AP1, AP2, SP_LAST, SP, WS_LAST, WS, END = range(15)
BLOCK = 32
BATCH = 250_000  # characters that are cut at once
MOST_PIECES = 400_000


def _step(cls: int, state: int) -> tuple[int, bool]:
    """The state after a code point of that class, and whether a piece starts at it."""
    if cls <= L:
        if state in (ONE, TWO):
            return (FREE, ONE)[state == TWO], False
        return LETTER, state not in (LETTER, SPACE)
    if cls == NUM:
        return NUMBER, state not in (NUMBER, SPACE)
    if cls <= AP2:
        if state in (OTHER, SPACE):
            return OTHER, False
        return {AP1: ONE, AP2: TWO}.get(cls, OTHER), True
    if cls in (SP, WS):
        return WHITE, state != WHITE
    return {SP_LAST: SPACE, WS_LAST: FREE, END: FREE}[cls], True


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that the classes' functions generate: each class's number, the composition table, the states."""
    of_class = [tuple(_step(c, s)[0] for s in range(8)) for c in range(15)]
    found = list(dict.fromkeys(of_class))
    k = 0
    while k < len(found):
        for g in list(dict.fromkeys(of_class)):
            if (h := tuple(g[x] for x in found[k])) not in found:
                found.append(h)
        k += 1
    at = {f: k for k, f in enumerate(found)}
    compose = np.array([[at[tuple(g[x] for x in f)] for g in found] for f in found], dtype=np.uint8)
    return np.array([at[f] for f in of_class], np.uint8), compose, np.array(found, np.uint8)


FUNCTION, COMPOSE, STATES = _closure()
STARTS = np.array([[_step(c, s)[1] for c in range(15)] for s in range(8)])


def _classes() -> np.ndarray:
    """The class of every code point, before look-ahead (apostrophe: AP0; space: SP; other white space: WS)."""
    out = np.full(sys.maxunicode + 1, OTH, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    out[kinds == "L"], out[kinds == "N"] = PLAIN, NUM
    # fixed values: white space as Unicode defines it
    white = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white], out[0x20], out[0x27] = WS, SP, AP0
    for letters, cls in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        out[[ord(c) for c in letters]] = cls
    return out


def prefix_functions(fn: np.ndarray) -> np.ndarray:
    """fn[0] then fn[1] ... then fn[k], for every k, by blocks."""
    n = len(fn)
    if n <= BLOCK:
        out = fn.copy()
        for k in range(1, n):
            out[k] = COMPOSE[out[k - 1], out[k]]
        return out
    rows = np.full((-(-n // BLOCK), BLOCK), FUNCTION[END], np.uint8)
    rows.ravel()[:n] = fn
    cols = np.ascontiguousarray(rows.T)
    width = len(STATES)
    flat = COMPOSE.ravel()
    for k in range(1, BLOCK):
        cols[k] = flat[cols[k - 1].astype(np.uint16) * width + cols[k]]
    before = prefix_functions(cols[-1])[:-1].astype(np.uint16)
    cols[:, 1:] = flat[before[None, :] * width + cols[:, 1:]]
    return np.ascontiguousarray(cols.T).ravel()[:n]


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.classes = _classes()
        self.cache: dict[bytes, bytes] = {}
        pieces = sorted(self.ranks, key=self.ranks.get)
        size = np.array([len(p) for p in pieces], np.int64)
        self.length = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.length[[self.ranks[p] for p in pieces]] = size
        self.place = np.zeros_like(self.length)
        self.place[[self.ranks[p] for p in pieces]] = np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def boundaries(self, text: str) -> np.ndarray:
        """Places of code points at which a piece starts; texts are parted by an end mark (chr(0x10FFFF) stays usable: see encode)."""
        return self._starts(np.frombuffer(text.encode("utf-32-le"), "<u4"), np.zeros(0, np.int64))

    def _starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        cls = self.classes[points]
        cls[ends] = END
        nxt = np.append(cls[1:], END)
        black = (nxt <= AP2)
        cls[(cls == SP) & black] = SP_LAST
        cls[(cls == WS) & black] = WS_LAST
        ap = np.flatnonzero(cls == AP0)
        if len(ap):
            one = nxt[ap]
            two = np.append(nxt[1:], END)[ap]
            lower = points[np.minimum(ap + 1, len(points) - 1)]
            cls[ap[one == STMD]] = AP1
            cls[ap[((one == RV) & (two == E)) | ((one == L) & (two == L) & (lower == ord("l")))]] = AP2
        fn = prefix_functions(FUNCTION[cls])
        state = np.zeros(len(cls), np.uint8)
        state[1:] = STATES[fn[:-1], FREE]
        return np.flatnonzero(STARTS[state, cls])

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 40:
            return self._merge_long(piece)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [ranks.get(piece[k : k + 2]) for k in range(len(piece) - 1)]
        none = len(ranks)
        pairs = [none if p is None else p for p in pairs]
        while pairs and (low := min(pairs)) < none:
            k = pairs.index(low)
            parts[k : k + 2] = [new := parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(new + parts[k + 1], none)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + new, none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        parts = [piece[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            j = after[k]
            if not parts[k] or j >= n or len(parts[k]) + len(parts[j]) != size:
                continue
            parts[k] += parts[j]
            parts[j] = b""
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((k, after[k]), (before[k], k)):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [ranks[p] for p in parts if p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text, its ids as little-endian unsigned 32-bit integers."""
        if len(self.cache) > MOST_PIECES:
            self.cache.clear()
        joined = "\n".join(texts) + "\n"  # the mark after each text is found by place, not by value
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = self._starts(points, ends)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        raw = joined.encode()
        places = at[starts].tolist()
        places.append(len(raw))
        pieces = [raw[a:b] for a, b in zip(places, places[1:], strict=False)]
        cache, merge = self.cache, self.merge
        for p in set(pieces).difference(cache):
            cache[p] = np.array(merge(p), "<u4").tobytes()
        of = np.searchsorted(starts, ends).tolist()  # the mark's own piece
        got, out, first = list(map(cache.__getitem__, pieces)), [], 0
        for k in of:
            out.append(b"".join(got[first:k]))
            first = k + 1
        return out

    def decode(self, ids: bytes, ends: bytes | None = None) -> bytes:
        """The ids' bytes, each id's up to the place that `ends` retains for it (from the ids' lengths where it is not given)."""
        x = np.frombuffer(ids, "<u4")
        if not len(x):
            return b""
        ends = np.frombuffer(ends, "<u4").astype(np.int64) if ends is not None else self.offsets(ids)[1:]
        size = np.diff(ends, prepend=0)
        if len(ends) != len(x) or (size != self.length[x]).any():
            raise ValueError("the offsets are not those of the ids")
        return self.bytes[np.repeat(self.place[x] - ends + size, size) + np.arange(ends[-1])].tobytes()

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte at which each id's bytes start, and at last their number."""
        return np.concatenate([[0], np.cumsum(self.length[np.frombuffer(ids, "<u4")])])


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, ids (binary, 4 bytes each) and ends (binary, 4 bytes each, as a text has less than 2 GB: the byte after each id's, for slicing by token)."""
    tune(docs.sparkSession)
    path = vocabulary(name)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            for a, b in by_characters(pdf.text.tolist(), BATCH):
                p = pdf.iloc[a:b]
                ids = enc.encode(p.text.tolist())
                yield pd.DataFrame({"doc_id": p.doc_id.to_numpy(), "ids": ids, "ends": [enc.offsets(x)[1:].astype("<u4").tobytes() for x in ids]}).astype({"doc_id": "Int64"})

    src = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInPandas(lambda it: encode(p.astype({"doc_id": "Int64"}) for p in it), "doc_id long, ids binary, ends binary")


def decoded(ids_col: str = "ids", ends_col: str = "ends", name: str = "byte_bpe_50k.tiktoken"):
    """A column of the bytes that the ids stand for, placed by the retained offsets."""
    path = vocabulary(name)

    @F.pandas_udf("binary")
    def decode(ids: pd.Series, ends: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([enc.decode(i, e) for i, e in zip(ids, ends, strict=True)], dtype=object)

    return decode(F.col(ids_col), F.col(ends_col))


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents")).withColumn("decoded", decoded())
    return coded.select("doc_id", F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
