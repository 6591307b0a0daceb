"""Words between ASCII white space, their hashes, and hashes of runs of words, for whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_BITS, MOST_BITS, HASHES = 16, 1 << 28, 3  # bits for each key; beyond MOST_BITS (32 MB) no bit map is made
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * PRIME)  # a number for each byte
PLACES = mixed(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)  # a factor for each place in a word


def word_hashes(words: pa.Array) -> np.ndarray:
    """The hash of each word (none is empty): a sum over its bytes of letter times place, and its length."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    off = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    size = np.diff(off)
    place = np.arange(len(raw)) - np.repeat(off[:-1] - off[0], size)
    factor = PLACES[place] if size.max() <= len(PLACES) else mixed(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    return mixed(np.add.reduceat(LETTERS[raw] * factor, off[:-1] - off[0]) + size.astype(np.uint64) * PRIME)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Every word's hash, each text's bounds among them (one more than texts), and the words."""
    texts = texts.fill_null("").cast(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    at = np.asarray(split.offsets).astype(np.int64)
    flat = split.values.slice(at[0], at[-1] - at[0])
    full = np.asarray(pc.not_equal(flat, ""))
    at = np.append(0, np.cumsum(full))[at - at[0]]
    flat = flat if full.all() else flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return word_hashes(coded.dictionary)[np.asarray(coded.indices)], at, flat


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on (the last k - 1 places hold runs that do not exist)."""
    out = np.zeros(len(hashes), np.uint64)
    for j in range(k):
        out = out * PRIME
        out[: max(0, len(hashes) - j)] += hashes[j:]  # a batch may hold fewer than k words
    return mixed(out + np.uint64(k))


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return [mixed(keys + np.uint64((k + 1) * int(PRIME) % 2**64)) >> shift for k in range(HASHES)]


def key_bitmap(keys: DataFrame, column: str, most_bits: int = MOST_BITS) -> np.ndarray | None:
    """A Bloom filter of a column of longs, sized by how many there are; None where it would pass most_bits, so that callers join instead."""
    need = max(KEY_BITS * keys.count(), 1 << 12)
    if need > most_bits:
        return None
    bits = 1 << (need - 1).bit_length()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate(_places(np.asarray(b.column(0)).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["w", "b"])

    got = keys.select(column).mapInArrow(words, "w long, b long").groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(got["w"])] = np.asarray(got["b"]).view(np.uint64)
    return out


def in_bitmap(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for p in _places(keys, len(bitmap) * 64):
        hit &= (bitmap[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def maybe_in(df: DataFrame, column: str, bitmap: np.ndarray | None) -> DataFrame:
    """The rows whose key (long) may be in the bitmap: all that are, and a few that are not; without a bitmap all rows with a key."""
    known = df.where(F.col(column).isNotNull())
    if bitmap is None:
        return known
    sent, at = df.sparkSession.sparkContext.broadcast(bitmap), df.columns.index(column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitmap(np.asarray(b.column(at)).view(np.uint64), sent.value)))

    return known.mapInArrow(keep, df.schema)
