"""Token ids as files: ids ranked by frequency, each rank in 1 to 4 whole bytes, the lengths in control bytes apart.

A block is: magic, counts, one control byte for every four ranks (two bits each: bytes less one), then the ranks' bytes,
little end first. The id of each rank stands in a small table beside the blocks. Blocks lie in a Parquet folder (a column of block images), so they are
written by tasks, committed as a whole and read from any store that Spark reads. Decoding is table lookup: 256 control bytes
to four lengths, a running sum to places, and masked byte gathers.

Ids are those of the tokenizers library as it stands: a special marker in a text is its own id (markers=False: plain text).

Rules: a null text is an empty text; each document ends with the end id; documents go by ascending doc_id, nulls first, rows
of equal doc_id by a hash of their text, equal rows in any order (a random key spreads them over tasks); an empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, shared_dir, table, tune, vocabulary, written
from .encoders import WordLevel, buffered, encoder, with_end

MAGIC = b"FRQ1"
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)
BLOCK_DOCS = 500
RAW = "part int, before long, docs binary, has_id binary, lengths binary, ids binary"


def encode_ranks(ranks: np.ndarray) -> bytes:
    """One block's image."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < size[:, None]]
    return MAGIC + struct.pack("<II", len(ranks), len(data)) + control.tobytes() + data.tobytes()


def decode_ranks(image: bytes) -> np.ndarray:
    if image[:4] != MAGIC:
        raise ValueError("not a block of ranked ids")
    n, n_data = struct.unpack_from("<II", image, 4)
    n_control = -(-n // 4)
    if len(image) != 12 + n_control + n_data:
        raise ValueError("a block of ranked ids has been cut short")
    size = LENGTHS[np.frombuffer(image, np.uint8, n_control, 12)].ravel()[:n]
    data = np.frombuffer(image, np.uint8, n_data, 12 + n_control)
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    out = data[at].astype("<u4") if n else np.zeros(0, "<u4")
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, id_col: str, text_col: str, end_id: int, markers: bool = True) -> DataFrame:
    """Blocks of ids in order of doc_id: part, and in it the number of ids before, order the blocks; `docs` and `lengths` describe their documents."""
    tune(docs.sparkSession)
    path = vocabulary("word_bpe_49k.json")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(WordLevel, path, markers), 0
        for t in buffered(batches):
            ids, sizes = with_end(*enc.encode(t["text"].combine_chunks()), end_id)
            ids = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids
            doc, part = t["doc_id"].combine_chunks(), t["part"][0].as_py() if len(t) else 0
            has, doc, at = np.asarray(doc.is_valid()), np.asarray(doc.fill_null(0)).astype("<i8"), np.append(0, np.cumsum(sizes))
            rows = []
            for a in range(0, len(t), BLOCK_DOCS):
                b = min(len(t), a + BLOCK_DOCS)
                rows.append({"part": part, "before": before, "docs": doc[a:b].tobytes(), "has_id": has[a:b].tobytes(), "lengths": sizes[a:b].astype("<i8").tobytes(), "ids": ids[at[a] : at[b]].tobytes()})
                before += int(at[b] - at[a])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("before", pa.int64()), *[(n, pa.binary()) for n in ("docs", "has_id", "lengths", "ids")]]))

    src = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"), F.rand(5).alias("spread"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie", "spread").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(blocks, RAW)


def _ids(raw: bytes, lengths: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * lengths.sum() else "<u4").astype("<u4")


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, markers: bool = True) -> None:
    """Writes path/blocks and path/ranks (a row per id that occurs, so at most the vocabulary)."""
    spark = docs.sparkSession
    raw = written(tokenised(docs, id_col, text_col, end_id, markers), "ids")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1, np.int64)
        for pdf in batches:
            for ids, lengths in zip(pdf.ids, pdf.lengths, strict=True):
                got = np.bincount(_ids(ids, np.frombuffer(lengths, "<i8")))
                if len(got) > len(total):
                    got, total = total, got
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    counts = raw.select("ids", "lengths").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])  # no more rows than the vocabulary has ids
    spark.createDataFrame(ranks.assign(rank=np.arange(len(ranks)))[["rank", "id", "n"]], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(ranks.id.max()) + 1 if len(ranks) else 1, "<u4")
    rank_of[ranks.id.to_numpy(np.int64)] = np.arange(len(ranks))
    sent = spark.sparkContext.broadcast(rank_of)

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [encode_ranks(sent.value[_ids(i, np.frombuffer(n, "<i8"))]) for i, n in zip(pdf.ids, pdf.lengths, strict=True)]
            yield pdf.drop(columns="ids").assign(image=made)

    raw.mapInPandas(images, "part int, before long, docs binary, has_id binary, lengths binary, image binary").write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, 4 bytes each) of every document in the files."""
    tune(spark)
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    id_of = spark.sparkContext.broadcast(ranks.id.to_numpy("<u4"))
    stored = spark.read.parquet(f"{path}/blocks")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                n = np.frombuffer(r.lengths, "<i8")
                ids = id_of.value[decode_ranks(r.image)].tobytes()
                at = np.concatenate([[0], np.cumsum(n)])
                ids = [ids[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                doc = pd.Series(np.frombuffer(r.docs, "<i8")).astype("Int64").where(pd.Series(np.frombuffer(r.has_id, bool)))
                yield pd.DataFrame({"doc_id": doc, "start": earlier[r.part] + r.before + at[:-1], "n_tokens": n, "ids": ids})

    # ids before a block: those before it in its part, which it holds itself, and those of earlier parts; a row per part, which are as many as shuffle partitions
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": pdf.part, "n": [int(np.frombuffer(x, "<i8").sum()) for x in pdf.lengths]})

    parts = stored.select("part", "lengths").mapInPandas(sums, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")
    earlier = dict(zip(parts.part.tolist(), (parts.n.cumsum() - parts.n).tolist(), strict=True))
    return stored.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_ids(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


