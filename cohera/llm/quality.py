"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words. Every passage is encoded: how often each pair of neighbouring character
classes occurs, how many words are distinct or repeat one just before, how long words are. A learnt layer turns that into a
vector; gated attention weighs the passages (tanh and sigmoid branches, softmax over the document's passages); a logistic
unit scores the weighted sum. Labels stand for documents alone; the attention learns which passages they are about.

Learning takes all passages of a sample of labelled documents, those with the least hashes of id and text: at most MOST_LABELLED of them and
at most MOST_CHARACTERS in all (both are parameters), on the driver, in memory that this bounds. Scores are made for every whole text by tasks.

Rules: null and empty texts are one empty passage and get a score; null labels teach nothing, nor do those of a doc_id whose labels
differ; rows equal in doc_id and text teach once; without labels of both kinds every score is the labels' mean (0.5 without
any); rows are independent, so repeated rows get equal scores; a column of the score's name is replaced, others are carried; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_characters, crc32_text, picked, table, tune

WORDS = 64
MOST_LABELLED, MOST_CHARACTERS = 6000, 30_000_000  # of the sample to learn from
BATCH = 150_000  # characters that are encoded at once
HIDDEN, GATES, EPOCHS, RATE = 24, 12, 16, 0.01
# character classes: space, line end, lower, upper, other letter, digit, stop, bar, quote, other sign
N_CLASSES = 10
FEATURES = N_CLASSES * N_CLASSES + 7


def _class(c: int) -> int:
    s = chr(c)
    if s == "\n":
        return 1
    if s.isspace():
        return 0
    kind = unicodedata.category(s)
    if kind[0] == "L":
        return {"Ll": 2, "Lu": 3}.get(kind, 4)
    return 5 if kind[0] == "N" else 6 if s in ".,;:" else 7 if s in "|<>{}=/\\" else 8 if s in "\"'()-?" else 9


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    return np.array([_class(c) for c in range(sys.maxunicode + 1)], np.uint8)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of its text."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))
    cls = classes()[points].astype(np.int64)
    black = cls > 1
    begins = black & ~np.append(False, black[:-1])
    begins[np.append(0, ends[:-1])] |= black[np.append(0, ends[:-1])]
    at = np.flatnonzero(begins)
    word_doc = doc[at]
    first = np.searchsorted(word_doc, np.arange(len(texts)))
    in_doc = np.arange(len(at)) - first[word_doc]
    n_words = np.bincount(word_doc, minlength=len(texts))
    n_passages = np.maximum(1, -(-n_words // WORDS))
    base = np.cumsum(n_passages) - n_passages
    word_passage = base[word_doc] + in_doc // WORDS
    # a character belongs to the passage of the last word that began in its document
    seen = np.cumsum(begins) - 1
    own = np.where(seen >= 0, np.maximum(seen, 0), 0)
    char_passage = base[doc] if not len(at) else np.where((seen >= 0) & (word_doc[own] == doc), word_passage[own], base[doc])
    total = int(n_passages.sum())
    inner = np.append(doc[1:] == doc[:-1], False)
    pair = cls * N_CLASSES + np.append(cls[1:], 0)
    counts = np.bincount((char_passage * N_CLASSES**2 + pair)[inner], minlength=total * N_CLASSES**2).reshape(total, -1).astype(np.float32)
    chars = counts.sum(axis=1, keepdims=True)
    out = np.zeros((total, FEATURES), np.float32)
    out[:, : N_CLASSES**2] = np.sqrt(counts / np.maximum(chars, 1))
    n = np.bincount(word_passage, minlength=total).astype(np.float32)
    some = np.maximum(n, 1)
    if len(at):
        place = np.arange(len(points), dtype=np.uint64) - at[own].astype(np.uint64)  # in its word
        spread = (points.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
        spread = (spread ^ spread >> np.uint64(29)) * (np.uint64(2) * place + np.uint64(1))
        spread[~black] = 0
        word = np.add.reduceat(spread, at)
        size = np.add.reduceat(black.astype(np.int64), at)
        again = [np.append(np.zeros(k, bool), (word[k:] == word[:-k]) & (word_doc[k:] == word_doc[:-k]))[: len(word)] for k in (1, 2)]
        key = np.sort(word_passage.astype(np.uint64) << np.uint64(40) | word >> np.uint64(24))
        distinct = np.bincount((key[np.append(True, key[1:] != key[:-1])] >> np.uint64(40)).astype(np.int64), minlength=total)
        mean = lambda v: np.bincount(word_passage, weights=v, minlength=total) / some
        length = mean(size)
        out[:, -7] = distinct / some
        out[:, -6], out[:, -5] = mean(again[0]), mean(again[1])
        out[:, -4], out[:, -3] = length / 8, np.sqrt(np.maximum(mean(size.astype(float) ** 2) - length**2, 0)) / 8
        out[:, -2] = mean(size <= 3)
    out[:, -1] = n / WORDS
    return out, np.repeat(np.arange(len(texts)), n_passages)


def constant(score: float) -> dict:
    return {"constant": float(score)}


def forward(model: dict, x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of the documents 0, 1, ... whose passages lie together in x."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    h = np.tanh((x - model["mean"]) / model["sd"] @ model["enc"] + model["enc_b"])
    t, g = np.tanh(h @ model["v"]), 1 / (1 + np.exp(-(h @ model["u"])))
    e = (t * g) @ model["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[doc])
    a = e / np.add.reduceat(e, first)[doc]
    z = np.add.reduceat(a[:, None] * h, first)
    return 1 / (1 + np.exp(-(z @ model["out"] + model["out_b"]))), (first, h, t, g, a, z)


def learn(x: np.ndarray, doc: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """Gradient descent (Adam) on the log loss, by batches of documents."""
    if not len(y) or y.min() == y.max():
        return constant(y.mean() if len(y) else 0.5)
    r = np.random.default_rng(seed)
    p = {"enc": r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "enc_b": np.zeros(HIDDEN), "v": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "u": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "a": r.normal(0, GATES**-0.5, GATES), "out": np.zeros(HIDDEN), "out_b": np.zeros(1)}
    fixed = {"mean": x.mean(axis=0, dtype=np.float64), "sd": x.std(axis=0, dtype=np.float64) + 1e-2}
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    first = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for at in range(0, len(y), 128):
            pick = np.sort(order[at : at + 128])
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in pick])
            d = np.repeat(np.arange(len(pick)), first[pick + 1] - first[pick])
            s, (f, h, t, g, a, z) = forward(p | fixed, x[rows], d)
            ds = (s - y[pick]) / len(pick)
            dz = ds[:, None] * p["out"]
            da = (dz[d] * h).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, f)[d])
            dt, dg = de[:, None] * g * p["a"] * (1 - t * t), de[:, None] * t * p["a"] * g * (1 - g)
            dh = (a[:, None] * dz[d] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
            n = (x[rows] - fixed["mean"]) / fixed["sd"]
            grad = {"out": z.T @ ds, "out_b": ds.sum(keepdims=True), "a": (t * g).T @ de, "v": h.T @ dt, "u": h.T @ dg, "enc": n.T @ dh, "enc_b": dh.sum(axis=0)}
            step += 1
            for k, w in p.items():
                gk = grad[k] + 1e-4 * w
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | fixed


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, characters: int) -> DataFrame:
    """doc_id, text and y of whole labelled documents, in order of a hash, up to both bounds; each (doc_id, text) once."""
    known = picked(labels, doc_id=id_col, y=label_col).where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    texts = picked(docs, doc_id=id_col, text=text_col).where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    texts = texts.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("n", F.length("text"))
    first = texts.select("doc_id", "h", "n").join(known, "doc_id").where(F.col("n") <= characters).select("h", "n").distinct().orderBy("h").limit(most).toPandas()
    fits = first[first.n.cumsum() <= characters]
    chosen = docs.sparkSession.createDataFrame(fits[["h"]], "h long") if len(fits) else docs.sparkSession.createDataFrame([], "h long")
    rows = texts.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["doc_id", "h"])  # no more than `most` keys
    return rows.join(known, "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED, characters: int = MOST_CHARACTERS) -> dict:
    """A model of label_col, learnt from all passages of at most `most` labelled documents of at most `characters` in all."""
    tune(docs.sparkSession)
    rows = sample(docs, labels, id_col, text_col, label_col, most, characters)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in by_characters(pdf.text.tolist(), BATCH):
                p = pdf.iloc[a:b]
                x, doc = passages(p.text.tolist())
                at = np.searchsorted(doc, np.arange(len(p) + 1))
                yield pd.DataFrame({"doc_id": p.doc_id, "y": p.y, "x": [x[i:j].astype("<f4").tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]})

    got = sorted(rows.mapInPandas(encode, "doc_id long, y int, x binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    if not got:
        return constant(0.5)
    bags = [np.frombuffer(bytes(r.x), "<f4").reshape(-1, FEATURES) for r in got]
    return learn(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([float(r.y > 0) for r in got]))


def score_of(text: Column, model: dict) -> Column:
    """The score, between 0 and 1, of a whole text."""
    model = {k: w if k == "constant" else w.astype(np.float32) for k, w in model.items()}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if "constant" in model:
            return pd.Series(np.full(len(texts), model["constant"]))
        whole = [t or "" for t in texts]
        parts = [forward(model, *passages(whole[a:b]))[0] for a, b in by_characters(whole, BATCH)]
        return pd.Series(np.concatenate(parts).astype(np.float64) if parts else np.zeros(0))

    return score(text)


def scored(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The same rows and columns with the score in out_col."""
    tune(docs.sparkSession)
    return docs.withColumn(out_col, score_of(F.col(f"`{text_col}`"), model))


def held_out(doc_id):
    return crc32_text(doc_id) % 3 == 1


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
