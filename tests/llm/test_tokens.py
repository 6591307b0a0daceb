"""Packing, id files and byte-level BPE against the libraries and by round trip."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from cohera.llm import bytebpe, encoders, idfile, packing
from tokenizers import Tokenizer

TEXTS = ["", None, "The cat, the DOG's hat.\nNew line", "  two  spaces ", "naïve Ünïcode 漢字 😀 İΣς", "don't 'tis ''s\n\n\nx", "<|endoftext|> a", "x <|endoftext|> y", "a<|startoftext|>B  <|ENDOFTEXT|>", "word " * 3000, "x" * 5000, "\n", " lead", "tail \n", "a　b\u0085c\x1cd"]


def frame(spark, texts=TEXTS):
    rows = [(k, t, "clash", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row_hash string, part long")


def library(name, text):
    return Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("kind", "name"), [(encoders.ByteLevel, "byte_bpe_50k.json"), (encoders.WordLevel, "word_bpe_49k.json")])
def test_cached_encoder_equals_library(kind, name):
    r = random.Random(3)
    signs = "ab é'sß\n\t  \u0085　\x1c\x01.,!12Σς́漢٣😀İ'll"
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    plain = Tokenizer.from_file(P.path(name))
    for markers in (True, False):
        plain.encode_special_tokens = not markers
        enc = kind(P.path(name), markers)
        for _ in range(2):
            ids, sizes = enc.encode(pa.array(texts))
            got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
            assert got == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_markers_are_their_own_ids():
    assert library("byte_bpe_50k.json", "x <|endoftext|> y") == [87, 220, 50256, 331]
    ids, _ = encoders.ByteLevel(P.path("byte_bpe_50k.json")).encode(pa.array(["x <|endoftext|> y"]))
    assert ids.tolist() == [87, 220, 50256, 331]


def test_best_fit_decreasing_against_plain_search():
    r = np.random.default_rng(1)
    for size in (7, 64, 100):
        lengths = r.integers(1, size + 1, 300)
        window, offset = packing.best_fit_decreasing(lengths, size)
        rooms: list[int] = []
        for k in np.argsort(-lengths, kind="stable"):
            fits = [x for x in rooms if x >= lengths[k]]
            if fits:
                rooms[rooms.index(min(fits))] -= lengths[k]
            else:
                rooms.append(size - lengths[k])
        used = np.bincount(window, weights=lengths)
        assert sorted(size - used) == sorted(rooms)
        for w in range(len(used)):
            at = sorted((offset[k], lengths[k]) for k in np.flatnonzero(window == w))
            assert [a for a, _ in at] == np.cumsum([0, *[n for _, n in at]])[:-1].tolist()


def test_packing_whole(spark):
    rows = packing.pack_documents(frame(spark, [*TEXTS, "word"])).collect()
    for doc, text in enumerate([*TEXTS, "word"]):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()
        assert ids == [*library("byte_bpe_50k.json", text), 0]
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert {r.doc_tokens for r in own} == {len(ids)}
    for s in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert sum(r.length for r in own) <= 1024
    assert packing.pack_documents(frame(spark).limit(0)).count() == 0


def test_packing_of_tiny_partitions(spark):
    """A document a load, a load a partition: what is left of each is packed again."""
    texts = ["word " * (1 + 37 * k % 700) for k in range(120)] + ["", None]
    few = packing.pack_documents(frame(spark, texts).repartition(1), digest=True).collect()
    many = packing.pack_documents(frame(spark, texts).repartition(200, "doc_id"), digest=True).collect()
    piece = lambda r: (r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32)
    assert sorted(map(piece, few)) == sorted(map(piece, many))
    for rows in (few, many, packing.pack_documents(frame(spark, texts).repartition(200, "doc_id"), digest=True, rest=20_000).collect()):
        windows = {}
        for r in rows:
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in windows.values():
            parts.sort()
            assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            assert sum(n for _, n in parts) <= packing.WINDOW
        total = sum(r.length for r in rows)
        assert len(windows) <= 1.03 * total / packing.WINDOW + 3


def test_null_and_repeated_ids_pack(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, None)], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 1), (False, 1), (True, 3), (True, 3)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_block_round_trip():
    r = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (1, 255, 256, 70_000, 1 << 26):
            x = r.integers(0, top, n).astype("<u4")
            assert (idfile.decode_ranks(idfile.encode_ranks(x)) == x).all()
    with pytest.raises(ValueError, match="cut short"):
        idfile.decode_ranks(idfile.encode_ranks(np.arange(9, dtype="<u4"))[:-1])


def test_id_files(spark, tmp_path):
    idfile.write_ids(frame(spark).union(frame(spark).selectExpr("null", "'zz zz'", "row_hash", "part").limit(1)), str(tmp_path / "x"))
    rows = idfile.read_ids(spark, str(tmp_path / "x")).collect()
    assert len(rows) == len(TEXTS) + 1
    at = 0
    for r in sorted(rows, key=lambda r: (-1 if r.doc_id is None else r.doc_id)):
        want = [*library("word_bpe_49k.json", "zz zz" if r.doc_id is None else TEXTS[r.doc_id]), 2]
        assert (r.start, r.n_tokens) == (at, len(want))
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    idfile.write_ids(frame(spark).limit(0), str(tmp_path / "y"))
    assert idfile.read_ids(spark, str(tmp_path / "y")).count() == 0


def test_byte_bpe_equals_tiktoken(spark):
    e = bytebpe.Encoder(P.path("byte_bpe_50k.tiktoken"))
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    r = random.Random(2)
    signs = "ab é's'tt'r'ev'el'lldmS\n\t  \u0085　.,!12Σς́漢٣😀ſ"
    texts = [x or "" for x in TEXTS] + ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    got = e.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode_ordinary(x) for x in texts]
    assert [e.decode(x).decode() for x in got] == texts
    for x, text in zip(got[:40], texts, strict=False):
        assert e.offsets(x)[-1] == len(text.encode())
    rows = bytebpe.encode_documents(frame(spark)).withColumn("d", bytebpe.decoded()).collect()
    assert all(bytes(x.d).decode() == (TEXTS[x.doc_id] or "") for x in rows)


def test_letters_are_encoded_once_whatever_marks_follow():
    enc = encoders.WordLevel(P.path("word_bpe_49k.json"))
    texts = ["Mère mère, mère. (mère) ÉTÉ été! été!! Ωμέγας, ΟΔΟΣ. İx, ẋ straße, STRASSE; don't don't, 12 12, a b,", "mère?! été,,,, quatre, quatre", "quatre. <|endoftext|>, Åx, été, Été. ſs, ǅx,", ""]
    model, calls = enc._model, []
    enc._model = lambda letters, lead="": calls.append(letters) or model(letters, lead)
    for _ in range(2):
        ids, sizes = enc.encode(pa.array(texts))
        ends = sizes.cumsum()
        assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert calls.count("mère") == 1 and calls.count("quatre") == 1 and calls.count("été") == 1 and calls.count(",") == 1
