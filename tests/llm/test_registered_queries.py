"""The registered queries themselves over the smallest tables, whole results against the libraries and plain programs."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cohera.llm.queries import QUERIES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op3_scores_every_document(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, SF).collect()}
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op4_packs_every_id_once(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: [*tok.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    of, windows = {}, {}
    for r in QUERIES["op4_packing"](spark, SF).collect():
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        of.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, total in [*((of[k], len(v)) for k, v in ids.items()), *((w, None) for w in windows.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= 1024
    assert len(of) == len(ids) and sum(map(len, ids.values())) > 0.9 * 1024 * len(windows)


def test_op5_reads_back_what_the_library_gives(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for k in sorted(texts):
        ids = [*tok.encode(texts[k], add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_ids"](spark, SF).collect()) == want


def test_op6_encodes_as_the_library_does(spark, texts):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    enc = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for k, t in texts.items():
        ids = enc.encode_ordinary(t)
        want.add((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op6_byte_bpe"](spark, SF).collect()} == want


def test_op8_removes_every_later_window(spark, texts):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t) for k, t in texts.items()}
    first = {}
    for k in sorted(words):
        for a in range(len(words[k]) - 49):
            first.setdefault(tuple(words[k][a : a + 50]), k)
    want = set()
    for k, w in words.items():
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < k:
                gone[a : a + 50] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.add((k, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substrings"](spark, SF).collect()} == want


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def test_op9_base_spans(spark, texts):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    got = {r.doc_id: r for r in QUERIES["op9_pii"](spark, SF).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        spans = [(m.start(), n, m.end(), kind) for n, (kind, (p, fine)) in enumerate(kinds.items()) for m in re.finditer(p, t) if fine(m.group())]
        base = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in sorted(spans))
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), k
        assert [got[k][f"n_{kind}"] for kind in kinds] == [sum(s[3] == kind for s in spans) for kind in kinds]
        assert set(filter(None, base.split(","))) <= set((got[k].spans or "").split(","))
