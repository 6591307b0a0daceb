"""Null and repeated ids, empty tables and very long texts in op5, op6 and op8, against the libraries and a plain search."""

import random
import zlib

import public_tokenizers
import tiktoken
from cohera.llm import bytebpe, idfile, phrases
from test_registered_queries import crc
from tokenizers import Tokenizer

LONG = " ".join(random.Random(1).choice(["alpha", "βήτα", "3.14", "don't", "\n\n", "x" * 900, "終わり", "🙂🙂"]) for _ in range(20_000))
ROWS = [(5, "twice the same"), (5, "twice the same"), (5, "another text of one id"), (None, "no id"), (None, None), (7, None), (8, ""), (9, LONG), (10, " " * 5000), (11, "a" * 20_000)]


def documents(spark, rows):
    """Extra columns bear names that the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, kept string").repartition(3)


def _library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def test_byte_bpe(spark):
    tok = _library()
    coded = bytebpe.encode_documents(documents(spark, ROWS)).withColumn("decoded", bytebpe.decoded())
    got = _sorted((r.doc_id, zlib.crc32(bytes(r.ids)), len(r.ids), bytes(r.decoded)) for r in coded.collect())
    ids = [(k, tok.encode_ordinary(t or ""), (t or "").encode()) for k, t in ROWS]
    assert got == _sorted((k, crc(i), 4 * len(i), b) for k, i, b in ids)
    assert bytebpe.encode_documents(documents(spark, ROWS).where("false")).count() == 0


def test_id_file(spark, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    idfile.write_ids(documents(spark, ROWS), str(tmp_path / "ids"))
    rows = sorted(idfile.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    want = [(k, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in ROWS]
    assert _sorted((r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rows) == _sorted((k, len(i), crc(i)) for k, i in want)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and at == sum(len(i) for _, i in want)


def test_substrings(spark):
    r = random.Random(2)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, other = words(70), words(50)
    rows = [(3, words(10) + passage), (4, words(20_000) + passage + words(5) + passage[:55] + words(20_000) + other), (6, other + words(3)), (6, other + words(4)), (6, passage + passage), (None, passage), (8, None), (9, []), (10, words(49))]
    first = {}
    for k, t in rows:
        for i in range(len(t or []) - 49) if k is not None else ():
            w = tuple(t[i : i + 50])
            first[w] = min(first.get(w, k), k)
    want = []
    for k, t in rows:
        t = t or []
        gone = [False] * len(t)
        for i in range(len(t) - 49) if k is not None else ():
            if first[tuple(t[i : i + 50])] < k:
                gone[i : i + 50] = [True] * 50
        want.append((k, len(t), sum(gone), " ".join(w for w, g in zip(t, gone, strict=True) if not g)))
    docs = documents(spark, [(k, None if t is None else " ".join(t)) for k, t in rows])
    got = phrases.remove_repeats(docs)
    assert _sorted((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got.collect()) == _sorted(want)
    assert sum(w[2] for w in want) == 70 + 55 + 2 * 50 + 140
    assert phrases.remove_repeats(docs.where("false")).count() == 0
