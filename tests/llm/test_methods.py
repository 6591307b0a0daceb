"""The other operators against plain versions."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from cohera.llm import common, graphs, jaccard, lines, mpegts, phrases, pii, quality, topk
from pyspark.sql import functions as F

R = random.Random(4)
VOCAB = [f"w{k}" for k in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def corpus():
    base, passage = prose(160), prose(70)
    texts = [base, base, None, "", " \n ", "one two", prose(120) + " " + passage + " " + prose(90), passage + "\n" + prose(60), prose(3000) + " " + passage]
    for k in range(12):
        words = base.split()
        for _ in range(k % 4):
            words[R.randrange(len(words))] = f"x{R.randrange(999)}"
        texts.append(" ".join(words))
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "clash", 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n string, `group` int, component string")


@pytest.mark.parametrize("cases", ["texts", "empty"])
def test_jaccard_components(spark, cases):
    texts = corpus() if cases == "texts" else []
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    low = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(frame(spark, texts), 4, 85).collect()}
    assert got == {k: (len(sets[k]), low[k]) for k in range(len(texts))}


def test_jaccard_nulls_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "q r s t u"), (3, "q r s t u")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.jaccard_join(docs, 4, 85).collect())
    assert got == [("3", 3), ("5", 3), ("5", 3), ("None", None)]


def test_jaccard_sets_of_one_id(spark):
    a, b, c = prose(90), prose(90), prose(90)
    docs = spark.createDataFrame([(2, a), (2, b), (2, b), (7, a + " z"), (8, "y " + b), (9, c), (10, c), (11, c + " x")], "doc_id long, text string")
    for bits in (jaccard.MOST_BITS, 0):
        got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_join(docs, 4, 85, most_bits=bits).collect()}
        assert got == {(2, 87): 2, (7, 88): 2, (8, 88): 2, (9, 87): 9, (10, 87): 9, (11, 88): 9}


def test_jaccard_many_near_copies(spark):
    r = random.Random(12)
    base = [prose(200, r) for _ in range(3)]
    texts = []
    for k in range(150):
        words = base[k % 3].split()
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(200)] = f"q{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [set(zip(*[t.split()[i:] for i in range(4)])) for t in texts]
    low = list(range(150))
    for _ in range(6):
        for a in range(150):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_join(frame(spark, texts), 4, 85).collect()}
    assert got == dict(enumerate(low))
    whole = np.array([7, 1 << 20, (1 << 63) + (5 << 16)], np.uint64)
    assert (jaccard.unpacked(jaccard.packed(whole).ravel()) == whole >> np.uint64(16)).all()


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(40, 41), (41, 41)], "a long, b long")
    got = {r.node: r.component for r in graphs.components(edges).collect()}
    assert got == dict.fromkeys(range(21), 0) | {40: 40, 41: 40}


def test_repeats_removed(spark):
    texts = [*corpus(), "again again " * 60, "again again " * 60]
    docs = frame(spark, texts).union(spark.createDataFrame([(None, texts[0], "", 1, "")], "doc_id long, text string, n string, g int, c string"))
    got = {r.doc_id: r for r in phrases.remove_repeats(docs, group_bytes=5000).collect()}
    joined = {r.doc_id: r for r in phrases.remove_repeats(docs, group_bytes=5000, most_bits=0).collect()}  # lists of anchors instead of a bit map
    assert joined == got
    seen = set()
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        gone = [any(windows[i] in seen for i in range(max(0, j - 49), min(j + 1, len(windows)))) for j in range(len(w))]
        seen |= set(windows)
        assert (got[k].n_words, got[k].n_removed, got[k].kept) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert got[None].n_removed == 0
    assert phrases.remove_repeats(docs.limit(0)).count() == 0


def plain_line_dedup(texts):
    chunks = []
    for t in texts:
        own, at = (t or "").split("\n"), 0
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in own]
        out = []
        for i in range(len(own)):
            if i == len(own) - 1 or (i >= 1 and (h[i] + 31 * h[i - 1]) % 3 == 0):
                out.append(own[at : i + 1])
                at = i + 1
        chunks.append(out)
    seen, result = set(), []
    for c in chunks:
        kept = []
        for x in c:
            body = "\n".join(x)
            if len(x) > 1 and body.replace("\n", "").strip(" "):
                if body in seen:
                    continue
                seen.add(body)
            kept += x
        result.append("\n".join(kept))
    return result


def test_line_dedup(spark):
    block = [prose(4) for _ in range(30)]
    texts = ["\n".join(block), "\n".join([prose(3), *block]), None, "", "\n\n\n\n", "\n".join(block[5:25] + [prose(2)]), "\n".join([prose(5) for _ in range(9)] * 2), "a\nb\n"]
    docs = spark.createDataFrame([(k, t, "c", 5) for k, t in enumerate(texts)], "doc_id long, text string, _id string, n_lines int")
    got = {r.doc_id: r for r in lines.dedup_lines(docs, count_cols=True).collect()}
    assert [got[k].text or "" for k in range(len(texts))] == plain_line_dedup(texts)
    assert got[2].text is None
    assert got[1].n_removed > 0
    assert lines.dedup_lines(docs.limit(0)).columns == docs.columns
    twice = spark.createDataFrame([(None, "a\nb\nc\nd"), (None, "a\nb\nc\nd"), (1, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted(len(r.text) for r in lines.dedup_lines(twice).collect())[1:] == [7, 7]


def test_hot_and_long_lines(spark):
    block = "\n".join(prose(4) for _ in range(12))
    texts = [prose(3) + "\n" + block + "\n" + prose(3) for _ in range(200)] + ["\n".join(f"{k} of many" for k in range(30_000)), "y" * 300_000 + "\n" + "y" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in lines.dedup_lines(docs).orderBy("doc_id").collect()]
    assert got == plain_line_dedup(texts)
    left = spark.createDataFrame([(k % 3 and 7, k) for k in range(999)] + [(9, 1)], "k int, v int")
    right = spark.createDataFrame([(0, 333, "a"), (7, 666, "b"), (9, 1, "c")], "k int, n int, name string")
    joined = common.join_salted(left, right, ["k"], "n", ["v"], 1000)
    assert sorted((r.k, r.v, r.name) for r in joined.collect()) == sorted((r.k, r.v, {0: "a", 7: "b", 9: "c"}[r.k]) for r in left.collect())
    assert [r.text for r in lines.dedup_lines(docs.limit(0)).collect()] == []


def test_transport_stream(spark):
    for n in (0, 1, 575, 576, 577, 20_000):
        data = R.randbytes(n)
        packets, faults = mpegts.demux(mpegts.mux(mpegts.padded(data)))
        assert b"".join(p["payload"] for p in packets) == mpegts.padded(data)
        assert faults == 0
        assert [p["pts"] for p in packets] == [mpegts.TICKS * k for k in range(len(packets))]
        assert [p["random_access"] for p in packets] == [k % mpegts.GROUP == 0 for k in range(len(packets))]
    media = mpegts.mux(bytes(576 * 9))
    assert mpegts.demux(media[: 188 * 5] + media[188 * 6 :])[1] > 0
    assert mpegts.demux(b"junk") == ([], 1)
    stored = mpegts.store_text(frame(spark, corpus()))
    assert mpegts.elementary_packets(stored).where("number = 0").count() == len(corpus())
    for r in mpegts.summarise(stored).collect():
        assert r.payload_bytes % 576 == 0
        assert r.payload_bytes >= max(576, r.n_bytes)


def packet(pid, counter, data, begins=False, adapt=b""):
    room = 184 - len(data)
    if room or adapt:
        field = adapt or b"\0"
        adapt = bytes([room - 1]) + (field + b"\xff" * (room - 1 - len(field)) if room > 1 else b"")
    return bytes([0x47, (0x40 if begins else 0) | pid >> 8, pid & 255, (0x30 if adapt else 0x10) | counter & 15]) + adapt + data


def test_tables_over_several_packets():
    pmt = mpegts._section(2, 1, bytes([0xE1, 0, 0xF0, 0]) + b"".join(bytes([6, 0xE1, k, 0xF0, 0]) for k in range(60)))
    assert len(pmt) > 184
    pes = b"\0\0\1\xbd" + (3 + 100).to_bytes(2, "big") + b"\x80\0\0" + bytes(100)
    parts = [mpegts.PAT, packet(0x1000, 0, b"\0" + pmt[:183], True), packet(0x1000, 1, pmt[183:]), packet(0x103, 0, pes, True)]
    packets, faults = mpegts.demux(b"".join(map(bytes, parts)))
    assert (faults, [(p["pid"], p["payload"], p["damaged"]) for p in packets]) == (0, [(0x103, bytes(100), False)])
    packets, faults = mpegts.demux(b"".join(map(bytes, [parts[0], parts[1], parts[3]])))
    assert (packets, faults) == ([], 1)


def test_losses_and_announced_jumps():
    media = bytearray(mpegts.mux(bytes(576 * 3)))
    n = len(media) // 188
    packets, faults = mpegts.demux(bytes(media[: 188 * 3]) + bytes(media[188 * 4 :]))
    assert (faults, [p["damaged"] for p in packets]) == (2, [True, False, False])
    media[188 * 3 + 1] |= 0x80  # the same packet, marked as broken
    packets, faults = mpegts.demux(bytes(media))
    assert (faults, [p["damaged"] for p in packets]) == (3, [True, False, False])
    assert n == 2 + 3 * 4
    unit = b"\0\0\1\xbd" + (3 + 20).to_bytes(2, "big") + b"\x80\0\0" + bytes(20)
    padding = b"\0\0\1\xbe" + (20).to_bytes(2, "big") + b"\xff" * 20
    bare = b"\0\0\1\xbf" + (20).to_bytes(2, "big") + b"z" * 20
    tables = bytes(mpegts.PAT) + bytes(mpegts.PMT)
    jump = packet(0x100, 9, unit, True, b"\x80")
    packets, faults = mpegts.demux(tables + packet(0x100, 0, unit, True) + jump + packet(0x100, 10, padding, True) + packet(0x100, 11, bare, True))
    assert (faults, [p["payload"] for p in packets]) == (0, [bytes(20), bytes(20), b"z" * 20])


def test_media_query(spark, tmp_path):
    texts = [*corpus(), "x" * 575, "x" * 576, "é" * 400]
    docs = frame(spark, [*texts, texts[0]])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in mpegts.op2_media(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) + 1
    for k, t in enumerate([*texts, texts[0]]):
        raw = (t or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r, units = rows[k], len(padded) // 576
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        media = mpegts.mux(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        times, mean = f"0-{3600 * (units - 1)}", sum(padded) / len(padded)
        assert r.feature == f"streams=256:6;packets={units};faults=0;pts={times};points={','.join(str(3600 * u) for u in range(0, units, 8))};mean_byte={mean:.4f}"
    assert rows[0].feature == rows[len(texts)].feature
    assert mpegts.summarise(mpegts.store_text(docs.limit(0))).count() == 0


def test_threshold_search(spark):
    r = np.random.default_rng(1)
    v = r.integers(-3, 4, (300, 5)).astype(np.int64)
    ids = np.arange(300)
    lists = topk.Lists(ids, v)
    got = [x for q in range(0, 300, 50) for x in lists.top(v[q], q, 5, first_depth=2)]
    want = []
    for q in range(0, 300, 50):
        s = v @ v[q]
        want += [(q, k, int(s[k])) for k in sorted((k for k in range(300) if k != q), key=lambda k: (-s[k], k))[:5]]
    assert got == want
    rows = [(int(k), [float(x) / 256 for x in row], "c") for k, row in zip(ids, v, strict=True)] + [(1000, None, ""), (1001, [1.0, None, 1.0, 1.0, 1.0], ""), (1002, [float("nan")] * 5, ""), (None, [1.0] * 5, "")]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("vec_id") % 50 == 0, block_rows=64)
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in out.collect()) == sorted((q, 1 + k % 5, i, s) for k, (q, i, s) in enumerate(want))


def test_base_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(20_000):
        x = "".join(R.choice("a1.@-+ 2é") for _ in range(R.randint(0, 25)))
        assert [m.span() for m in email.finditer(x)] == list(pii._emails(x))
        assert [m.span() for m in ip.finditer(x)] == [m.span() for m in pii.IP.finditer(x)]
    assert pii.show(pii.base_spans("é a@b.cc 1.2.3.4 1.2.3.999, 4111 1111 1111 1111 +1 (555) 123-4567")) == "email:2:8,ip:9:16,card:28:47,phone:48:65"


def test_threshold_search_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [9.0, inf]), (4, [nan, 1.0]), (5, [1.0, None]), (6, []), (50, []), (7, [1.0, 1.0, 1.0]), (100, [-1.0, 0.0]), (None, [1.0, 1.0]), (8, None)]
    docs = spark.createDataFrame([(a, b, "c", 1) for a, b in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(docs, F.col("vec_id") % 50 == 0, k=3, block_rows=4).collect())
    unit = 256 * 256
    assert got == [(0, 1, 1, unit * 3 // 2), (0, 2, 2, unit * 3 // 2), (0, 3, 2, unit * 3 // 2), (50, 1, 6, 0), (100, 1, 1, -unit // 2), (100, 2, 2, -unit // 2), (100, 3, 2, -unit // 2)]
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [1e18, 5.0]), (3, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    top = 2**63 - 1
    assert sorted((x.rank, x.vec_id, x.score) for x in topk.top_k(huge, F.col("vec_id") == 0).collect()) == [(1, 1, top), (2, 2, top), (3, 3, -top - 1)]
    assert topk.top_k(docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def personal(k, r):
    number, local = f"+1 555 {r.randrange(100, 999)} {r.randrange(1000, 9999)}", f"{r.choice(VOCAB)}.{r.randrange(99)}"
    return [f"call {number} soon", f"mail {local}@home{k}.org", f"order 00{r.randrange(10**8, 10**9)} came"][k % 3] + " " + prose(30, r)


def test_skip_links_carry_labels(spark):
    r = random.Random(5)
    theta = pii.learn([g for k in range(200) if (g := pii.example(personal(k, r)))])
    assert all((theta["skip"][k, k] > 1) for k in (1, 4))
    idle = theta | {"skip": np.zeros_like(theta["skip"])}
    for k in range(30):
        text = personal(k, r)
        base = pii.base_spans(text)
        far = text + " " + prose(200, r) + " again 5550001111 and other@home "
        for a, kind, b in base:
            word = pii._mention(kind, text[a:b])
            whole = far + word
            span = (len(far), kind, len(whole))
            assert pii.all_spans(whole, theta) == (pii.base_spans(whole), sorted([*pii.base_spans(whole), span]))
            assert pii.all_spans(whole, idle)[1] == pii.base_spans(whole)
            assert pii.all_spans(f'{{"id":"{"z" * 600}","at":"{word}"}} ' + text, theta)[1][0][1] == kind  # in a token of any length
        assert pii.all_spans(far, theta)[1] == base  # no link, no span
    base, every = pii.all_spans(personal(0, r) + " 5551234567", pii.unlearnt())
    assert base == every


def test_links_and_overlaps():
    keys, labels = [["a"], ["b"], ["a"], ["a"], ["b"], ["a"]], [-1, 2, -1, 1, -1, -1]
    assert pii._links(keys, labels) == [(0, 2), (0, 3), (1, 4), (2, 3), (3, 5)]
    r = random.Random(8)
    for _ in range(300):
        taken = sorted((a, a + r.randrange(1, 9)) for a in r.choices(range(60), k=6))
        spans = [(a, a + r.randrange(1, 4)) for a in range(0, 60, 5)]
        assert pii._apart(spans, taken) == [(a, b) for a, b in spans if not any(x < b and a < y for x, y in taken)]


def test_many_spans_take_linear_time():
    r = random.Random(5)
    theta = pii.learn([g for k in range(60) if (g := pii.example(personal(k, r)))])
    took = []
    for n in (5000, 20_000):
        text = " ".join(f"+1 555 01{k % 90:02d} {k:04d} 99 2 33333 1" for k in range(n))
        began = time.process_time()
        pii.all_spans(text, theta)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


def plain_base(text):
    """The contract's patterns as they are written, with their checks."""
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                twice = [sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))]
                if not 14 <= len(d) <= 19 or sum(twice) % 10:
                    continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_plain_version():
    r = random.Random(6)
    for _ in range(15_000):
        x = "".join(r.choice(["4111 1111 1111 1111", "+1 (555) 12", "7", "0", "1.2", ".3", "9.8.7.6", "256", " ", "-", "+", "a@b", ".c", "é", "(", ") ", "55555555"]) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(x) == plain_base(x)


def test_personal_data_tables(spark):
    r = random.Random(5)
    texts = [personal(k, r) for k in range(60)] + [None, "", "plain", prose(30_000, r) + " +1 (555) 123-4567 " + prose(30_000, r)]
    docs = frame(spark, [*texts, texts[0]])
    theta = pii.fit(docs)
    assert theta["skip"].any()
    rows = {x.doc_id: x for x in pii.find(docs, theta).collect()}
    for k, t in enumerate([*texts, texts[0]]):
        base, every = pii.all_spans(t or "", theta)
        assert base == plain_base(t or "")
        assert (rows[k].base, rows[k].spans) == (pii.show(base), pii.show(every))
        assert [rows[k][f"n_{x}"] for x in pii.KINDS] == [sum(i == j for _, j, _ in base) for i in range(4)]
    hidden = [x.text for x in pii.mask(frame(spark, ["mail x@y.zz now", None, "", "plain"]), theta).orderBy("doc_id").collect()]
    assert hidden == ["mail <EMAIL> now", None, "", "plain"]
    assert pii.find(docs.limit(0), theta).count() == 0
    assert not pii.fit(docs.limit(0))["w"].any()


def test_quality_learns(spark):
    texts = [prose(100) if k % 2 else " ".join(w.upper() + "!!" for w in prose(100).split()) for k in range(120)]
    docs = frame(spark, [*texts, None, "", "x" * 50_000])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(200, 1), (61, None)], "doc_id long, quality int")
    rows = quality.scored(docs, quality.fit(docs, labels)).orderBy("doc_id").collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in rows[60:120])
    assert all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(docs, quality.fit(docs, labels.limit(0))).where("score = 0.5").count() == 123


def test_quality_learns_from_every_passage(spark):
    bad = " ".join(w.upper() + "!!" for w in prose(80).split())
    texts = [prose(3000) + " " + bad * (k % 2) + " " + prose(6000) for k in range(60)]  # what the label is about is a few passages among some 140
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, quality int")
    rows = quality.sample(docs, labels, "doc_id", "text", "quality", 6000, 10**9).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(k, texts[k]) for k in range(40)]
    got = quality.scored(docs, quality.fit(docs, labels)).orderBy("doc_id").collect()
    assert sum((r.score < 0.5) == bool(r.doc_id % 2) for r in got[40:]) >= 18
    assert len(quality.sample(docs, labels, "doc_id", "text", "quality", 6000, 5 * len(texts[0])).collect()) in (3, 4, 5)


def test_quality_hard_rows(spark):
    docs = spark.createDataFrame([(1, "one two", 7.0), (1, "one two", 7.0), (1, "other", 8.0), (None, None, 9.0), (2, None, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (4, 0), (4, 1)], "doc_id long, quality int")
    rows = quality.sample(docs, labels, "doc_id", "text", "quality", 100, 1000).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in rows) == [(1, "one two", 1), (1, "other", 1), (2, "", 0)]
    model = quality.fit(docs, labels)
    got = quality.scored(docs, model)
    assert got.columns == docs.columns
    assert len({r.score for r in got.where("text = 'one two'").collect()}) == 1
    assert quality.scored(docs.limit(0), model).count() == 0
    assert quality.fit(docs.limit(0), labels) == {"constant": 0.5}
    assert quality.classes()[ord("漢")] == quality.classes()[ord("あ")] != quality.classes()[ord("😀")]
