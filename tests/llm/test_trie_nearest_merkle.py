"""Operators 11 to 13 against plain programs, on hard rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from cohera.llm import merkle, nearest, trie
from pyspark.sql import functions as F

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---- conversations


def plain_trie(rows):
    """rows: conv, turn, role, text, without ties of equal turns."""
    talk = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        talk.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c in talk:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = talk.get(c - c % 100, [])[:h] + talk[c][h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for node, who in members.items():
        under = [(x, w) for x, w in members.items() if x[: len(node)] == node]
        ends = sorted(c for c in who if len(built[c]) == len(node))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(x) == len(node) + 1 for x, _ in under),
            sum(not any(y[:-1] == x for y, _ in under if y) for x, _ in under), sum((len(w) - 1) * len(x[-1][1]) for x, w in under if x), H(",".join(map(str, ends))),
        ))
    return out


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, node int, digest string, n int")


def rows_of_talks(seed=3, n=60):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        c = r.choice([0, 100, 200]) + r.randrange(40)
        if any(x[0] == c for x in rows):
            continue
        for turn in range(r.randrange(0, 9)):
            rows.append((c, None if turn == 0 and k % 3 else turn, r.choice(["user", None]), r.choice(["a", "bé", "", None, "𝄞cc"])))
    for c in (501, 502, 503, 517):  # copies, longer than any other
        rows += [(c, t, "user", f"turn {t}") for t in range(40)]
    rows += [(530, t, "user", f"turn {t}") for t in range(25)]
    rows += [(607, 0, "user", "x" * 300_000), (None, 0, "user", "nobody")]
    return rows


def test_trie(spark):
    rows = rows_of_talks()
    got = [tuple(r) for r in trie.prefix_trie(*trie.with_shared_heads(trie.numbered(talks(spark, rows)))).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(plain_trie(rows), key=key)
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert trie.prefix_trie(*trie.with_shared_heads(trie.numbered(talks(spark, rows)))).columns == names


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(7, 1, "a", "b")], [(k, 1, "a", "b") for k in range(30)]], ids=["empty", "null id", "one", "equal"])
def test_trie_small(spark, rows):
    got = [tuple(r) for r in trie.prefix_trie(*trie.with_shared_heads(trie.numbered(talks(spark, rows)))).collect()]
    assert sorted(got, key=str) == sorted(plain_trie(rows), key=str)


def test_trie_repeated_rows_and_many_copies(spark):
    rows = [(1000 + k, t, "u", f"{t}") for k in range(60) for t in (1, 1, 2)]  # equal rows are turns of their own
    got = {(r.depth, r.n_convs) for r in trie.prefix_trie(*trie.with_shared_heads(trie.numbered(talks(spark, rows)))).collect() if r.conv_id == 1000}
    assert (0, 60) in got and max(d for d, _ in got) == 3


def test_lists_of_members_over_many_stretches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    ends = spark.range(5000).select(F.lit(3).cast("long").alias("node"), F.lit(2).cast("long").alias("length"), (F.col("id") * 7 % 5000).alias("conv"))
    assert [r.sha for r in trie.hashed_lists(ends).collect()] == [H(",".join(map(str, range(5000))))]


# ---- neighbours


def plain_nearest(rows, is_query, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out, seen = {}, set()
    for q, x in fine:
        if is_query(q) and (q, x.tobytes()) not in seen:
            seen.add((q, x.tobytes()))
            out.setdefault(q, []).extend((-sum(float(a * b) for a, b in zip(x, y, strict=True)), i) for i, y in fine if i != q and len(y) == len(x))
    return sorted((q, r, i, -s) for q, found in out.items() for r, (s, i) in enumerate(sorted(found)[:k], 1))


def vectors(kind):
    r = np.random.default_rng(5)
    if kind == "empty":
        return []
    if kind == "few":
        return [(20, [1.0, 2.0]), (21, [0.5, 0.5]), (40, [0.0, 0.0]), (60, [3.0])]
    rows = [(k, r.normal(size=12).astype(np.float32).tolist()) for k in range(700)]
    if kind == "copies":
        rows = [(k, rows[0][1] if k % 3 else v) for k, v in rows]  # two thirds are one vector
    rows += [(800, None), (801, [1.0, None]), (820, [float("nan")] * 12), (840, [float("inf")] * 12), (860, [0.0] * 12), (None, [1.0] * 12), (880, []), (900, [2.0, 1.0]), (901, [1.0, 1.0])]
    rows += [(20, rows[20][1]), (7, rows[8][1]), (940, [1e30] * 12), (941, [1e-30] * 12)]
    return rows


@pytest.mark.parametrize("kind", ["plain", "copies", "few", "empty"])
@pytest.mark.parametrize("query_bytes", [nearest.QUERY_BYTES, 1000])
def test_nearest(spark, kind, query_bytes):
    rows = vectors(kind)
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, tile int, score double")
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0, 20, query_bytes=query_bytes, group_bytes=20_000)
    got = sorted(tuple(r) for r in got.collect())
    want = plain_nearest([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 20 == 0, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_nearest_of_wide_and_extreme_vectors():
    r = np.random.default_rng(1)
    for v in (r.normal(size=(300, 1500)), r.normal(size=(300, 8)) * 10.0 ** r.integers(-160, 160, size=(300, 1)), np.repeat(r.normal(size=(3, 4)), 100, axis=0)):
        held = nearest.Asked(np.arange(0, 300, 20), v[::20], 20)
        for a in range(0, 300, 64):
            held.meet(np.arange(a, min(300, a + 64)), v[a : a + 64])
        for q, who, _ in held.lists():
            with np.errstate(over="ignore", invalid="ignore"):
                s = np.zeros(300)
                for j in range(v.shape[1]):
                    s += v[q, j] * v[:, j]
            s[np.isnan(s)] = -np.inf
            order = [i for i in np.lexsort((np.arange(300), -s)).tolist() if i != q][:20]
            assert who.tolist() == order


def test_int8_bounds_hold():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(50, 30)), r.normal(size=(60, 30)) * r.lognormal(size=(60, 1))
    x, y = nearest.Codes(a), nearest.Codes(b)
    about = nearest.code_products(x.codes, y.codes) * x.scale[:, None] * y.scale
    off = x.off[:, None] * y.near + x.norm[:, None] * y.off
    assert (np.abs(about - a @ b.T) <= off * (1 + 1e-9)).all() and off.max() < 0.2 * np.abs(a @ b.T).max()
    assert np.abs(x.codes).max() <= 127 and (x.codes == np.rint(x.codes)).all()


# ---- manifest


def plain_manifest(rows):
    """rows: doc_id, text, lang, source, n_chars."""

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(d, text, lang, source, n):
        return H(field(d) + field(source) + field(lang) + field(n) + field(text))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, at):
        for nodes in levels[:-1]:
            yield at % 2, nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
            at //= 2

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for x in langs}
    low = {x: tree([leaf(*r) for r in of[x]]) for x in langs}
    high = tree([low[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, r in enumerate(of[x]):
            steps = [*path(low[x], at), *path(high, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = leaf(*r[:4], r[4] + 1) if bad else leaf(*r)
            for odd, other in steps:
                node = H(other + node if odd else node + other)
            root = high[-1][0]
            out.append((r[0], leaf(*r), low[x][-1][0], root, H("".join(o for _, o in steps)), node, node == root))
    return out


def documents(kind):
    r = random.Random(8)
    if kind == "empty":
        return []
    if kind == "one":
        return [(3, "a", "en", "s", 1)]
    rows = [(k, r.choice(["tëxt", "", None, "word " * r.randrange(50)]), r.choice(["en", "en", "en", "de", None, "é", "z", ""]), r.choice(["s", None]), r.choice([5, None, 77])) for k in r.sample(range(3000), 900)]
    rows += [(5000, "only", "xx", "s", 1), (None, "x", "en", "s", 1), (None, "y", "en", "s", 2), (8000, "z" * 400_000, "en", "s", 400_000)]
    rows += [(6000, "again", "en", "s", 1)] * 40 + [(6000, "other", "en", "s", 1)]
    rows += [(9000 + k, "l", f"l{k:03d}", "s", 1) for k in range(70)]
    return rows


@pytest.mark.parametrize("kind,band", [("many", 10), ("many", 3), ("one", 10), ("empty", 10)])
def test_manifest(spark, kind, band):  # also as many bands as a far larger table has
    rows = documents(kind)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree int, node string, level int")
    got = [tuple(r) for r in merkle.manifest(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, band=band).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_manifest(rows)))
    if kind == "many":
        assert {g[6] for g in got} == {True, False}
