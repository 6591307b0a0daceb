"""Rank tests of small groups against counting every order, and leave-one-out weights against plain sums."""

import itertools
import random

import pytest
from cohera.operators import stats as st
from cohera.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plain_u(x, y):
    return sum((a > b) + 0.5 * (a == b) for a in x for b in y)


def plain_p(x, y):
    every = [*x, *y]
    own, n = plain_u(x, y), len(x)
    us = [plain_u([every[i] for i in pick], [every[i] for i in range(len(every)) if i not in pick]) for pick in itertools.combinations(range(len(every)), n)]
    low, high = sum(u <= own for u in us) / len(us), sum(u >= own for u in us) / len(us)
    return low, high, min(1.0, 2 * min(low, high))


def test_exact_mann_whitney(spark):
    r = random.Random(3)
    groups = {g: (r.sample(range(100), n + m)[:n], m) for g, (n, m) in {"a": (3, 5), "b": (1, 6), "c": (4, 4)}.items()}
    rows = []
    want = {}
    for g, (x, m) in groups.items():
        y = r.sample([v for v in range(100) if v not in x], m)
        rows += [(g, float(v), 1) for v in x] + [(g, float(v), 0) for v in y]
        want[g] = plain_p(x, y)
    df = spark.createDataFrame([*rows, ("t", 1.0, 1), ("t", 1.0, 0), ("t", 2.0, 0), ("one", 4.0, 1)], "g string, v double, y int")
    for k, side in enumerate(("less", "greater", "two-sided")):
        got = {x.g: x.p for x in st.exact_mann_whitney(df, "v", "y", ["g"], side).collect()}
        for g in groups:
            assert got[g] == pytest.approx(want[g][k])
        assert got["one"] is None
    near = {x.g: x.p for x in st.mann_whitney(df, "v", "y", ["g"]).collect()}
    assert {x.g: x.p for x in st.exact_mann_whitney(df, "v", "y", ["g"]).collect()}["t"] == near["t"]


def test_exact_signed_rank(spark):
    d = [3.0, -1.0, 4.0, 7.5, -2.0, 9.0]
    sizes = sorted(map(abs, d))
    own = sum(k + 1 for k, v in enumerate(sizes) if v in d)
    ws = [sum(k + 1 for k in range(6) if s >> k & 1) for s in range(64)]
    p = min(1.0, 2 * min(sum(w <= own for w in ws), sum(w >= own for w in ws)) / 64)
    df = spark.createDataFrame([("g", v) for v in [*d, 0.0]], "g string, d double")
    got = st.exact_signed_rank(df, "d", ["g"]).first()
    assert (got.n, got.w, got.p) == (6, own, pytest.approx(p))


def test_exact_query_runs_over_all_groups(spark):
    rows = QUERIES["exact_small_groups"](spark, SF).collect()
    assert sum(r.n1 + r.n0 for r in rows) == spark.read.parquet(f"{SF}/customer.parquet").where("c_acctbal is not null").count()
    assert all(r.p is None or 0 < r.p <= 1 for r in rows)
