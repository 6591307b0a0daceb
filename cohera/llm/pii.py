"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Nodes are the base spans of a document and its other tokens that hold an at sign or many digits; a token ends at white space, quotes,
brackets, slashes and the like, whatever its length. Neighbouring nodes share chain potentials. Nodes that repeat or resemble each
other (the same local part, the same last or first digits) share skip potentials however far apart they are: each is linked
to the one before it that is alike and to the nearest base span alike, so links grow with the nodes.

The weights are learnt by pseudo-likelihood from a bounded, documented sample (SAMPLE_DOCS, SAMPLE_CHARACTERS). Base spans are evidence. What is
predicted are tokens that the patterns do not take: every base span is mentioned once more in a form that they miss (a number
without its plus sign, an address cut short) and keeps its label there, while a stranger of the same form but another value is
no entity, so the form alone does not tell them apart and the link must. Other tokens that resemble a base span are hidden while learning.
Loopy belief propagation gives each node's marginals; base spans are fixed, another node joins when an entity label
has at least SURE of the probability. Documents without nodes need no inference.

Rules: a null text is an empty one (no spans); rows are independent; added spans overlap no base span; an empty table gives no rows and
unlearnt weights, which add nothing; other columns are left by find and carried by mask.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, table, tune

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_CHARACTERS = 4000, 8_000_000
SURE = 0.9
ROUNDS = 12
DAMPING = 0.5
# fixed values: the base patterns; the guard before an address's first part only spares retries inside a run of digits
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s\"'`<>\[\]{}|\\/=&?!,;:]+")
CANDIDATE = "@|[0-9]([ ().-]?[0-9]){6}"  # texts with other than this have no nodes but base spans
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    twice = [2 * int(d) - 9 * (d > "4") for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end), by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def _features(word: str, before: str, after: str) -> list[float]:
    digits = NOT_DIGIT.sub("", word)
    n, letters = len(digits), sum(c.isalpha() for c in word)
    fine = [1.0, "@" in word, word.startswith("+"), 0 < n < 7, 7 <= n <= 9, 10 <= n <= 13, 14 <= n <= 15, 16 <= n <= 19, n > 19, word.count(".") == 3, letters > 0, letters > n, 14 <= n <= 19 and luhn(digits), any(c in word for c in "()-"), ":" in before[-2:], before[-1:] == "/" or after == "/"]
    return [float(x) for x in fine]


def _keys(word: str) -> list[str]:
    """What makes tokens alike: the local part of an address; the last 7 and, of long numbers, the first 12 digits."""
    if "@" in word:
        local = word.lower().split("@")[0]
        return [f"@{local}"] if len(local) >= 3 else []
    digits = NOT_DIGIT.sub("", word)
    return ([f"-{digits[-7:]}"] if len(digits) >= 7 else []) + ([f"{digits[:12]}-"] if len(digits) >= 14 else [])


def _cut_phones(text: str) -> Iterator[tuple[int, int]]:
    """Where the phone pattern ran on into other digits: its longest part up to a space with 10 to 15 digits."""
    for m in PHONE.finditer(text):
        n, best = 0, 0
        for k, c in enumerate(m[0]):
            if c == " " and 10 <= n <= 15:
                best = k
            n += "0" <= c <= "9"
            if n > 15:
                break
        if n > 15 and best:
            yield m.start(), m.start() + len(m[0][:best].rstrip(" (.-"))


FEATURES = 16


def _apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans (by start) that overlap none of taken (by start)."""
    out, at, far = [], 0, 0
    for a, b in spans:
        while at < len(taken) and taken[at][0] < b:
            far = max(far, taken[at][1])
            at += 1
        if far <= a:
            out.append((a, b))
    return out


def _links(keys: list[list[str]], labels: list[int]) -> list[tuple[int, int]]:
    """Each node with the last node alike, and an unlabelled one with the nearest labelled node alike before and after it."""
    last, base, waiting, out = {}, {}, {}, set()
    for k, own in enumerate(keys):
        for key in own:
            if key in last:
                out.add((last[key], k))
            if labels[k] > 0:
                out.update((w, k) for w in waiting.pop(key, ()))
                base[key] = k
            else:
                if key in base:
                    out.add((base[key], k))
                waiting.setdefault(key, []).append(k)
            last[key] = k
    return sorted(out)


def graph(text: str, base: list[tuple[int, int, int]]) -> dict | None:
    """Nodes (start, end, label or -1), their features and keys, chain edges and skip edges."""
    if not base and "@" not in text and not DIGIT.search(text):
        return None
    spans, taken = [(a, b, k + 1) for a, k, b in base], sorted((a, b) for a, _, b in base)
    cut = _apart(list(_cut_phones(text)), taken) if "+" in text else []
    taken = sorted(taken + cut)
    found = []
    if re.search(r"[0-9][^\s]*[0-9]|@", text):
        for m in TOKEN.finditer(text):
            a, b = m.span()
            if "@" not in m[0] and sum(c.isdigit() and c.isascii() for c in m[0]) < 7:
                continue
            while b > a and text[b - 1] in ".)":
                b -= 1
            while a < b and text[a] == "(" and ")" not in text[a:b]:
                a += 1
            if a < b:
                found.append((a, b))
    spans += [(a, b, -1) for a, b in cut + _apart(found, taken)]
    if not spans:
        return None
    spans.sort()
    keys = [_keys(text[a:b]) for a, b, _ in spans]
    chain = [(k, k + 1) for k in range(len(spans) - 1) if spans[k + 1][0] - spans[k][1] <= 40]
    x = np.array([_features(text[a:b], text[max(0, a - 2) : a], text[b : b + 1]) for a, b, _ in spans])
    return {"spans": spans, "x": x, "keys": keys, "chain": chain, "skip": _links(keys, [s[2] for s in spans])}


def _mention(kind: int, word: str) -> str:
    """The same value in a form that the patterns miss."""
    digits = NOT_DIGIT.sub("", word)
    if KINDS[kind] == "email":
        return word[: word.index("@")] + "@" + word[word.index("@") + 1 :].split(".")[0]
    if KINDS[kind] == "ip":
        return word.replace(".", "-")
    return digits[:-1] + str((int(digits[-1]) + 5) % 10) if KINDS[kind] == "card" else digits[-10:]


OTHER_DIGITS = str.maketrans("0123456789", "3456789012")


def example(text: str) -> dict | None:
    """A document to learn from: its graph, to which each base span's mention and a stranger of the mention's form are added.

    y holds labels (-1: hidden) and `asked` which nodes are predicted: mentions, strangers and tokens that resemble no base span.
    """
    g = graph(text, base_spans(text))
    if g is None:
        return None
    known = {key for (_, _, label), keys in zip(g["spans"], g["keys"], strict=True) if label > 0 for key in keys}
    y = [label if label > 0 else -1 if known.intersection(keys) else 0 for (_, _, label), keys in zip(g["spans"], g["keys"], strict=True)]
    asked, x, skip = [v == 0 for v in y], list(g["x"]), list(g["skip"])
    for k, (a, b, label) in enumerate(g["spans"]):
        if not g["keys"][k] or y[k] < 0:
            continue
        word = _mention(label - 1, text[a:b]) if label > 0 else text[a:b]
        if set(_keys(word)).intersection(g["keys"][k]):
            skip.append((k, len(x)))
            x.append(np.array(_features(word, "", "")))
            y.append(y[k])
            asked.append(True)
            if label > 0:
                x.append(np.array(_features(word.translate(OTHER_DIGITS), "", "")))
                y.append(0)
                asked.append(True)
    return {"x": np.array(x, np.float32), "y": np.array(y), "asked": np.array(asked), "chain": g["chain"], "skip": skip}


def unlearnt() -> dict[str, np.ndarray]:
    n = len(KINDS) + 1
    return {"w": np.zeros((FEATURES, n)), "chain": np.zeros((n, n)), "skip": np.zeros((n, n))}


def learn(examples: list[dict], steps: int = 400, rate: float = 1.0, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Pseudo-likelihood of the asked nodes: each one's label given its features and its neighbours' labels."""
    theta, n = unlearnt(), len(KINDS) + 1
    if not examples:
        return theta
    size = np.cumsum([0, *[len(g["y"]) for g in examples]])
    x, y, asked = (np.concatenate([g[c] for g in examples]) for c in ("x", "y", "asked"))
    hot = np.where((y >= 0)[:, None], np.eye(n)[np.maximum(y, 0)], 0.0)
    near = {}
    for kind in ("chain", "skip"):
        e = np.array([(a + o, b + o) for g, o in zip(examples, size, strict=False) for a, b in g[kind]], np.int64).reshape(-1, 2)
        near[kind] = np.zeros((len(y), n))
        np.add.at(near[kind], e[:, 0], hot[e[:, 1]])
        np.add.at(near[kind], e[:, 1], hot[e[:, 0]])
        near[kind] = near[kind][asked]
    x, hot = x[asked], hot[asked]
    for _ in range(steps if len(x) else 0):
        score = x @ theta["w"] + near["chain"] @ theta["chain"] + near["skip"] @ theta["skip"]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        miss = (hot - p / p.sum(axis=1, keepdims=True)) / len(x)
        theta["w"] += rate * (x.T @ miss - decay * theta["w"])
        for kind in ("chain", "skip"):
            g = near[kind].T @ miss
            theta[kind] += rate * (g + g.T - decay * theta[kind])
    return theta


def marginals(g: dict, theta: dict[str, np.ndarray]) -> np.ndarray:
    """Loopy belief propagation; nodes with a label are fixed to it."""
    n, k = len(g["spans"]), len(KINDS) + 1
    own = g["x"] @ theta["w"]
    for i, (_, _, label) in enumerate(g["spans"]):
        if label > 0:
            own[i] = -1e3
            own[i, label] = 0
    pairs = np.array([*g["chain"], *g["skip"]], np.int64).reshape(-1, 2)
    if len(pairs):
        kinds = np.array([0] * len(g["chain"]) + [1] * len(g["skip"]))
        tables = np.stack([theta["chain"], theta["skip"]])[np.concatenate([kinds, kinds])]
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        back = np.concatenate([np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))])
        sent = np.zeros((2 * len(pairs), k))
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, dst, sent)
            new = np.logaddexp.reduce((total[src] - sent[back])[:, :, None] + tables, axis=1)
            new -= new.max(axis=1, keepdims=True)
            sent = DAMPING * sent + (1 - DAMPING) * new
        np.add.at(own, dst, sent)
    p = np.exp(own - own.max(axis=1, keepdims=True))
    return (p / p.sum(axis=1, keepdims=True)).reshape(n, k)


def all_spans(text: str, theta: dict[str, np.ndarray]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with what the field adds."""
    base = base_spans(text)
    g = graph(text, base)
    if g is None or all(s[2] > 0 for s in g["spans"]):
        return base, base
    p = marginals(g, theta)
    best = p.argmax(axis=1)
    return base, sorted(base + [(a, int(k) - 1, b) for (a, b, label), k, q in zip(g["spans"], best, p, strict=True) if label < 0 and k and q[k] >= SURE])


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, characters: int = SAMPLE_CHARACTERS) -> dict[str, np.ndarray]:
    """Weights learnt from the whole texts of least hash that may hold nodes, at most sample_docs of them and `characters` in all."""
    tune(docs.sparkSession)
    src = picked(docs, text=text_col).where(F.col("text").rlike(CANDIDATE)).withColumn("h", F.xxhash64("text"))
    first = src.select("h", F.length("text").alias("n")).where(F.col("n") <= characters).distinct().orderBy("h").limit(sample_docs).toPandas()
    fits = first.h[first.n.cumsum() <= characters].tolist()
    if not fits:
        return unlearnt()
    sample = src.where((F.col("h") <= fits[-1]) & (F.length("text") <= characters)).dropDuplicates(["h"])

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [g for t in pdf.text if (g := example(t))]
            yield pd.DataFrame({c: [np.ascontiguousarray(g[c], kind).tobytes() for g in got] for c, kind in PARTS.items()})

    rows = sample.mapInPandas(nodes, ", ".join(f"{c} binary" for c in PARTS)).collect()
    got = [{c: np.frombuffer(bytes(r[c]), kind) for c, kind in PARTS.items()} for r in sorted(rows, key=lambda r: (bytes(r.x), bytes(r.skip)))]
    return learn([g | {"x": g["x"].reshape(-1, FEATURES), "chain": g["chain"].reshape(-1, 2), "skip": g["skip"].reshape(-1, 2)} for g in got])


PARTS = {"x": np.float32, "y": np.int64, "asked": np.bool_, "chain": np.int64, "skip": np.int64}


def find(docs: DataFrame, theta: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base and spans (both as kind:start:end, comma-joined)."""
    tune(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [all_spans(t, theta) for t in pdf.text]
            kinds = np.array([np.bincount([k for _, k, _ in b], minlength=len(KINDS)) for b, _ in got]).reshape(-1, len(KINDS))
            yield pd.DataFrame({"doc_id": pdf.doc_id, **{f"n_{k}": kinds[:, i] for i, k in enumerate(KINDS)}, "base": [show(b) for b, _ in got], "spans": [show(s) for _, s in got]})

    src = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInPandas(lambda it: scan(p.astype({"doc_id": "Int64"}) for p in it), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def mask(docs: DataFrame, theta: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by <KIND>; overlapping spans go as the first of them. Null stays null."""
    tune(docs.sparkSession)

    def hide(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for a, k, b in all_spans(text, theta)[1]:
            if a >= done:
                out += [text[done:a], f"<{KINDS[k].upper()}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    @F.pandas_udf("string")
    def hidden(texts: pd.Series) -> pd.Series:
        return texts.map(hide)

    return docs.withColumn(text_col, hidden(F.col(f"`{text_col}`")))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs)).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
