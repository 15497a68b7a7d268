"""Personal data: exact patterns, and a skip-chain conditional random field that adds what they miss.

Base spans come from four patterns (email, ip, card, phone), leftmost and not overlapping within a kind. Secrets are a fifth
kind, taught by strings that are told as one (token = "...") but decided by the field. Candidates are base spans, told
strings, numbers written in groups, addresses spelled with (at) and (dot), and other words with a digit or an @; they form a
chain per document. Candidates that are equal or similar are linked to the occurrence before, however far: equal digits or
words most, then the last nine digits of a number, one half of a long number, an address's user, its host, a network, and
strings of one make. Unary potentials come from one softmax over features of a candidate's shape and of its context (the
words that a sign of assignment ties to it, and the entropy of what is assigned), fitted with base spans and told strings as
labels. What shape adds is bounded, so that shape alone never reaches ADD; what context adds is not. Chain edges and skip
edges favour equal labels. Loopy sum-product message passing runs in every document with a candidate that isn't base; one
whose label is a kind with probability ADD or more becomes an added span, by its context if its own potentials would do, else
by the field. Base spans are clamped and always stay.

Each candidate has one link for each of its keys, so a token repeated m times has m - 1 skip edges of a sort.

Cases: null or empty text: no spans. A text of any length is read whole; time and memory follow its length. Ties
between labels go to ``none``. Repeated rows get equal spans. An empty table gives no rows and teaches nothing: then
base spans and told strings are all.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import give_back, share, texts, unit
from tickgrid.llm.textvec import fit_logistic

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds with a base pattern.
BASE = 4
#: Least probability of an added span; rounds; bound on a shape potential, with which shape alone gives less than ADD.
ADD, ROUNDS, SHAPE = 0.95, 10, 4.0
#: Strength of edges: to the neighbour in the chain, between equal candidates, and between similar ones by what they share.
CHAIN, SKIP = 0.2, 8.0
SIMILAR = {"tail": 6.0, "half": 2.0, "user": 3.0, "host": 1.0, "net": 1.0, "make": 2.0}
#: Features of shape, and places that words of a context are hashed to.
SHAPES, PLACES = 19, 64
#: Documents with candidates that the shape potentials are fitted on, at most (in expectation).
FIT_DOCS = 4000
#: Candidates of one text that teach, at most: those with the least checksums of their places.
FIT_TOKENS = 200
RESULT = "n_email long, n_ip long, n_card long, n_phone long, n_spans long, n_added long, base_sha256 string, spans string, found array<struct<kind: string, start: int, end: int, source: string, p: double>>"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Fixed patterns of the four kinds; the address pattern is applied around each @ and so never rescans a run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SECRET = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s{0,4}[:=]\s{0,4}[\"']?([A-Za-z0-9+/_=-]{16,})")
_GROUPED = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,30}")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}[ ]?(?:\(at\)|\[at\]| at )[ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:\(dot\)|\[dot\]| dot )[ ]?[A-Za-z0-9-]{1,63}){1,8}")
_ASSIGNED = re.compile(r"([A-Za-z][A-Za-z_-]{1,23})[\"']?\s{0,4}[:=]\s{0,4}[\"']?$")
_WORD = re.compile(r"[A-Za-z]+")
_AT, _DOT = re.compile(r" ?(?:\(at\)|\[at\]| at ) ?"), re.compile(r" ?(?:\(dot\)|\[dot\]| dot ) ?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, free := m.end()))
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts[i : i + 4]):
                out.append((at, at + size))
            at += size + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if _SIGN.search(text):
        out += [(1, *s) for s in ips(text)]
        for m in _CARD.finditer(text):
            d = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of strings that are told as a secret and hold a digit: what teaches that kind."""
    if "=" not in text and ":" not in text:
        return []
    return [(BASE, m.start(1), m.end(1)) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[1])]


def tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates (start, end, label): spans as wholes (kind + 1), then numbers, spelled addresses and other words (0)."""
    own, end = [], 0
    fixed = [(a, z, k + 1) for k, a, z in spans]
    if "dot" in text:
        fixed += [(m.start(), m.end(), 0) for m in _SPELLED.finditer(text)]
    for a, z, y in sorted(fixed, key=lambda s: (s[0], s[2] == 0, -s[1], s[2])):
        if a >= end:
            own.append((a, z, y))
            end = z
    out, i, at = [], 0, 0
    while (m := _SIGN.search(text, at)) is not None or i < len(own):
        p = m.start() if m else len(text)
        if i < len(own) and own[i][0] <= p:
            out.append(own[i])
            at = max(at, own[i][1])
            i += 1
            continue
        stop = own[i][0] if i < len(own) else len(text)
        a, floor = p, max(out[-1][1] if out else 0, at)
        while a > floor and text[a - 1] in "+(":
            a -= 1
        g = _GROUPED.match(text, a, stop) or _GROUPED.match(text, p, stop)
        if g and (g.end() == len(text) or not text[g.end()].isalnum()) and (g.start() == 0 or not text[g.start() - 1].isalnum()) and len(_NOT_DIGIT.sub("", g[0])) <= 19:
            out.append((g.start(), g.end(), 0))
            at = g.end()
            continue
        a = p
        while a > floor and not text[a - 1].isspace():
            a -= 1
        z = min(stop, _TOKEN.match(text, p).end())
        while z > p + 1 and text[z - 1] in ".,;:!?)]}>\"'#*%$&|":
            z -= 1
        while a < p and text[a] in "([{<\"'#*%$&|":
            a += 1
        out.append((a, z, 0))
        at = z
    return out


def keys(piece: str) -> list[tuple[str, float]]:
    """What a candidate may share with another, with the strength of an edge between two that do; its name comes first."""
    word = _DOT.sub(".", _AT.sub("@", piece)).lower()
    digits = _NOT_DIGIT.sub("", word)
    if "@" in word:
        user, _, host = word.rpartition("@")
        return [(word, SKIP), (f"user {user}", SIMILAR["user"]), (f"host {host}", SIMILAR["host"])]
    if word.count(".") == 3 and word.replace(".", "").isdigit():
        return [(word, SKIP), (f"net {word.rpartition('.')[0]}", SIMILAR["net"])]
    if len(digits) >= 7 and 2 * len(digits) > len(word) and not any(c.isalpha() for c in word):
        out = [(digits, SKIP)]
        if len(digits) >= 10:
            out.append((f"tail {digits[-9:]}", SIMILAR["tail"]))
        if len(digits) >= 13:
            out += [(f"first {len(digits)} {digits[:8]}", SIMILAR["half"]), (f"last {len(digits)} {digits[-8:]}", SIMILAR["half"])]
        return out
    if len(word) >= 16 and word.isalnum():
        return [(word, SKIP), (f"make {len(word)} {all(c in '0123456789abcdef' for c in word)}", SIMILAR["make"])]
    return [(word, SKIP)]


def shape(piece: str) -> np.ndarray:
    """Features of a candidate's own characters; neither a base pattern nor a check digit enters."""
    n = len(piece)
    digits = sum(c.isdigit() for c in piece)
    letters = sum(c.isalpha() for c in piece)
    parts = piece.split(".")
    dotted = len(parts) == 4 and all(x.isdigit() for x in parts)
    return np.array([
        1, min(n, 64) / 16, digits / n, letters / n, min(digits, 24) / 8, "@" in piece, dotted, dotted and all(int(x[-4:]) <= 255 and len(x) <= 4 for x in parts), piece.count(".") == 1, piece.startswith("+"), "-" in piece, " " in piece,
        "(" in piece, digits == n, 13 <= digits <= 19, 9 <= digits <= 12, piece.rpartition("@")[2].count(".") > 0 and "@" in piece, n >= 16 and piece.isalnum() and 0 < digits < n, n >= 16 and all(c in "0123456789abcdef" for c in piece),
    ], np.float32)


def context(text: str, a: int, piece: str) -> np.ndarray:
    """Features of what is before a candidate: whether a name is assigned to it, the name's words, and then its entropy."""
    out = np.zeros(2 + PLACES, np.float32)
    m = _ASSIGNED.search(text, max(0, a - 34), a)
    if m:
        n = np.array([piece.count(c) for c in set(piece)]) / len(piece)
        out[:2] = 1, -(n @ np.log2(n)) / 4
        for word in _WORD.findall(m[1].lower()):
            out[2 + zlib.crc32(word.encode()) % PLACES] = 1
    return out


def features(text: str, own: list[tuple[int, int, int]]) -> np.ndarray:
    return np.stack([np.concatenate([shape(text[a:z]), context(text, a, text[a:z])]) for a, z, _ in own])


def propagate(unary: np.ndarray, edges: np.ndarray, power: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product over label-agreement edges, in logs; returns each node's label probabilities."""
    n, k = unary.shape
    if not len(edges):
        z = np.exp(unary - unary.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    gain = np.expm1(np.concatenate([power, power]))[:, None]
    msg = np.zeros((len(src), k))
    def believed() -> np.ndarray:
        return unary + np.stack([np.bincount(dst, msg[:, j], n) for j in range(k)], axis=1)

    for _ in range(rounds):
        belief = believed()
        cavity = belief[src] - msg[back]
        cavity -= cavity.max(axis=1, keepdims=True)
        p = np.exp(cavity)
        new = np.log(p.sum(axis=1, keepdims=True) + gain * p)
        new -= new.max(axis=1, keepdims=True)
        msg = 0.5 * msg + 0.5 * new
    belief = believed()
    z = np.exp(belief - belief.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def edges_of(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Chain and skip edges of a document's candidates, with their strengths; edges between the same two add up."""
    power: dict[tuple[int, int], float] = {}
    last: dict[str, int] = {}
    for i, piece in enumerate(pieces):
        if i:
            power[i - 1, i] = power.get((i - 1, i), 0.0) + CHAIN
        for name, strength in keys(piece):
            if name in last:
                power[last[name], i] = power.get((last[name], i), 0.0) + strength
            last[name] = i
    return np.array(list(power), np.int64).reshape(-1, 2), np.array(list(power.values()))


def potentials(text: str, spans: list[tuple[int, int, int]], weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[int], np.ndarray]:
    """A text's candidates, their clamped labels (0 for open ones), and their unary potentials."""
    own = tokens(text, spans)
    clamped = [y if y <= BASE else 0 for _, _, y in own]
    if all(clamped):
        return own, clamped, np.zeros((len(own), len(KINDS) + 1))
    x, w = features(text, own), weights.astype(np.float64)
    unary = x[:, :SHAPES] @ w[:SHAPES]
    unary = np.maximum(unary - unary.max(axis=1, keepdims=True), -SHAPE) + x[:, SHAPES:] @ w[SHAPES:]
    for i, y in enumerate(clamped):
        if y:
            unary[i] = -30
            unary[i, y] = 30
    return own, clamped, unary


def find(text: str, weights: np.ndarray | None) -> list[tuple[int, int, int, str, float]]:
    """All spans (kind, start, end, source, probability) of a text, by kind, then start."""
    base, told = base_spans(text), seeds(text)
    out = [(k, a, z, "base", 1.0) for k, a, z in base]
    if weights is None:
        return sorted(out + [(k, a, z, "told", 1.0) for k, a, z in told])
    own, clamped, unary = potentials(text, base + told, weights)
    if all(clamped):
        return sorted(out)
    alone = propagate(unary, np.zeros((0, 2), np.int64), np.zeros(0))
    p = propagate(unary, *edges_of([text[a:z] for a, z, _ in own]))
    best = p.argmax(axis=1)
    out += [(int(best[i]) - 1, a, z, "context" if alone[i, best[i]] >= ADD else "crf", float(p[i, best[i]])) for i, (a, z, _) in enumerate(own) if not clamped[i] and best[i] and p[i, best[i]] >= ADD]
    return sorted(out)


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = FIT_DOCS) -> np.ndarray | None:
    """Shape weights from the base spans of a bounded sample of the texts that hold digits or an @."""

    @F.pandas_udf("struct<x: binary, y: binary>")
    def candidates(t: pd.Series) -> pd.DataFrame:
        xs, ys = [], []
        for text in texts(t):
            own = tokens(text, base_spans(text) + seeds(text))
            if len(own) > FIT_TOKENS:
                own = sorted(own, key=lambda t: (zlib.crc32(b"%d" % t[0]), t))[:FIT_TOKENS]
            xs.append(features(text, own).tobytes() if own else b"")
            ys.append(bytes(y for _, _, y in own))
        return pd.DataFrame({"x": xs, "y": ys})

    has = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("t"), unit(F.col(id_col), F.lit("pii")).alias("u"))
    n = has.count()
    if not n:
        return None
    got = has.where(F.col("u") < min(1.0, rows / n)).select(candidates("t").alias("c")).select("c.*").toPandas()
    y = np.concatenate([np.frombuffer(b, np.uint8) for b in got["y"]]) if len(got) else np.zeros(0, np.uint8)
    if not y.any():
        return None
    x = np.concatenate([np.frombuffer(b, np.float32) for b in got["x"]]).reshape(len(y), -1)
    w, b = fit_logistic(x, np.eye(len(KINDS) + 1, dtype=np.float32)[y], rounds=200, rate=0.1, softmax=True)
    w[0] += b  # the first feature is constant
    return w


def digest(found: list[tuple[int, int, int, str, float]]) -> tuple[str, str]:
    name = lambda k, a, z: f"{KINDS[k]}:{a}:{z}"
    base = ",".join(name(k, a, z) for k, a, z, source, _ in found if source == "base")
    return hashlib.sha256(base.encode()).hexdigest(), ",".join(name(k, a, z) for k, a, z, *_ in found)


def finder(weights: np.ndarray | None, spark) -> object:
    """A column function: text -> struct of RESULT."""
    held = share(spark, weights)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        none = digest([])
        for batch in batches:
            rows = []
            for text in texts(batch):
                found = find(text, held.value) if _SIGN.search(text) or "dot" in text else []
                n = [sum(k == i and s == "base" for k, _, _, s, _ in found) for i in range(BASE)]
                rows.append((*n, len(found), len(found) - sum(n), *(digest(found) if found else none), [{"kind": KINDS[k], "start": a, "end": z, "source": s, "p": p} for k, a, z, s, p in found]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")[:8]] + ["found"])
        give_back()

    return run
