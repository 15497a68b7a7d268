"""Weak-label quality classifier.

Heuristic labellers vote good, bad or nothing on a whole text. Texts are counted by vote pattern (at most 3^labellers),
and expectation-maximisation over all patterns estimates each labeller's vote rates in either class. The posteriors label
a bounded sample of texts, on which a hashed linear scorer is trained; it scores every text.

Cases: null or empty text: posterior and score 0, not kept. An empty table gives no rows. If only one class is found,
the scorer is the constant posterior. Ties in the majority that starts the estimation count as one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import gathered, give_back, sampled, share, spool, texts
from tickgrid.llm.textvec import PIECE, fit_logistic, hellinger, ngram_counts, word_hashes

LABELLERS = ("symbols", "capitals", "length", "word_length", "repeated_lines", "repeated_words", "decorated_words", "digits")
#: Texts of each class that the scorer is trained on, at most (in expectation).
FIT_ROWS = 2000
BITS, ORDERS, ROUNDS = 13, (1, 2, 3), 100
RESULT = "votes string, posterior double, score double, keep boolean"
_CLASS = np.full(0x250, 1, np.uint8)  # 0 blank, 1 letter, 2 capital, 3 digit, 4 sentence mark, 5 other sign
for _i in range(0x250):
    _c = chr(_i)
    _CLASS[_i] = 0 if _c.isspace() else 2 if _c.isupper() else 1 if _c.isalpha() else 3 if _c.isdigit() else 4 if _c in ".,;:'\"?!-()" else 5


@dataclass
class QualityModel:
    posterior: dict[str, float]
    accuracy: dict[str, tuple[float, float]]  # share of right votes among a labeller's votes, by class bad, good
    weights: np.ndarray | None = None
    bias: float = 0.0


def measures(text: str) -> dict[str, float]:
    n = np.zeros(6, np.int64)
    starts = decorated = 0
    last = 0
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        k = np.where(c < 0x250, _CLASS[np.minimum(c, 0x24F)], 1)
        n += np.bincount(k, minlength=6)
        before = np.concatenate([[last], k[:-1]])
        starts += int(((before == 0) & (k > 0)).sum())
        ends = np.concatenate([k[1:] == 0, [True]])
        decorated += int((ends & ((k == 5) | ((k == 4) & (before >= 4)))).sum())
        last = int(k[-1])
    words, letters = max(1, starts), max(1, int(n[1] + n[2]))
    lines = [x for x in text.split("\n") if x.strip()]
    hashes = word_hashes(text)
    return {
        "words": starts, "symbols": n[5] / max(1, len(text) - n[0]), "capitals": n[2] / letters, "word_length": (len(text) - n[0]) / words, "digits": n[3] / max(1, len(text) - n[0]),
        "lines": len(lines), "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "distinct_words": len(np.unique(hashes)) / max(1, len(hashes)), "decorated": decorated / words,
    }


def votes(text: str) -> str:
    """A character per labeller: g(ood), b(ad) or - for none."""
    if not text.strip():
        return "b" * len(LABELLERS)
    m = measures(text)

    def by(v: float, good: bool, bad: bool, applies: bool = True) -> str:
        return "-" if not applies else "b" if bad else "g" if good else "-"

    return "".join([
        by(m["symbols"], m["symbols"] < 0.04, m["symbols"] > 0.12),
        by(m["capitals"], m["capitals"] < 0.15, m["capitals"] > 0.5),
        by(m["words"], m["words"] >= 20, m["words"] < 5),
        by(m["word_length"], 3 <= m["word_length"] <= 10, m["word_length"] < 2 or m["word_length"] > 16),
        by(m["repeated_lines"], m["repeated_lines"] < 0.2, m["repeated_lines"] > 0.5, m["lines"] >= 4),
        by(m["distinct_words"], m["distinct_words"] > 0.25, m["distinct_words"] < 0.08, m["words"] >= 50),
        by(m["decorated"], m["decorated"] < 0.15, m["decorated"] > 0.4),
        by(m["digits"], m["digits"] < 0.1, m["digits"] > 0.3),
    ])


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> QualityModel:
    """EM over vote patterns: class share, and each labeller's vote rates given the class."""
    names = sorted(patterns)
    if not names:
        return QualityModel({}, {})
    count = np.array([patterns[x] for x in names], float)
    v = np.array([["b-g".index(c) for c in x] for x in names])
    good, bad = (v == 2).sum(axis=1), (v == 0).sum(axis=1)
    # most labellers find nothing wrong with most texts, so a complaint starts with more weight than a good vote
    q = np.clip((good + 1) / (good + 3 * bad + 2), 0.02, 0.98)
    for _ in range(rounds):
        share = ((q * count).sum() + 1) / (count.sum() + 2)
        log = np.log(np.stack([np.full(len(q), 1 - share), np.full(len(q), share)]))
        rate = np.zeros((2, v.shape[1], 3))
        for y, w in enumerate(((1 - q) * count, q * count)):
            for j in range(v.shape[1]):
                rate[y, j] = (np.bincount(v[:, j], weights=w, minlength=3) + 0.1) / (w.sum() + 0.3)
                log[y] += np.log(rate[y, j, v[:, j]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    right = {name: (float(rate[0, j, 0] / (rate[0, j, 0] + rate[0, j, 2])), float(rate[1, j, 2] / (rate[1, j, 0] + rate[1, j, 2]))) for j, name in enumerate(LABELLERS)}
    return QualityModel(dict(zip(names, q.tolist(), strict=True)), right)


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = FIT_ROWS) -> QualityModel:
    @F.pandas_udf("string")
    def vote(t: pd.Series) -> pd.Series:
        return pd.Series([votes(x) for x in texts(t)], dtype=object)

    @F.pandas_udf("binary")
    def vectors(t: pd.Series) -> pd.Series:
        return pd.Series([hellinger(ngram_counts(x, ORDERS, BITS)).astype(np.float16).tobytes() for x in texts(t)])

    held = spool(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), vote(text_col).alias("v")), "votes")
    model = estimate(dict(held.groupBy("v").count().collect()))
    if not model.posterior:
        return model
    side = F.create_map(*[F.lit(x) for k, q in model.posterior.items() for x in (k, "good" if q >= 0.5 else "bad")])
    chosen = sampled(held.withColumn("side", side[F.col("v")]), "side", rows, F.col("id"), F.col("h")).select("id", "h", "v").distinct()
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("t"))
    teach = own.join(F.broadcast(chosen), own["id"].eqNullSafe(chosen["id"]) & (own["h"] == chosen["h"])).select("v", "t")
    taught, x = gathered(teach.select("v", vectors("t").alias("x")), "v", "x")
    if len({model.posterior[v] >= 0.5 for v in taught}) == 2:
        w, b = fit_logistic(x, np.array([model.posterior[v] for v in taught], np.float32)[:, None])
        model.weights, model.bias = w[:, 0], float(b[0])
    return model


def scorer(model: QualityModel, spark) -> object:
    """A column function: text -> struct of RESULT."""
    held = share(spark, model)

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            own = texts(batch)
            v = [votes(t) for t in own]
            q = np.array([m.posterior.get(x, 0.5) for x in v], float)
            s = q.copy()
            if m.weights is not None:
                z = np.array([float(hellinger(ngram_counts(t, ORDERS, BITS)) @ m.weights) for t in own], float) + m.bias
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            empty = np.array([not t.strip() for t in own], bool)
            q[empty] = s[empty] = 0
            yield pd.DataFrame({"votes": v, "posterior": q, "score": s, "keep": s >= 0.5})
        give_back()

    return score
