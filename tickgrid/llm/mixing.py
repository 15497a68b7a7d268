"""Mixing to target weights by soft membership.

A softmax classifier, fitted on labelled rows, gives every document posteriors over domains. It reads hashed character
n-grams, which tell style, and for each domain the log-odds of the document's words that lie mostly in it, which tell what
a few words decide. It learns from a labelled sample, one row of each family of near copies; a row that teaches is read
with log-odds in which it isn't counted itself. The temperature is the one with the least log loss on rows that the
weights of the other half of the sample read; then posteriors follow the labelled shares.
Document rates r >= 0 are then the minimum of

    1/2 |e|^2 + RIDGE/2 sum_i w_i (r_i - 1)^2,   e_k = sum_i r_i w_i p_ik - t_k,

w_i being the document's share of all tokens and t_k the target share of domain k. The errors of all domains weigh alike,
so overlapping domains can't trade a large error in the total for a small one between them. Rates go down the projected
gradient: from 1, each step moves all rates against the gradient p_i e + RIDGE (r_i - 1) and lifts those below zero to it.
Taken as it is, the gradient needs hundreds of steps, for it is steep across the domains and flat along them; so it is
scaled by the inverse of the least squares' matrix on the documents with a rate above zero, which is a multiple of the
identity but for K dimensions: what the scaling needs is the K x K Gram matrix of their posteriors. A step is then one
number and one K-vector, the pull, from which every document works out its rate; no rates are stored or collected. One
distributed pass adds up what each of several lengths of a step, and one step of the plain gradient, would reach, and the
least is taken, so each step descends at least as the plain gradient does. There is no limit on steps: they end when the
projected gradient bounds the rates' distance from the minimum by SETTLED, and a warning is given if rounding stops them
before. Rates become whole copies: the floor, and one more where a hash of the document falls below the rest.

Cases: an id with two domains has the last in alphabetical order; of near copies that teach one domain the one with the
least id, then text hash, does. Null and empty texts have no tokens; they keep the rate that their posteriors give. A target domain without mass
can't be reached and is left out, its weight spread over the others. No labelled row, or no tokens: all rates are 1.
Equal rows get equal rates and copies.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import batches_of, fresh, give_back, sampled, share, small, spool, texts, unit
from tickgrid.llm.textvec import fit_logistic, hellinger, ngram_counts, shingles, word_hashes

#: Labelled rows of a domain that the classifier is fitted on, at most (in expectation).
FIT_ROWS = 1500
BITS, ORDERS = 11, (1, 3)
#: Families of a domain that a word is in at least, and its least log-odds.
MIN_FAMILIES, MIN_ODDS = 3, 1.5
#: Texts that go to Python at once.
ROWS = 1024
#: Pull towards a rate of 1; distance of the rates from the minimum (root of the mean square over tokens) at which steps end.
RIDGE, SETTLED = 1e-3, 1e-4
#: Lengths of a scaled step that one pass tries, longest first; what the plain gradient changes by at most.
_LENGTHS = 0.5 ** np.arange(12)
_STEEPEST = 1 + RIDGE
#: What Python takes for blanks.
_BLANKS = r"[\x09-\x0d\x1c-\x1f\x85\p{Z}]+"
TARGETS = {"clean": 0.9, "low": 0.07, "toxic": 0.03}
RESULT = "n_tokens long, domain string, posterior array<double>"


@dataclass
class Words:
    """Hashes of the words that speak for a domain, in order, and their log-odds for each (0 or more)."""

    hashes: np.ndarray
    odds: np.ndarray

    def signals(self, own: np.ndarray, odds: np.ndarray | None = None) -> np.ndarray:
        """Of a text's distinct word hashes: for each domain the sum of log-odds, as it is and by the text's words."""
        odds = self.odds if odds is None else odds
        if not len(self.hashes):
            return np.zeros(2 * odds.shape[1], np.float32)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        total = odds[at[self.hashes[at] == own]].sum(axis=0)
        return np.log1p(np.concatenate([total, 100 * total / (1 + len(own))])).astype(np.float32)


def log_odds(n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of words in n texts of each domain; 0 for a word of fewer than MIN_FAMILIES texts or with less than MIN_ODDS."""
    inside, outside = (n + 0.5) / (rows + 1), (n.sum(axis=1, keepdims=True) - n + 0.5) / (rows.sum() - rows + 1)
    odds = np.log(inside / outside)
    return np.where((n < MIN_FAMILIES) | (odds < MIN_ODDS), 0.0, odds)


def learn_words(words: list[np.ndarray], domain: np.ndarray, k: int) -> tuple[Words, np.ndarray]:
    """The words, and the signals of each text by log-odds in which it isn't counted."""
    every, at = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True)
    n, rows = np.zeros((len(every), k)), np.bincount(domain, minlength=k)
    np.add.at(n, (at, np.repeat(domain, [len(w) for w in words])), 1)
    held = (n >= MIN_FAMILIES).any(axis=1)
    every, n = every[held], n[held]
    model = Words(every, log_odds(n, rows))
    without = [log_odds(np.maximum(0, n - one), rows - one) for one in np.eye(k)]
    return model, np.stack([model.signals(w, without[d]) for w, d in zip(words, domain, strict=True)])


@dataclass
class MixingModel:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    words: Words | None = None
    steps: list[tuple[float, np.ndarray]] = field(default_factory=list)  # length and pull
    wanted: np.ndarray | None = None
    reached: np.ndarray | None = None

    def posteriors(self, batch: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        own = texts(batch)
        n = np.array([len(t.split()) for t in own], np.int64)
        p = np.zeros((len(own), len(self.domains)))
        for at in range(0, len(own), 256):
            z = np.stack([np.concatenate([style(t), self.words.signals(np.unique(word_hashes(t)))]) for t in own[at : at + 256]]) @ self.weights + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p[at : at + 256] = z / z.sum(axis=1, keepdims=True)
        return n, p

    def rates(self, p: np.ndarray) -> np.ndarray:
        """The rates of documents with posteriors p after all steps."""
        r = np.ones(len(p))
        for length, pull in self.steps:
            r = stepped(r, p, length, pull)
        return r


def stepped(r: np.ndarray, p: np.ndarray, length: float, pull: np.ndarray) -> np.ndarray:
    """Rates after a step. The plain gradient's step of length s has the length s * RIDGE and the pull e / RIDGE."""
    return np.maximum(0, r - length * (p @ pull + r - 1))


def domain_of_labels() -> Column:
    """Domains of the labels table: toxic, low quality, or clean; null where both labels are."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) | (F.col("toxic") == 0), "clean")


def style(text: str) -> np.ndarray:
    return hellinger(ngram_counts(text, ORDERS, BITS))


def calibrated(z: np.ndarray, y: np.ndarray, shares: np.ndarray) -> float:
    """The factor for logits that gives the posteriors, with the domains' shares, the least log loss on rows of these shares."""
    weight = (shares / np.maximum(1, np.bincount(y, minlength=len(shares))))[y]

    def loss(c: float) -> float:
        s = c * z + np.log(shares)
        s -= s.max(axis=1, keepdims=True)
        return float(weight @ (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    return min(np.geomspace(0.05, 8, 60), key=loss)


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: Column, text_col: str = "text", id_col: str = "doc_id", rows: int = FIT_ROWS) -> MixingModel | None:
    i, y = fresh(docs, "_id"), fresh(docs, "_domain")
    told = labels.select(F.col(id_col).alias(i), domain.alias(y)).where(F.col(i).isNotNull()).groupBy(i).agg(F.max(y).alias(y)).where(F.col(y).isNotNull())
    teach = spool(sampled(told, y, rows, F.col(i), F.lit("mix")), "mixing-labels")

    @F.pandas_udf("struct<x: binary, words: binary, family: long>")
    def read(t: pd.Series) -> pd.DataFrame:
        own = texts(t)
        family = [int(g[0].view(np.int64)) if len(g := shingles(x)) else 0 for x in own]
        return pd.DataFrame({"x": [style(x).astype(np.float16).tobytes() for x in own], "words": [np.unique(word_hashes(x)).tobytes() for x in own], "family": family})

    found = docs.join(small(teach), F.col(id_col) == F.col(i)).select(F.col(y).alias("y"), F.col(i).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash"), read(text_col).alias("r"))
    least = found.groupBy("y", "r.family").agg(F.min(F.struct("id", "hash", "r.x", "r.words")).alias("t")).select("y", "family", "t.x", "t.words")
    got = sorted(least.collect(), key=lambda r: (r["y"], r["family"]))
    if not got:
        return None
    names = sorted({r["y"] for r in got})
    y = np.array([names.index(r["y"]) for r in got])
    words = [np.frombuffer(r["words"], np.uint64) for r in got]
    own_words, signals = learn_words(words, y, len(names))
    x = np.hstack([np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32), signals])
    del got, words

    def fitted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and biases from these rows, in which each domain counts about alike."""
        n = np.bincount(y[rows], minlength=len(names))
        even = np.concatenate([rows[y[rows] == v].repeat(max(1, round(n.max() / n[v]))) for v in np.flatnonzero(n)])
        return fit_logistic(x[even], np.eye(len(names), dtype=np.float32)[y[even]], rounds=120, softmax=True)

    half = np.random.default_rng(3).permuted(np.arange(len(y)) % 2)
    apart = np.zeros((len(y), len(names)))
    for side in (0, 1):
        if (half == side).any() and (half != side).any():
            w, b = fitted(np.flatnonzero(half == side))
            apart[half != side] = x[half != side] @ w + b
    seen = dict(told.groupBy(told.columns[1]).count().collect())
    shares = np.array([seen[v] for v in names], float)
    shares /= shares.sum()
    factor = calibrated(apart, y, shares)
    w, b = fitted(np.arange(len(y)))
    model = MixingModel(names, w, b, own_words)
    del x
    give_back()
    model.weights, model.bias = (model.weights * factor).astype(np.float32), (model.bias * factor + np.log(shares)).astype(np.float32)
    return model


def _totals(held: DataFrame, size: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """One pass: the sum over all batches of a function of posteriors and token counts that gives size numbers."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(size)
        for b in batches:
            if len(b):
                out += of(np.array(b["posterior"].tolist()), b["n_tokens"].to_numpy(np.float64))
        yield pd.DataFrame({"at": np.arange(size), "v": out})

    got = dict(held.select("n_tokens", "posterior").mapInPandas(add, "at int, v double").groupBy("at").agg(F.sum("v")).collect())
    return np.array([got.get(i, 0.0) for i in range(size)])


def _reached(p: np.ndarray, n: np.ndarray, model: MixingModel, e: np.ndarray, tried: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """The squared projected gradient at the present rates; and for each step tried the domain totals, the Gram matrix and the
    pulled posteriors of the documents whose rate it leaves above 0, and the squares of the rates' distances from 1."""
    r = model.rates(p)
    slope = p @ e + RIDGE * (r - 1)
    out = [[n @ (r - np.maximum(0, r - slope / _STEEPEST)) ** 2]]
    for length, pull in tried:
        s = stepped(r, p, length, pull)
        free = n * (s > 0)
        out += [(n * s) @ p, ((p * free[:, None]).T @ p).ravel(), (free * (s - 1)) @ p, [n @ (s - 1) ** 2]]
    return np.concatenate(out)


def fit_rates(held: DataFrame, model: MixingModel, targets: dict[str, float]) -> MixingModel:
    """held: n_tokens and posterior of every document."""
    k = len(model.domains)
    first = _totals(held, (k + 1) * k, lambda p, n: np.concatenate([((p * n[:, None]).T @ p).ravel(), n @ p]))
    gram, mass = first[: k * k].reshape(k, k), first[k * k :]
    total = mass.sum()
    if total <= 0:
        return model
    gram, mass = gram / total, mass / total
    want = np.array([targets.get(d, 0.0) if m > 0 else 0.0 for d, m in zip(model.domains, mass, strict=True)])
    if want.sum() <= 0:
        return model
    model.wanted = want = want / want.sum()
    model.reached, pulled, value = mass, np.zeros(k), (mass - want) @ (mass - want) / 2
    while True:
        e = model.reached - want
        y = e - np.linalg.solve(RIDGE * np.eye(k) + gram, gram @ e + RIDGE * pulled)
        tried = [(length, y / RIDGE) for length in _LENGTHS] + [(RIDGE / _STEEPEST, e / RIDGE)]
        size = k * k + 2 * k + 1
        got = _totals(held, 1 + len(tried) * size, lambda p, n: _reached(p, n, model, e, tried)) / total
        apart = 2 * _STEEPEST * got[0] ** 0.5 / RIDGE  # at most so far from the minimum, which is RIDGE-strongly convex
        if apart <= SETTLED:
            return model
        rows = got[1:].reshape(len(tried), size)
        values = ((rows[:, :k] - want) ** 2).sum(axis=1) / 2 + RIDGE / 2 * rows[:, -1]
        best = int(values.argmin())
        if values[best] >= value:
            warnings.warn(f"mixing rates may be {apart:.1e} from their minimum, more than {SETTLED}", RuntimeWarning, stacklevel=2)
            return model
        value = values[best]
        model.steps.append(tried[best])
        model.reached, gram, pulled = rows[best, :k], rows[best, k : k + k * k].reshape(k, k), rows[best, k + k * k : -1]


def membership(docs: DataFrame, model: MixingModel, text_col: str = "text") -> Column:
    """A column: struct of RESULT for each text."""
    shared = share(docs.sparkSession, model)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            n, p = m.posteriors(batch)
            yield pd.DataFrame({"n_tokens": n, "domain": [m.domains[i] for i in p.argmax(axis=1)], "posterior": list(p)})
        give_back()

    return run(F.col(text_col))


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, MixingModel | None]:
    """(doc_id, text_hash, n_tokens, domain, posterior, rate, copies) of every row, and the model."""
    key = [F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash")]
    model = fit_classifier(docs, labels, domain, text_col, id_col)
    if model is None:
        one = docs.select(*key, F.size(F.array_remove(F.split(F.coalesce(text_col, F.lit("")), _BLANKS), "")).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"))
        return one.withColumn("copies", F.lit(1).cast("long")), None
    with batches_of(docs.sparkSession, ROWS):
        held = spool(docs.select(*key, membership(docs, model, text_col).alias("m")).select("doc_id", "text_hash", "m.n_tokens", "m.domain", "m.posterior"), "mixing")
    model = fit_rates(held, model, targets)
    out = held.withColumn("rate", rate_of(held, model, F.col("posterior")))
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("text_hash"))), model


def rate_of(held: DataFrame, model: MixingModel, posterior: Column) -> Column:
    shared = share(held.sparkSession, model)

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(shared.value.rates(np.array(p.tolist()).reshape(len(p), -1)))

    return rate.asNondeterministic()(posterior)  # so that a filter on it isn't answered by a second call


def copies(rate: Column, *key: Column) -> Column:
    return (F.floor(rate) + (unit(*key, F.lit("copies")) < rate - F.floor(rate)).cast("long")).cast("long")


def resample(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with each row as often as its copies say. Posteriors are written beside the rows, so a text is scored once."""
    model = fit_classifier(docs, labels, domain, text_col, id_col)
    if model is None:
        return docs
    m, n = fresh(docs, "_mix"), fresh(docs, "_n")
    with batches_of(docs.sparkSession, ROWS):
        held = spool(docs.withColumn(m, membership(docs, model, text_col)), "mixing")
    model = fit_rates(held.select(f"{m}.n_tokens", f"{m}.posterior"), model, targets)
    out = held.withColumn(m, copies(rate_of(held, model, F.col(f"{m}.posterior")), F.col(id_col), F.xxhash64(F.coalesce(text_col, F.lit(""))))).where(F.col(m) > 0)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(m)))).drop(m, n)
