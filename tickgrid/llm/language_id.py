"""Language ID by error-correcting output codes over character n-grams.

Every language gets a codeword of -1/+1 bits; one linear classifier per bit reads hashed character n-grams of the
whole text. Decoding adds, over the bits, the logistic loss of the bit's margin against the codeword, weighted by how
well that bit does on that language, and takes the nearest codeword. A small lead over the runner-up is flagged.

Cases: null text, or text with no letter: ``und``, score 0, not ambiguous. No labelled row: ``und`` for all. One
language: that language for all texts with letters. Ties: the first language in alphabetical order. Repeated rows and
repeated ids are each predicted by their own text. Labels that are null teach nothing, nor do those beyond the
``base.LABELS`` most frequent.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import fold_of, fresh, gathered, give_back, sampled, share, texts
from tickgrid.llm.textvec import fit_logistic, hellinger, ngram_counts

#: Rows of a language that the bit classifiers are fitted on, at most (in expectation).
FIT_ROWS = 500
BITS, ORDERS = 12, (1, 2, 3)
AMBIGUOUS = 0.2
_LETTER = regex.compile(r"\p{L}")
RESULT = "lang_pred string, score double, runner_up string, margin double, ambiguous boolean"


@dataclass
class EcocModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits; rows add up to 1


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """All splits of up to 5 classes; beyond that the best of many random codes by least distance."""
    if n <= 5:
        rows = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(rows, np.float32).T if rows else np.ones((n, 1), np.float32)
    r = np.random.default_rng(seed)
    width, best, most = int(np.ceil(15 * np.log2(n))), None, -1
    for _ in range(60):
        c = r.choice(np.array([-1, 1], np.float32), (n, width))
        near = int(((width - c @ c.T) / 2 + np.eye(n) * width).min())
        if near > most:
            best, most = c, near
    return best


def features(batch: pd.Series) -> np.ndarray:
    return np.stack([hellinger(ngram_counts(t.lower(), ORDERS, BITS)) for t in texts(batch)]) if len(batch) else np.zeros((0, 1 << BITS), np.float32)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", rows: int = FIT_ROWS) -> EcocModel | None:
    """Fit on about ``rows`` rows of every language; features are made on the executors, bits fitted on the driver."""

    @F.pandas_udf("binary")
    def vectors(t: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.float16).tobytes() for x in features(t)])

    taught, x = gathered(sampled(labelled.where(F.col(text_col).isNotNull()), label_col, rows, F.col(id_col), F.lit("lid")).select(F.col(label_col).alias("y"), vectors(text_col).alias("x")), "y", "x")
    if not taught:
        return None
    names = sorted(set(taught))
    y = np.array([names.index(v) for v in taught])
    codes = codewords(len(names))
    w, b = fit_logistic(x, (codes[y] + 1) / 2)
    right = (x @ w + b) * codes[y] > 0
    del x
    give_back()
    trust = np.stack([right[y == i].mean(axis=0) for i in range(len(names))]) + 1e-6
    return EcocModel(names, codes, w, b, (trust / trust.sum(axis=1, keepdims=True)).astype(np.float32))


def decode(model: EcocModel, margins: np.ndarray) -> np.ndarray:
    """Loss-weighted distances, texts x languages."""
    loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * model.codes[None], -30, 30)))
    return (loss * model.trust[None]).sum(axis=2)


def predictor(model: EcocModel | None, spark) -> object:
    """A column function: text -> struct of RESULT."""
    held = share(spark, model)

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            has = np.array([bool(_LETTER.search(t)) for t in texts(batch)], bool) & (m is not None)
            out = pd.DataFrame({"lang_pred": ["und"] * len(batch), "score": 0.0, "runner_up": None, "margin": 0.0, "ambiguous": False})
            if m is not None and has.any():
                own = batch[has]
                far = np.concatenate([decode(m, features(own.iloc[i : i + 512]) @ m.weights + m.bias) for i in range(0, len(own), 512)]).astype(np.float64)
                p = np.exp((far.min(axis=1, keepdims=True) - far) * 4)
                p /= p.sum(axis=1, keepdims=True)
                order = np.argsort(far, axis=1, kind="stable")
                rows = np.arange(len(own))
                second = order[:, 1] if far.shape[1] > 1 else None
                lead = p[rows, order[:, 0]] - (p[rows, second] if second is not None else 0)
                out.loc[has, "lang_pred"] = [m.languages[i] for i in order[:, 0]]
                out.loc[has, "score"] = p[rows, order[:, 0]]
                out.loc[has, "margin"] = lead
                out.loc[has, "ambiguous"] = lead < AMBIGUOUS
                if second is not None:
                    out.loc[has, "runner_up"] = [m.languages[i] for i in second]
            yield out
        give_back()

    return predict.asNondeterministic()  # so that a filter on the prediction isn't answered by predicting twice


def train_split(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may teach: an id whose crc32 modulo 4 isn't 2."""
    return docs.where(fold_of(id_col, 4) != 2)


def identify(docs: DataFrame, model: EcocModel | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the prediction's columns; existing columns of those names are replaced."""
    held = fresh(docs, "lid")
    out = docs.withColumn(held, predictor(model, docs.sparkSession)(F.col(text_col)))
    names = [x.split()[0] for x in RESULT.split(", ")]
    keep = [c for c in docs.columns if c.lower() not in {prefix + n for n in names}]
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"{held}.{n}").alias(prefix + n) for n in names])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold_of(id_col, 4) == 2, F.lit(False))


def rejected() -> Column:
    """What a filter on language drops: texts with no language."""
    return F.col("lang_pred") == "und"
