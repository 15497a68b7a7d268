"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding look-alikes and digit substitutions.

The lexicon is learned from labelled rows: folded words that lie mostly in toxic rows. Rows are counted by families
(texts with the same least five-word hash), so that near copies of one text don't lift its words. Phrases in which a lexicon word is harmless are
exceptions: a neighbour with which the word occurs in clean rows, or phrases that the caller gives. The weighted hits, as they are and
divided by the text's length, enter a two-feature logistic calibration.

Cases: null or empty text scores as a text without a hit. No labelled toxic row: an empty lexicon and the base rate
(0.01 where nothing is labelled). Longest match wins where hits overlap; repeated rows are scored alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import fold_of, fresh, give_back, sampled, share, spool, texts
from tickgrid.llm.textvec import fit_logistic, shingles

#: Labelled rows of each class that are learned from, at most (in expectation). The lexicon and the harmless phrases have
#: no bound of their own: they come from these rows. Words learned have MIN_LETTERS at least.
FIT_ROWS = 2500
MIN_FAMILIES, MIN_ODDS, MIN_LETTERS = 3, 2.5, 3
#: Look-alike letters, and digits and signs that stand for letters. i, l and 1 share one form.
_ALIKE = dict(zip("аеорсухіјѕһԁгтмкнвαοερτικνυ", "aeopcyxijshdrtmkhbaoeptiknu", strict=True))
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "l": "i"}
#: Signs read as letters beside a letter: @ before one, $ before or after one, ! and | between two.
_SIGNS = regex.compile(r"@(?=\p{L})|\$(?=\p{L})|(?<=\p{L})\$|(?<=\p{L})[!|](?=\p{L})")
_AS_LETTERS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_MARKS = regex.compile(r"\p{Mn}+")
_SILENT = "​‌‍⁠﻿­"
_FOLD = str.maketrans(_ALIKE | _DIGITS)
_DROP = str.maketrans(dict.fromkeys(_SILENT))
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
RESULT = "score double, predicted int, hits array<struct<term: string, start: int, end: int>>"


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    scale: tuple[float, float, float] = (0.0, 0.0, -4.6)  # of hits, of hits by length, constant
    _auto: object = None

    def automaton(self):
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for term in [*self.weights, *self.exceptions]:
                self._auto.add_word(term, term)
            if len(self._auto):
                self._auto.make_automaton()
        return self._auto


def fold(text: str) -> str:
    """Lower case with compatible forms, accents, look-alikes, digits and signs as plain letters; silent characters go."""
    if not text.isascii():
        if any(c in text for c in _SILENT):
            text = text.translate(_DROP)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower()
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGNS.sub(lambda m: _AS_LETTERS[m[0]], text)
    return text.translate(_FOLD)


def matches(model: ToxicityModel, text: str) -> tuple[list[tuple[str, int, int]], str]:
    """Whole-word hits (start, end in the folded text) that no exception covers."""
    folded, auto = fold(text), model.automaton()
    if not len(auto):
        return [], folded
    found = []
    for last, term in auto.iter(folded):
        a, z = last - len(term) + 1, last + 1
        if not (a and folded[a - 1].isalnum()) and not (z < len(folded) and folded[z].isalnum()):
            found.append((a, z, term))
    out, end = [], -1
    for a, z, term in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end:
            end = z
            if term not in model.exceptions:
                out.append((term, a, z))
    return out, folded


def signals(model: ToxicityModel, hits: list, folded: str) -> tuple[float, float]:
    weight = sum(model.weights[t] for t, _, _ in hits)
    return float(np.log1p(weight)), weight / (1 + len(folded) / 1000)


def _learn_words(rows: DataFrame, text_col: str, label_col: str) -> tuple[dict[str, float], set[str]]:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y in zip(batch.column(text_col).to_pylist(), batch.column(label_col).to_pylist(), strict=True):
                w = ["^", *_TOKEN.findall(fold(t or "")), "$"]
                grams = shingles(t or "")
                family = int(grams[0].view(np.int64)) if len(grams) else 0
                own = [x for x in set(zip(w, w[1:], w[2:], strict=False)) if len(x[1]) >= MIN_LETTERS]
                columns = [pa.array([y] * len(own), pa.int32()), *(pa.array([x[i] for x in own], pa.string()) for i in (1, 0, 2)), pa.array([family] * len(own), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["w_y", "w", "before", "after", "family"])

    seen = spool(rows.select(text_col, label_col).mapInArrow(words, "w_y int, w string, before string, after string, family long").withColumnRenamed("w_y", "y").distinct(), "words")
    toxic = lambda: F.count_distinct(F.when(F.col("y") == 1, F.col("family"))).alias("t")
    clean = lambda: F.count_distinct(F.when(F.col("y") == 0, F.col("family"))).alias("c")
    by_word = seen.groupBy("w").agg(toxic(), clean()).withColumn("n", F.col("t") + F.col("c"))
    total = seen.agg(toxic(), clean()).withColumn("n", F.col("t") + F.col("c")).first()
    if not total or not total["t"]:
        return {}, set()
    odds = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5)) - float(np.log((total["t"] + 1) / (total["n"] - total["t"] + 1)))
    lexicon = by_word.where(F.col("t") >= MIN_FAMILIES).withColumn("o", odds).where(F.col("o") >= MIN_ODDS)
    kept = lexicon.where(F.col("t") >= 0.6 * F.col("n")).collect()
    weights = {r["w"]: float(r["o"]) for r in kept}
    if not weights:
        return {}, set()
    side = seen.where(F.col("w").isin(list(weights)))
    pairs = side.select("y", "family", F.explode(F.array(F.concat_ws(" ", "before", "w"), F.concat_ws(" ", "w", "after"))).alias("phrase"))
    harmless = pairs.groupBy("phrase").agg(toxic(), clean()).withColumn("n", F.col("t") + F.col("c")).where("n >= 3 AND t <= 0.1 * n")
    return weights, {r["phrase"] for r in harmless.collect() if "^" not in r["phrase"] and "$" not in r["phrase"]}


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", rows: int = FIT_ROWS, exceptions: tuple[str, ...] = ()) -> ToxicityModel:
    """Learn from labelled rows whose id's crc32 modulo 5 isn't 0; ``exceptions`` are harmless phrases known beforehand."""
    y, i = fresh(docs, "y"), fresh(docs, "i")
    teach = sampled(labels.where((fold_of(id_col, 5) != 0) & F.col(label_col).isin(0, 1)), label_col, rows, F.col(id_col), F.lit("tox"))
    teach = teach.groupBy(F.col(id_col).alias(i)).agg(F.max(label_col).cast("int").alias(y))
    own = docs.join(F.broadcast(teach), F.col(id_col) == F.col(i)).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(y).alias("y"))
    weights, harmless = _learn_words(own, "t", "y")
    model = ToxicityModel(weights, harmless | {fold(x) for x in exceptions})
    held = share(docs.sparkSession, model)

    @F.pandas_udf("array<double>")
    def signal(t: pd.Series) -> pd.Series:
        return pd.Series([list(signals(held.value, *matches(held.value, x))) for x in texts(t)])

    got = own.select("y", signal("t").alias("x")).toPandas()
    if len(got):
        x, y = np.array(got["x"].tolist(), np.float32), got["y"].to_numpy(np.float32)[:, None]
        if 0 < y.sum() < len(y):
            w, b = fit_logistic(x, y, rounds=400, rate=0.1)
            model.scale = (float(max(0, w[0, 0])), float(max(0, w[1, 0])), float(b[0]))
        else:
            model.scale = (0.0, 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    model._auto = None
    return model


def scorer(model: ToxicityModel, spark) -> object:
    """A column function: text -> struct of RESULT."""
    model._auto = None
    held = share(spark, model)

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        a, b, c = m.scale
        for batch in batches:
            got, p = [], []
            for t in texts(batch):
                hits, folded = matches(m, t)
                x, y = signals(m, hits, folded)
                p.append(1 / (1 + np.exp(-np.clip(a * x + b * y + c, -30, 30))))
                got.append([{"term": t_, "start": s, "end": e} for t_, s, e in hits])
            yield pd.DataFrame({"score": np.array(p, float), "predicted": (np.array(p, float) >= 0.5).astype("int32"), "hits": pd.Series(got, dtype=object)})
        give_back()

    return score


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold_of(id_col, 5) == 0, F.lit(False))
