"""A second reader: 32 x 32 patches of the boxes and a trained linear classifier, in place of a small network.

Crops are made in the one map over pages; training and scoring are Spark ML on a vector column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.operators.extract import grey

SIDE, GROW = 32, 0.25


def area_resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new pixel is the mean of the old area that it covers, along one axis after the other."""
    out = img.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        total = np.concatenate([np.zeros_like(out.take([0], axis)), out.cumsum(axis)], axis)
        edge = np.linspace(0, out.shape[axis], n + 1)
        low = np.minimum(edge.astype(int), out.shape[axis] - 1)
        part = (edge - low).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        at = total.take(low, axis) + part * out.take(low, axis)
        out = np.diff(at, axis=axis) / (img.shape[axis] / n)
    return np.rint(out).astype(img.dtype) if img.dtype == np.uint8 else out


def patch(g: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The box grown by a quarter on each side, as SIDE x SIDE shares of white; white for a box off the page."""
    x1, y1, x2, y2 = box
    gx, gy = int(GROW * (x2 - x1)), int(GROW * (y2 - y1))
    part = g[max(0, y1 - gy) : max(0, y2 + gy), max(0, x1 - gx) : max(0, x2 + gx)]
    return area_resized(part, SIDE, SIDE) / 255 if part.size else np.ones((SIDE, SIDE))


def patches(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, box_id, patch array<float>) for every given box."""
    own = boxes.groupBy("page").agg(F.collect_list(F.struct("box_id", "x1", "y1", "x2", "y2")).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                g = grey(p.pixels, p.height, p.width, p.channels)
                yield pd.DataFrame([(p.page, b["box_id"], patch(g, (b["x1"], b["y1"], b["x2"], b["y2"])).ravel().astype(np.float32)) for b in p.b], columns=["page", "box_id", "patch"])

    return pages.join(own, "page").select("page", "height", "width", "channels", "pixels", "b").mapInPandas(run, "page string, box_id int, patch array<float>")


def without_cards(boxes: DataFrame, cards: DataFrame) -> DataFrame:
    """Training boxes whose place (16-pixel cells of the corner sums) is not a judgment card's, by page."""
    cell = lambda a, b: F.floor((F.col(a) + F.col(b)) / 16)
    held = cards.select("page", cell("x1", "x2").alias("_x"), cell("y1", "y2").alias("_y")).distinct()
    return boxes.withColumns({"_x": cell("x1", "x2"), "_y": cell("y1", "y2")}).join(held, ["page", "_x", "_y"], "left_anti").drop("_x", "_y")


def fit(rows: DataFrame, rounds: int = 100) -> LogisticRegressionModel:
    """rows (patch, is_checked) -> model."""
    own = rows.select(array_to_vector(F.col("patch").cast("array<double>")).alias("features"), F.col("is_checked").cast("double").alias("label"))
    return LogisticRegression(maxIter=rounds, regParam=0.01, standardization=False).fit(own)


def score(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """rows with ``p``, the probability of a mark; each patch is scored by itself."""
    own = model.transform(rows.withColumn("_features", array_to_vector(F.col("patch").cast("array<double>"))).withColumnRenamed("_features", model.getFeaturesCol()))
    return own.select(*rows.columns, vector_to_array("probability")[1].alias("p"))


def accuracy(scored: DataFrame) -> DataFrame:
    """Shares of right states by factor, for validation pages."""
    return scored.groupBy("factor").agg(F.count("*").alias("n"), F.avg(((F.col("p") > 0.5) == F.col("is_checked")).cast("double")).alias("right"))
