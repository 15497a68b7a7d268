"""A second reader trained on a table of vectors: a Spark ML pipeline, fitted on a seeded split, saved, and loaded when asked.

Rows whose place is a judgment card's never teach, nor do rows without a label or with a vector of another length or with
components that are no numbers. The split follows from a seed and the row's id alone, so it stays when rows are added.
"""

from __future__ import annotations

from functools import cache

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickgrid.sources.files import exists

SEED, TEACH = 23, 80


def part(id_col: str, seed: int = SEED, teach: int = TEACH) -> Column:
    """train or test, by a hash of the seed and the id; ``teach`` in a hundred are train."""
    h = F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    return F.when(h % 100 < teach, "train").otherwise("test")


def usable(vector: str, size: int) -> Column:
    """Whether a vector has the size, and numbers only."""
    return F.coalesce((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _features(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("_raw", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def fit(rows: DataFrame, held: DataFrame, id_col: str, vector: str, label: str, size: int, rounds: int = 50) -> PipelineModel:
    """rows (id, vector, label 0/1) without those of ``held`` (the same id column) and without the test part -> a model.

    Only sums of gradients reach the driver, as long as a vector.
    """
    own = rows.where(F.col(label).isNotNull() & usable(vector, size)).join(held.select(id_col).distinct(), id_col, "left_anti").where(part(id_col) == "train")
    stages = [StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), LogisticRegression(featuresCol="_scaled", labelCol=label, probabilityCol="_prob", predictionCol="_state", rawPredictionCol="_margin", maxIter=rounds, regParam=0.01)]
    return Pipeline(stages=stages).fit(_features(own, vector))


def score(rows: DataFrame, model: PipelineModel | None, vector: str, size: int) -> DataFrame:
    """rows with ``p``: a row's probability follows from its own vector alone; null without a model or a usable vector."""
    if model is None:
        return rows.withColumn("p", F.lit(None).cast("double"))
    good = _features(rows.where(usable(vector, size)), vector)
    told = model.transform(good).select(*rows.columns, vector_to_array("_prob")[1].alias("p"))
    return told.unionByName(rows.where(~usable(vector, size)).withColumn("p", F.lit(None).cast("double")))


@cache
def load(path: str) -> PipelineModel | None:
    """The model saved at a path, read once a driver when first asked for; None where there is none."""
    return PipelineModel.load(path) if exists(SparkSession.active(), f"{path}/metadata") else None
