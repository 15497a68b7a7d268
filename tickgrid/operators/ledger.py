"""Votes on crops: how they are settled, and an append-only ledger of what was decided.

The ledger is a folder of Parquet parts, kind=delta/batch=N for what a micro-batch decided and kind=base/batch=N for the
last decisions of all batches up to N. A batch is written under its own number, so that writing it again changes nothing.
Of a key's decisions the one of the highest sequence number counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickgrid.sources.files import exists

#: Fixed value: the confidence from which on a judge's word counts.
JUDGE_FLOOR = 0.6
DECISION = "key string, seq long, is_checkbox boolean, filled boolean, route string, confidence double"


def settle(boxes: DataFrame, votes: DataFrame, judges: DataFrame) -> DataFrame:
    """boxes (key, is_checked, confidence), votes (key, is_checkbox, filled, confidence), judges (same) -> key and its decision.

    Two votes that agree on both questions, with a state, settle a box; else a judge who is sure enough does, if there was a
    vote at all; else it goes to review with the state it had. Votes are only counted, never gathered; of several judges of
    a key the surest counts.
    """
    one = votes.groupBy("key").agg(F.count("*").alias("n"), (F.min("is_checkbox") == F.max("is_checkbox")).alias("same_box"), F.min("is_checkbox").alias("v_box"), (F.count("filled") == F.count("*")).alias("all_states"), (F.min("filled") == F.max("filled")).alias("same_state"), F.min("filled").alias("v_filled"), F.round(F.min("confidence"), 2).alias("v_confidence"))
    judge = judges.groupBy("key").agg(F.max(F.struct("confidence", "is_checkbox", "filled")).alias("j"))
    agree = (F.col("n") == 2) & F.col("same_box") & F.col("all_states") & F.col("same_state")
    judged = (F.col("n") >= 1) & (F.col("j.confidence") >= JUDGE_FLOOR)
    pick = lambda a, b, c: F.when(agree, a).when(judged, b).otherwise(c)
    out = boxes.join(one, "key", "left").join(judge, "key", "left")
    return out.select(
        "key", pick(F.col("v_box"), F.col("j.is_checkbox"), F.lit(True)).alias("is_checkbox"), pick(F.col("v_filled"), F.col("j.filled"), F.col("is_checked")).alias("filled"),
        pick(F.lit("VLM_AGREE"), F.lit("JUDGED"), F.lit("REVIEW")).alias("route"), pick(F.col("v_confidence"), F.col("j.confidence"), F.col("confidence")).alias("confidence"),
    )


def appender(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: decisions (key, seq, ...) of a micro-batch under the batch's number, in the place of an earlier try."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/kind=delta/batch={batch_id}")

    return write


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """All rows with kind and batch, and the last batch that a base covers, or -1; only partition values are read for that."""
    rows = spark.read.schema(DECISION + ", kind string, batch long").option("basePath", path).parquet(path)
    top = rows.where("kind = 'base'").agg(F.max("batch")).first()[0]
    return rows, -1 if top is None else top


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decision that counts for every key of the ledger; no ledger, no rows.

    Parts that a base covers are left out, so a compaction that stopped before it cleared them does no harm.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], DECISION)
    rows, base = _parts(spark, path)
    return _latest(rows.where(((F.col("kind") == "base") & (F.col("batch") == base)) | ((F.col("kind") == "delta") & (F.col("batch") > base))))


def _latest(rows: DataFrame) -> DataFrame:
    last: Column = F.max(F.struct("seq", "is_checkbox", "filled", "route", "confidence"))
    return rows.groupBy("key").agg(last.alias("d")).select("key", "d.seq", "d.is_checkbox", "d.filled", "d.route", "d.confidence")


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Bring all batches up to a number into one base, which takes its place in one rename, and clear what it covers."""
    rows, base = _parts(spark, path)
    if base >= upto:
        return
    own = rows.where(((F.col("kind") == "base") & (F.col("batch") == base)) | ((F.col("kind") == "delta") & (F.col("batch") > base) & (F.col("batch") <= upto)))
    draft = f"{path}/_draft-{upto}"
    _latest(own).write.mode("overwrite").parquet(draft)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(f"{path}/kind=base"))
    fs.rename(jvm.Path(draft), jvm.Path(f"{path}/kind=base/batch={upto}"))
    for kind in ("base", "delta"):
        folder = jvm.Path(f"{path}/kind={kind}")
        for part in fs.listStatus(folder) if fs.exists(folder) else []:
            n = int(part.getPath().getName().split("=")[1])
            if n < upto or (kind == "delta" and n == upto):
                fs.delete(part.getPath(), True)
