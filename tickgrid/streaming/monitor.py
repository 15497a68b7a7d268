"""A flag-rate monitor over a stream of graded boxes; an extension, not a feature of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_rate(boxes: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """boxes (ts, corpus, reasons) -> share of flagged boxes per window and corpus; rows later than ``late`` are left out."""
    own = boxes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = own.groupBy(F.window("ts", window).alias("w"), "corpus").agg(F.count("*").alias("boxes"), F.count_if(F.size("reasons") > 0).alias("flagged"))
    return out.select(F.col("w.start").alias("start"), "corpus", "boxes", "flagged", (F.col("flagged") / F.col("boxes")).alias("flag_rate"))
