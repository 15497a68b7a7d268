"""Exact order statistics of large groups, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.functions.lineage import cut


def order_statistics(df: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row per group: its values at some 1-based ranks, which are columns of the row count ``n``.

    Equal values are counted first, combined before their shuffle. The distinct ones are dealt to tasks by ranges of (group,
    value) that hold about equally many, whatever their spread, so outliers and infinities don't crowd the rest into one
    range; a rank's range follows from one count a group and range, and only that range is summed up value by value. Nulls
    don't count; a group of nulls has no row.
    """
    own = df.select(F.col(by).alias("by"), F.col(value).alias("v")).where("v IS NOT NULL").groupBy("by", "v").agg(F.count("*").alias("k"))
    own = cut(own.repartitionByRange("by", "v").withColumn("part", F.spark_partition_id()))
    upto = lambda *key: W.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(W.unboundedPreceding, 0)
    parts = own.groupBy("by", "part").agg(F.sum("k").alias("k")).withColumns({"end": F.sum("k").over(upto("by", "part")), "n": F.sum("k").over(W.partitionBy("by"))})
    wanted = parts.select("by", "part", (F.col("end") - F.col("k")).alias("before"), "end", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("rank")) for name, at in ranks.items()])).alias("w"))
    wanted = wanted.where("w.rank > before AND w.rank <= end").select("by", "part", "before", "w.name", "w.rank")
    fine = own.join(wanted, ["by", "part"]).withColumn("end", F.col("before") + F.sum("k").over(upto("by", "name", "v")))
    found = fine.where("rank <= end AND rank > end - k")
    return found.groupBy("by").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks]).withColumnRenamed("by", by)
