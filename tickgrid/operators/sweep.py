"""A sweep over intervals: how many are open at each instant, and what happens at each level of concurrency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.functions import ranks
from tickgrid.functions.lineage import cut


def steps(intervals: DataFrame, slot: int) -> DataFrame:
    """intervals (id, start, stop in whole units) -> (at, kind, id, length, slot, level): starts and ends in order.

    ``level`` is the number of open intervals just before the step; at one instant ends come before starts. Running sums are
    taken slot by slot of time: a slot's own sum starts from the net of all slots before it, which is one row a slot.
    Intervals that end before they start are left out.
    """
    good = intervals.where(F.col("stop") >= F.col("start"))
    one = lambda at, kind: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"))
    own = good.select("id", (F.col("stop") - F.col("start")).alias("length"), F.explode(F.array(one("start", 1), one("stop", -1))).alias("s")).select("id", "length", "s.at", "s.kind")
    # an interval of no length starts before it ends, so it is met at both of its steps
    own = cut(own.withColumn("slot", F.floor(F.col("at") / slot)).withColumn("_o", F.when((F.col("kind") == -1) & (F.col("length") == 0), 2).otherwise(F.col("kind"))))
    net = own.groupBy("slot").agg(F.sum("kind").alias("net"))
    before = net.select("slot", F.coalesce(F.sum("net").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("slot").orderBy("at", "_o", "id").rowsBetween(W.unboundedPreceding, -1)
    return own.join(before, "slot").withColumn("level", F.col("before") + F.coalesce(F.sum("kind").over(inside), F.lit(0))).select("at", "kind", "_o", "id", "length", "slot", "level")


def levels(intervals: DataFrame, slot: int, unit: int) -> DataFrame:
    """(level, requests, spent, per_second, p50, p95, longest): for every level, intervals that ended at it, the units of time
    spent at it, requests a second, and order statistics of the ended intervals' lengths, the 95th counted downwards.

    A level's time is what lies between steps; a slot's first step takes the time since the last step before the slot.
    """
    own = cut(steps(intervals, slot))
    last = own.groupBy("slot").agg(F.max("at").alias("_last")).withColumn("_prior", F.lag("_last").over(W.orderBy("slot"))).select("slot", "_prior")
    order = W.partitionBy("slot").orderBy("at", "_o", "id")
    spent = own.join(last, "slot").withColumn("_since", F.col("at") - F.coalesce(F.lag("at").over(order), F.col("_prior"), F.col("at")))
    time = spent.groupBy("level").agg(F.sum("_since").alias("spent"), F.count_if(F.col("kind") == -1).alias("requests"), F.max(F.when(F.col("kind") == -1, F.col("length"))).alias("longest"))
    n = F.col("n")
    stats = ranks.order_statistics(own.where("kind = -1"), "level", "length", {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95": F.greatest(F.floor(n * 0.95) - 1, F.lit(0)) + 1})
    return time.join(stats, "level", "left").select("level", "requests", "spent", F.when(F.col("spent") > 0, F.round(F.col("requests") * unit / F.col("spent"), 6)).alias("per_second"), ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95", "longest")
