"""Summed-area tables: sums over any box of a page's cells from four places of a table of running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def summed(cells: DataFrame, page: str, value: str) -> DataFrame:
    """cells (page, y, x, value), one for each place of the page -> (page, y, x, total): the sum of all places up to y and x.

    Sums run along rows, then down columns; a page's rows and columns are spread over tasks.
    """
    up = lambda key, order: W.partitionBy(page, key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    own = cells.select(page, "y", "x", F.coalesce(F.col(value), F.lit(0)).alias("_v")).withColumn("_v", F.sum("_v").over(up("y", "x")))
    return own.select(page, "y", "x", F.sum("_v").over(up("x", "y")).alias("total"))


def box_sums(table: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """boxes (page, box_id, name, x1, y1, x2, y2, ends exclusive) -> (page, box_id, name, total), 0 for empty boxes.

    Each box asks for its four corners, which are met in one join; corners on the page's upper or left edge are zeros.
    Boxes must lie on the page.
    """
    corner = lambda y, x, sign: F.struct((F.col(y) - 1).alias("y"), (F.col(x) - 1).alias("x"), F.lit(sign).alias("sign"))
    asked = boxes.withColumn("_c", F.explode(F.array(corner("y2", "x2", 1), corner("y1", "x2", -1), corner("y2", "x1", -1), corner("y1", "x1", 1))))
    whole = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    asked = asked.select(page, "box_id", "name", F.col("_c.y").alias("y"), F.col("_c.x").alias("x"), F.when(whole, F.col("_c.sign")).otherwise(0).alias("_sign"))
    found = asked.join(table, [page, "y", "x"], "left")
    return found.groupBy(page, "box_id", "name").agg(F.sum(F.coalesce(F.col("total") * F.col("_sign"), F.lit(0))).alias("total"))


def inset(share: float = 0.15) -> list[Column]:
    """A box without a share of its size on each side."""
    ix, iy = ((F.col(f"{a}2") - F.col(f"{a}1")) * F.lit(share) for a in "xy")
    ix, iy = ix.cast("int"), iy.cast("int")
    return [(F.col("x1") + ix).alias("x1"), (F.col("y1") + iy).alias("y1"), (F.col("x2") - ix).alias("x2"), (F.col("y2") - iy).alias("y2")]


def ring(margin: Column, width: Column, height: Column) -> list[Column]:
    """A box with a margin around it, as far as the page goes."""
    return [F.greatest(F.lit(0), F.col("x1") - margin).alias("x1"), F.greatest(F.lit(0), F.col("y1") - margin).alias("y1"), F.least(width, F.col("x2") + margin).alias("x2"), F.least(height, F.col("y2") + margin).alias("y2")]


def ink_shares(table: DataFrame, boxes: DataFrame, page: str, side: Column, width: Column, height: Column, share: float = 0.15, grow: float = 0.4, least: int = 3) -> DataFrame:
    """(page, box_id, ink, ring): the share of ink inside a box without its rim, and in the ring around it; 0 where there is no place."""
    margin = F.greatest(F.lit(least), (side * F.lit(grow)).cast("int"))
    kinds = {"own": [F.col(c) for c in ("x1", "y1", "x2", "y2")], "inset": inset(share), "ring": ring(margin, width, height)}
    asked = [boxes.select(page, "box_id", F.lit(name).alias("name"), *corners) for name, corners in kinds.items()]
    every = asked[0].unionByName(asked[1]).unionByName(asked[2])
    places = F.greatest(F.lit(0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0), F.col("y2") - F.col("y1"))
    got = box_sums(table, every, page).join(every.select(page, "box_id", "name", places.alias("n")), [page, "box_id", "name"])
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    got = got.groupBy(page, "box_id").agg(*[of(k, c).alias(f"_{k}_{c}") for k in kinds for c in ("total", "n")])
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return got.select(page, "box_id", part(F.col("_inset_total"), F.col("_inset_n")).alias("ink"), part(F.col("_ring_total") - F.col("_own_total"), F.col("_ring_n") - F.col("_own_n")).alias("ring"))
