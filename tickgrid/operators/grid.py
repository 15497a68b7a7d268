"""A grid index for spatial joins: boxes and points meet in the cells that they touch, so a page is never paired with itself.

Boxes that overlap enough have larger sides within a factor of each other, so each box is entered at the levels of cells
where such a partner may be: cells of a level are at least as wide as the boxes of that level, and a box touches four at
most. A pair is told in one cell only: at the larger box's level, the one that holds the near corner of what both share.

Points within a distance of each other meet in cells as wide as that distance: one side is entered in the cell of its
point, the other in all cells that its square touches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least level: cells of 128 pixels, some times the size of most boxes, so that most lie in one.
LEAST = 7


def level(side: Column) -> Column:
    """The level of cells for boxes with this larger side: cells of 2**level pixels hold it."""
    return F.greatest(F.lit(LEAST), F.ceil(F.log2(side.cast("double"))).cast("int"))


def _cells(low: Column, high: Column, side: Column | float) -> Column:
    return F.sequence(F.floor(low / side), F.floor(high / side))


def touched(boxes: DataFrame, prefix: str, least: float) -> DataFrame:
    """boxes once for every cell (_level, _cx, _cy) in which a partner with IoU of ``least`` may be met; boxes without area go."""
    x1, y1, x2, y2 = (F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))
    side = F.greatest(x2 - x1, y2 - y1)
    out = boxes.where((x2 > x1) & (y2 > y1)).withColumn("_level", F.explode(F.sequence(level(side), level(side / F.lit(least)))))
    wide = F.call_function("shiftleft", F.lit(1), F.col("_level"))
    return out.withColumn("_cx", F.explode(_cells(x1, x2 - 1, wide))).withColumn("_cy", F.explode(_cells(y1, y2 - 1, wide)))


def overlapping(left: DataFrame, right: DataFrame, a: str, b: str, least: float, page: str = "page_id") -> DataFrame:
    """Pairs of boxes on one page that share some area and whose larger sides lie within the factor 1 / least; each pair once.

    Pairs of an IoU of ``least`` or more are among them.
    """
    if not 0 < least <= 1:
        raise ValueError("the least IoU lies above 0 and is at most 1")
    both = touched(left, a, least).join(touched(right, b, least), [page, "_level", "_cx", "_cy"])
    col = lambda p, c: F.col(f"{p}{c}")
    side = lambda p: F.greatest(col(p, "x2") - col(p, "x1"), col(p, "y2") - col(p, "y1"))
    wide = F.call_function("shiftleft", F.lit(1), F.col("_level"))
    own = [F.col("_level") == F.greatest(level(side(a)), level(side(b)))]
    for axis in "xy":
        near, far = F.greatest(col(a, f"{axis}1"), col(b, f"{axis}1")), F.least(col(a, f"{axis}2"), col(b, f"{axis}2"))
        own += [near < far, F.floor(near / wide) == F.col(f"_c{axis}")]
    hit = own[0]
    for c in own[1:]:
        hit = hit & c
    return both.where(hit).drop("_level", "_cx", "_cy")


def within(points: DataFrame, others: DataFrame, x: str, y: str, ox: str, oy: str, radius: float, how: str = "inner", metric: str = "l1", closed: bool = True, page: str = "page_id", extra: Column | None = None) -> DataFrame:
    """points joined to the others of their page within the radius (L1, or the larger of both axes; closed or open).

    A point's square is entered in all cells that it touches, and the others in the one of their point, so each pair meets
    once. With ``how`` left or left_anti the pairs are found first, since a point has several cells; points then need ids
    (point_id) that are theirs alone on the page.
    """
    wide = max(1.0, math.ceil(2 * radius))
    at = others.withColumnRenamed(page, "_page").withColumns({"_cx": F.floor(F.col(ox) / wide), "_cy": F.floor(F.col(oy) / wide)})
    dx, dy = F.abs(F.col(x) - F.col(ox)), F.abs(F.col(y) - F.col(oy))
    far = dx + dy if metric == "l1" else F.greatest(dx, dy)
    hit = (far <= radius) if closed else (far < radius)
    grown = points if how == "inner" else points.select(page, "point_id", x, y)
    for c, v in (("_px", x), ("_py", y)):
        grown = grown.withColumn(c, F.explode(_cells(F.col(v) - radius, F.col(v) + radius, wide)))
    on = (F.col(page) == F.col("_page")) & (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & hit
    met = grown.join(at, on if extra is None else on & extra).drop("_px", "_py", "_cx", "_cy", "_page")
    if how == "inner":
        return met
    met = met.drop(x, y)
    return points.join(met, [page, "point_id"], how)
