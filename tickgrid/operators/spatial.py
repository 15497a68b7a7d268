"""Spatial joins. All meet in cells of a grid on the page; what is chosen one by one is chosen in rounds over all pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.functions.geometry import iou
from tickgrid.functions.lineage import as_dealt, cut, spool
from tickgrid.operators import grid

BOX = ("box_id", "x1", "y1", "x2", "y2", "is_checked")


def prefixed(df: DataFrame, prefix: str, *extra: str) -> DataFrame:
    return df.select("page_id", *[F.col(c).alias(prefix + c) for c in (*BOX, *extra) if c in df.columns])


def candidates(pred: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs on one page with IoU of at least ``least``."""
    both = grid.overlapping(prefixed(pred, "p_"), prefixed(gold, "g_", "ignore"), "p_", "g_", least)
    return both.withColumn("iou", iou("p_", "g_")).where(F.col("iou") >= least)


#: What matching and its counts need of a pair.
NARROW = ("page_id", "p_box_id", "g_box_id", "iou", "p_is_checked", "g_is_checked", "g_ignore")


def weighed(pairs: DataFrame) -> DataFrame:
    """pairs with _of_p and _of_g, the pairs of their prediction and of their label, in the shared folder.

    Pairs of sides that are dealt by page are found without another shuffle.
    """
    of = lambda side: F.count("*").over(W.partitionBy("page_id", f"{side}_box_id")).cast("int")
    with as_dealt(pairs.sparkSession):
        return spool(pairs.withColumns({"_of_p": of("p"), "_of_g": of("g")}))


def chosen(told: DataFrame) -> DataFrame:
    """One-to-one pairs of what weighed() gave, largest IoU first, then prediction and label order.

    Pairs that share no end with another are chosen at once. A pair that comes first among those of both its ends is chosen
    whatever else is, so each round takes all such pairs of all pages and drops the others with one of their ends: the
    rounds end with the longest chain of ever better pairs. The rest is dealt by page once. No page is gathered into a row.
    """
    columns = [c for c in told.columns if c not in ("_of_p", "_of_g")]
    order = (F.desc("iou"), F.asc("p_box_id"), F.asc("g_box_id"))
    of_p, of_g = W.partitionBy("page_id", "p_box_id"), W.partitionBy("page_id", "g_box_id")
    alone = (F.col("_of_p") == 1) & (F.col("_of_g") == 1)
    out, rest = told.where(alone).select(*columns), told.where(~alone).select(*columns)
    if rest.isEmpty():
        return out
    rest = rest.repartition("page_id")
    while True:
        own = rest.withColumn("_p", F.row_number().over(of_p.orderBy(*order))).withColumn("_g", F.row_number().over(of_g.orderBy(*order)))
        own = own.withColumn("_taken", (F.col("_p") == 1) & (F.col("_g") == 1)).withColumn("_lost", F.bool_or("_taken").over(of_g))
        own = own.withColumn("_lost", F.bool_or("_taken").over(of_p) | F.col("_lost")).where("_taken OR NOT _lost")
        round_ = cut(own.select(*columns, "_taken"))
        out, rest = out.unionByName(round_.where("_taken").drop("_taken")), round_.where("NOT _taken").drop("_taken")
        if rest.isEmpty():
            return out


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs, largest IoU first, then prediction and label order."""
    return chosen(weighed(pairs))


def match_counts(pred: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """A row per page with counts: preds, golds, ignored (labels), matched, matched_ignored, and right (matched, not ignored, same state)."""
    return counts(pred, gold, greedy_match(candidates(pred, gold, least).select(*NARROW)))


def counts(pred: DataFrame, gold: DataFrame, m: DataFrame) -> DataFrame:
    """The row per page of match_counts() for pairs that are chosen already; each side is counted before the sides meet."""
    names = ("preds", "golds", "ignored", "matched", "matched_ignored", "right")
    ignore, g_ignore = F.coalesce("ignore", F.lit(False)), F.coalesce("g_ignore", F.lit(False))
    row = lambda df, **n: df.groupBy("page_id").agg(*[F.sum(n[c].cast("long")).alias(c) if c in n else F.lit(0).cast("long").alias(c) for c in names])
    told = row(pred, preds=F.lit(1)).unionByName(row(gold, golds=F.lit(1), ignored=ignore)).unionByName(row(m, matched=F.lit(1), matched_ignored=g_ignore, right=~g_ignore & (F.col("p_is_checked") == F.col("g_is_checked"))))
    return told.groupBy("page_id").agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in names])


def first_match(pairs: DataFrame) -> DataFrame:
    """The first label in label order for each prediction; a label may serve several."""
    return pairs.where("NOT g_ignore").withColumn("_r", F.row_number().over(W.partitionBy("page_id", "p_box_id").orderBy("g_box_id"))).where("_r = 1").drop("_r")


def centres(boxes: DataFrame, *extra: str) -> DataFrame:
    """page_id, the boxes' columns with b_ before them, and the centre (_x, _y)."""
    return prefixed(boxes, "b_", *extra).withColumns({"_x": middle_of("b_", "x"), "_y": middle_of("b_", "y")})


def middle_of(prefix: str, axis: str) -> Column:
    return (F.col(f"{prefix}{axis}1") + F.col(f"{prefix}{axis}2")).cast("double") / 2


def near(points: DataFrame, boxes: DataFrame, radius: float, how: str = "left") -> DataFrame:
    """The first box in reading order whose centre lies within the L1 radius (exclusive) of a point (point_id, cx, cy)."""
    hit = grid.within(points.select("page_id", "point_id", "cx", "cy"), centres(boxes), "cx", "cy", "_x", "_y", radius, closed=False)
    first = hit.groupBy("page_id", "point_id").agg(F.min(F.struct("b_y1", "b_x1", "b_box_id", *[c for c in ("b_x2", "b_y2", "b_is_checked")])).alias("_b"))
    first = first.select("page_id", "point_id", *[F.col(f"_b.b_{c}").alias(f"b_{c}") for c in BOX])
    return points.join(first, ["page_id", "point_id"], how)


def nearest(points: DataFrame, boxes: DataFrame, most: Column, start: float = 33.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The nearest box by L1 for each point, null beyond ``most``: there a square() around the point stands in.

    Points look in rings: those without a box within the radius look again within four times that, until each has found
    one; points on pages without boxes have none. Later rings are held against the boxes of the open points' pages alone.
    Points and boxes that are dealt by page meet without another shuffle. ``keep``: columns of the points to carry.
    """
    columns = list(dict.fromkeys(["page_id", "point_id", "cx", "cy", *keep]))
    own = centres(boxes).select("page_id", "b_box_id", "_x", "_y")
    far = F.abs(F.col("cx") - F.col("_x")) + F.abs(F.col("cy") - F.col("_y"))
    met = lambda p, o, r: grid.within(p.select("page_id", "point_id", "cx", "cy"), o, "cx", "cy", "_x", "_y", r).groupBy("page_id", "point_id").agg(F.min(F.struct(far.alias("far"), "b_box_id")).alias("m"))
    ring = lambda p, o, r: p.join(met(p, o, r), ["page_id", "point_id"], "left")
    with as_dealt(points.sparkSession):
        told = spool(ring(points.select(*columns), own, start))
        found, open_ = told.where("m IS NOT NULL"), told.where("m IS NULL").drop("m")
        if not open_.isEmpty():
            own = cut(own.join(open_.select("page_id").distinct(), "page_id", "left_semi"))
            able = own.select("page_id").distinct()
            found = found.unionByName(open_.join(able, "page_id", "left_anti").withColumn("m", F.lit(None).cast(told.schema["m"].dataType)))
            open_, radius = open_.join(able, "page_id", "left_semi"), start * 4
            while not open_.isEmpty():
                told = cut(ring(open_, own, radius))
                found = found.unionByName(told.where("m IS NOT NULL"))
                open_, radius = told.where("m IS NULL").drop("m"), radius * 4
    return found.select("page_id", "point_id", *keep, F.when(F.col("m.far") <= most, F.col("m.b_box_id")).alias("box_id"), F.col("m.far").alias("far"))


def square(cx: Column, cy: Column, side: Column) -> list[Column]:
    """Corners of the square that stands for a point without a box near it."""
    half = F.floor(side / 2)
    return [(v + sign * half).cast("long").alias(name) for name, v, sign in (("x1", cx, -1), ("y1", cy, -1), ("x2", cx, 1), ("y2", cy, 1))]


def as_points(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"point_id": F.col("box_id"), "_ax": middle_of("", "x"), "_ay": middle_of("", "y")})


def apart(boxes: DataFrame, others: DataFrame, most: float) -> DataFrame:
    """Boxes whose centre is further than ``most`` by L1 from all others of the page."""
    own = others.select("page_id", middle_of("", "x").alias("_bx"), middle_of("", "y").alias("_by"))
    return grid.within(as_points(boxes), own, "_ax", "_ay", "_bx", "_by", most, how="left_anti").drop("point_id", "_ax", "_ay")


def corrected(boxes: DataFrame, fixes: DataFrame, most: float) -> DataFrame:
    """boxes after corrections (page_id, at, cx, cy, kind drop or flip, state), each for all boxes within ``most`` on both axes.

    Drops come first; of several flips of one box the last, by ``at``, decides.
    """
    hit = grid.within(as_points(boxes).select("page_id", "box_id", "_ax", "_ay"), fixes, "_ax", "_ay", "cx", "cy", most, metric="axes")
    hit = hit.groupBy("page_id", "box_id").agg(F.bool_or(F.col("kind") == "drop").alias("_gone"), F.max(F.when(F.col("kind") == "flip", F.struct("at", "state"))).alias("_flip"))
    out = boxes.join(hit, ["page_id", "box_id"], "left").where("NOT coalesce(_gone, false)")
    return out.withColumn("is_checked", F.coalesce("_flip.state", "is_checked")).select(*boxes.columns)


def folded(labels: DataFrame, cards: DataFrame, most: float) -> DataFrame:
    """labels with the answers of the cards (page_id, point_id, cx, cy, label) within ``most`` by L1, in the order of point_id.

    The last filled or empty gives the state; the last answer of all says whether the label is ignored: a state clears it.
    """
    at = as_points(labels).select("page_id", "box_id", "_ax", "_ay")
    state = F.when(F.col("label").isin("filled", "empty"), F.struct("point_id", (F.col("label") == "filled").alias("v")))
    hit = grid.within(at, cards, "_ax", "_ay", "cx", "cy", most).groupBy("page_id", "box_id").agg(F.max(state).alias("_state"), F.max(F.struct("point_id", (~F.col("label").isin("filled", "empty")).alias("v"))).alias("_last"))
    out = labels.join(hit, ["page_id", "box_id"], "left")
    return out.withColumns({"is_checked": F.coalesce("_state.v", "is_checked"), "ignore": F.coalesce("_last.v", "ignore")}).select(*labels.columns)


def page_lists(boxes: DataFrame, *order: Column) -> DataFrame:
    """page_id and ``all``: the page's boxes as structs in the order of the keys (_k0, _k1, ...), then of the columns."""
    keys = [k.alias(f"_k{i}") for i, k in enumerate(order)]
    return boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*keys, *[c for c in boxes.columns if c != "page_id"]))).alias("all"))


def middle(b: Column, axis: str) -> Column:
    return (b[f"{axis}1"] + b[f"{axis}2"]).cast("double") / 2


def dedupe(boxes: DataFrame, tolerance: float) -> DataFrame:
    """First-wins: a box stays if its centre is further than the L1 tolerance from all kept boxes of the page, in box order.

    The boxes that stay are the first maximal independent set of the graph of near boxes. Each round keeps all boxes whose
    near ones all come later, and these fall; rounds end when no box is open, after the longest chain of boxes that wait for
    each other. Boxes on one centre share their fate but for the first, so only that one is in the graph. Repeated box ids
    of a page are told apart by their corners. Boxes that are dealt by page meet without another shuffle.
    """
    key = F.struct("box_id", "x1", "y1", "x2", "y2")
    own = boxes.withColumns({"_x": middle_of("", "x"), "_y": middle_of("", "y")})
    first = own.groupBy("page_id", "_x", "_y").agg(F.min_by(F.struct(*[c for c in boxes.columns if c != "page_id"]), key).alias("_b"))
    first = first.select("page_id", "_x", "_y", "_b.*").withColumn("_k", key)
    node = lambda p: first.select("page_id", F.col("_k").alias(p), F.col("_x").alias(f"{p}x"), F.col("_y").alias(f"{p}y"))
    gone = None
    with as_dealt(boxes.sparkSession):
        edges = cut(grid.within(node("a"), node("b"), "ax", "ay", "bx", "by", tolerance, extra=F.col("a") < F.col("b")).select("page_id", "a", "b"))
        while not edges.isEmpty():
            end = lambda df, c: df.select("page_id", F.col(c).alias("_e")).distinct()
            stays = end(edges, "a").join(end(edges, "b"), ["page_id", "_e"], "left_anti").withColumnRenamed("_e", "a")
            fell = cut(edges.join(stays, ["page_id", "a"]).select("page_id", F.col("b").alias("_k")).distinct())
            gone = fell if gone is None else gone.unionByName(fell)
            for c in ("b", "a"):
                edges = edges.join(fell.withColumnRenamed("_k", c), ["page_id", c], "left_anti")
            edges = cut(edges.select("page_id", "a", "b"))
        kept = first if gone is None else spool(first.join(gone, ["page_id", "_k"], "left_anti").select(*boxes.columns))
    return kept.select(*boxes.columns)


def row_clusters(boxes: DataFrame, tolerance: float) -> DataFrame:
    """Rows of boxes by centre height: a box joins the row while it is within the tolerance of the row's first box."""

    def step(acc: Column, b: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(middle(b, "y") - acc["anchor"]) >= tolerance)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(F.when(new, middle(b, "y")).otherwise(acc["anchor"]).alias("anchor"), row.alias("row"), F.concat(acc["ids"], F.array(row)).alias("ids"))

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("ids"))
    pages = page_lists(boxes, (F.col("y1") + F.col("y2")).cast("double") / 2, F.col("x1"), F.col("box_id"))
    pages = pages.select("page_id", "all", F.aggregate("all", start, step, lambda acc: acc["ids"]).alias("ids"))
    one = pages.select("page_id", F.posexplode(F.arrays_zip("all", "ids")).alias("_at", "z")).select("page_id", "z.all", "z.ids")
    return one.select(*["page_id" if c == "page_id" else f"all.{c}" for c in boxes.columns], F.col("ids").alias("row_id"))


def align(template: list[tuple[float, float]], page: list[tuple[float, float]], lookback: int = 4, skip: float = 0.3, slopes: tuple[float, float] = (0.45, 2.2), least: int = 2) -> list[tuple[int, int]]:
    """Monotone local alignment of two weighted sequences of ``least`` or more: pairs of places, best total gain less skips."""
    n, m = len(template), len(page)
    if min(n, m) < least:
        return []
    best, back = np.zeros((n, m)), {}
    for i in range(n):
        for j in range(m):
            (ty, tw), (py, pw) = template[i], page[j]
            gain = min(tw, pw) / max(tw, pw) if max(tw, pw) > 0 else 0.0
            top, source = gain, None
            for a in range(max(0, i - lookback), i):
                for b in range(max(0, j - lookback), j):
                    rise = ty - template[a][0]
                    if rise > 0 and slopes[0] <= (py - page[b][0]) / rise <= slopes[1]:
                        total = best[a, b] + gain - skip * (i - a - 1 + j - b - 1)
                        if total > top:
                            top, source = total, (a, b)
            best[i, j], back[i, j] = top, source
    at, out = tuple(int(x) for x in np.unravel_index(best.argmax(), best.shape)), []
    while at is not None:
        out.append(at)
        at = back[at]
    return out[::-1]


def knots_of(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Pairs of heights as knots of a map: each above the one before on both sides."""
    out: list[tuple[float, float]] = []
    for t, p in pairs:
        if not out or (t > out[-1][0] and p > out[-1][1]):
            out.append((t, p))
    return out


def best_form(registrations: DataFrame, least_pairs: int = 3, floor: float = 0.35) -> DataFrame:
    """Each page's best registration: enough pairs, a score of the floor or more, ties to the first name."""
    good = registrations.where((F.col("pairs") >= least_pairs) & (F.size("knots") >= 3) & (F.col("score") >= floor))
    return good.withColumn("_r", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "form"))).where("_r = 1").drop("_r")
