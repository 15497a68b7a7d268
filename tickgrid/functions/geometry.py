"""Box arithmetic as column expressions; boxes are x1, y1, x2, y2, the second corner exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corners(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes with the prefixes a and b; 0 where they don't overlap."""
    ax1, ay1, ax2, ay2 = corners(a)
    bx1, by1, bx2, by2 = corners(b)
    both = F.greatest(F.lit(0), F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(F.lit(0), F.least(ay2, by2) - F.greatest(ay1, by1))
    either = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - both
    return F.when(both > 0, both.cast("double") / either.cast("double")).otherwise(F.lit(0.0))


def centre(prefix: str = "") -> tuple[Column, Column]:
    x1, y1, x2, y2 = corners(prefix)
    return (x1 + x2).cast("double") / 2, (y1 + y2).cast("double") / 2


def manhattan(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.abs(ax - bx) + F.abs(ay - by)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 for a zero bottom."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def image_tokens(w: Column, h: Column, patch: int = 28) -> Column:
    return F.ceil(w / patch) * F.ceil(h / patch)


def piecewise(knots: Column, y: Column) -> Column:
    """Linear map through knots array<struct<ty, py>> in order; outside, the end slopes carry on, over runs held at one at least."""
    n = F.size(knots)
    at = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(knots, lambda k: k["ty"] <= y))))
    a, b = F.element_at(knots, at), F.element_at(knots, at + 1)
    first, last = F.element_at(knots, 1), F.element_at(knots, -1)
    run, rise = b["ty"] - a["ty"], b["py"] - a["py"]
    slope = rise / F.greatest(F.lit(1.0), run)
    return F.when(y <= first["ty"], first["py"] + (y - first["ty"]) * slope).when(y >= last["ty"], last["py"] + (y - last["ty"]) * slope).otherwise(a["py"] + (y - a["ty"]) * rise / run)


def lenient_json(text: Column, schema: str) -> Column:
    """The object between the first { and the last } of a text, or null where that is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), F.from_json(found, schema))


def verdict(reply: Column) -> Column:
    """A reader's verdict in a reply, with the defaults for what it leaves out but for ``filled``, which then is null; null for a reply without one."""
    d = lenient_json(reply, "is_checkbox boolean, filled boolean, confidence double, why string")
    return F.when(d.isNotNull(), F.struct(
        F.coalesce(d["is_checkbox"], F.lit(False)).alias("is_checkbox"), d["filled"].alias("filled"),
        F.coalesce(d["confidence"], F.lit(0.5)).alias("confidence"), F.substring(F.coalesce(d["why"], F.lit("")), 1, 120).alias("why"),
    ))


def stated_numbers(claims: DataFrame) -> DataFrame:
    """claims (name, claim) with ``stated``, the first number of the text without its thousands separators."""
    return claims.withColumn("stated", F.replace(F.regexp_extract("claim", r"[0-9][0-9,]*(\.[0-9]+)?", 0), F.lit(","), F.lit("")))


def human(code: Column, names: dict[str, str]) -> Column:
    """A label for a code: its name, or the code in lower case with blanks."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(known[code], F.lower(F.replace(code, F.lit("_"), F.lit(" "))))


def resized(w: Column, h: Column, edge: int, tokens: int, patch: int = 28) -> Column:
    """(w, h) of an image within an edge and a number of tokens, its shape kept; itself if it fits.

    The longer edge is found by halving an interval, as many times as the largest edge needs.
    """
    whole = lambda v: F.ceil(v / patch)
    fits = lambda a, b: (whole(a) * patch <= edge) & (whole(b) * patch <= edge) & (whole(a) * whole(b) <= tokens)
    long, short = F.greatest(w, h), F.least(w, h)
    other = lambda a: F.greatest(F.bround(a / (long.cast("double") / short), 0).cast("long"), F.lit(1).cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("lo"), long.cast("long").alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2)
        ok, done = fits(mid, other(mid)), acc["lo"] + 1 >= acc["hi"]
        return F.struct(F.when(~done & ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(~done & ~ok, mid).otherwise(acc["hi"]).alias("hi"))

    lo = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve, lambda acc: acc["lo"])
    a, b = F.when(fits(w, h), long).otherwise(lo), F.when(fits(w, h), short).otherwise(other(lo))
    return F.struct(F.when(h > w, b).otherwise(a).alias("w"), F.when(h > w, a).otherwise(b).alias("h"))
