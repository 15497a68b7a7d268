"""Pages for tests and for the bench: rows of boxes on white, some with a mark, whole or harmed in one of a few plain ways.

What is drawn follows from the page's name alone, so a page is the same whatever task draws it.
"""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickgrid.operators.patches import area_resized

BOX = "struct<x1: int, y1: int, x2: int, y2: int>"
SCHEMA = "page string, factor string, height int, width int, channels int, pixels binary, boxes array<struct<x1: int, y1: int, x2: int, y2: int, is_checked: boolean>>"
#: Marks as polylines in a box of side 1.
MARKS = ([(0.1, 0.1), (0.9, 0.9), (0.5, 0.5), (0.9, 0.1), (0.1, 0.9)], [(0.15, 0.5), (0.4, 0.85), (0.95, 0.1)], [(0.25, y) if k % 2 else (0.75, y) for y in np.linspace(0.25, 0.75, 9) for k in (0, 1)])


def blank(height, width, boxes, border=2):
    img = np.full((height, width, 3), 255, np.uint8)
    for x1, y1, x2, y2 in boxes:
        img[y1:y2, x1:x2] = 0
        img[y1 + border : y2 - border, x1 + border : x2 - border] = 255
    return img


def drawn(img, points, half=1, grey=40):
    """A polyline as squares along its way."""
    for (ax, ay), (bx, by) in zip(points[:-1], points[1:], strict=True):
        for t in np.linspace(0, 1, int(max(abs(bx - ax), abs(by - ay))) + 2):
            x, y = round(ax + t * (bx - ax)), round(ay + t * (by - ay))
            img[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1] = grey


def turned(img, boxes, degrees):
    """The page turned about its upper left corner, and boxes around the turned ones."""
    a = np.radians(degrees)
    there = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    y, x = np.indices(img.shape[:2])
    sx, sy = np.rint(np.tensordot(there.T, np.stack([x, y]), 1)).astype(int)
    seen = (sx >= 0) & (sy >= 0) & (sx < img.shape[1]) & (sy < img.shape[0])
    out = np.where(seen[..., None], img[np.where(seen, sy, 0), np.where(seen, sx, 0)], 255).astype(np.uint8)
    corners = np.stack([boxes[:, [i, j]] @ there.T for i in (0, 2) for j in (1, 3)])
    return out, np.hstack([np.floor(corners.min(0)), np.ceil(corners.max(0))]).astype(int)


def harmed(img, boxes, factor, r):
    for one in factor.split("+"):
        if one == "rotation":
            img, boxes = turned(img, boxes, 1.0)
        elif one == "scale":
            img, boxes = area_resized(img, int(img.shape[0] * 0.8), int(img.shape[1] * 0.8)), np.rint(boxes * 0.8).astype(int)
        elif one == "shadow":
            img = (img * np.linspace(1, 0.75, img.shape[1])[None, :, None]).astype(np.uint8)
        elif one == "pen":
            h, w = img.shape[:2]
            drawn(img, [(0, r.integers(h)), (w - 1, r.integers(h))])
    return img, boxes


FACTORS = ("base", "shadow", "pen", "rotation", "scale", "shadow+rotation", "pen+scale", "shadow+pen")


def pages(spark, boxes, height=600, width=1500, copies=1):
    """copies of a page for every factor, drawn in tasks."""
    names = spark.range(copies).crossJoin(spark.createDataFrame([(f,) for f in FACTORS], "factor string")).select(F.concat_ws("-", "factor", "id").alias("page"), "factor")

    def run(batches):
        for batch in batches:
            for page, factor in zip(batch["page"], batch["factor"], strict=True):
                marks, harm = np.random.default_rng(zlib.crc32(page.split("-")[1].encode())), np.random.default_rng(zlib.crc32(page.encode()))
                img, checked = blank(height, width, boxes), marks.random(len(boxes)) < 0.4
                for (x1, y1, x2, y2), on in zip(boxes, checked, strict=True):
                    if on:
                        drawn(img, [(x1 + a * (x2 - x1), y1 + b * (y2 - y1)) for a, b in MARKS[marks.integers(len(MARKS))]])
                img, moved = harmed(img, np.array(boxes), factor, harm)
                told = [{**dict(zip(("x1", "y1", "x2", "y2"), map(int, b), strict=True)), "is_checked": bool(on)} for b, on in zip(moved, checked, strict=True)]
                yield pd.DataFrame([(page, factor, img.shape[0], img.shape[1], 3, img.tobytes(), told)], columns=["page", "factor", "height", "width", "channels", "pixels", "boxes"])

    return names.repartition(16, "page").mapInPandas(run, SCHEMA)


def labels(pages):
    one = pages.select("page", "factor", F.posexplode("boxes").alias("box_id", "b"))
    return one.select("page", "factor", "box_id", "b.*", F.lit(False).alias("ignore"))
