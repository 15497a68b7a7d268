"""What leaves the engine: responses, reports as JSON and markdown, PNG overlays and crops."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Fixed values, blue first: marked, empty, any box with a reason; in evaluation missed labels and spare boxes.
GREEN, RED, AMBER, MAGENTA, YELLOW = (0, 170, 0), (0, 0, 220), (0, 160, 255), (255, 0, 255), (0, 255, 255)
MARKS = {"missed": MAGENTA, "spare": YELLOW}


def png(img: np.ndarray) -> bytes:
    """A grey or BGR image as PNG."""
    rows = np.ascontiguousarray(img if img.ndim == 2 else img[:, :, ::-1]).reshape(img.shape[0], -1)
    body = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 0 if img.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def outline(img: np.ndarray, box: tuple[int, int, int, int], colour: tuple, thick: int) -> None:
    x1, y1, x2, y2 = (max(0, v) for v in box)
    for part in (img[y1 : y1 + thick, x1:x2], img[max(y1, y2 - thick) : y2, x1:x2], img[y1:y2, x1 : x1 + thick], img[y1:y2, max(x1, x2 - thick) : x2]):
        part[:] = colour


def bgr(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    x = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, :3].copy()


def nested(boxes: DataFrame, explain: bool = False) -> DataFrame:
    """page and its boxes in reading order, as the response states them."""
    fields = [F.array("x1", "y1", "x2", "y2").alias("bbox"), "is_checked"] + (["confidence", "ink", "reasons", *[c for c in ("witnesses",) if c in boxes.columns]] if explain else [])
    own = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "box_id", F.struct(*fields).alias("b")))).alias("_b"))
    return own.select("page", F.transform("_b", lambda x: x["b"]).alias("boxes"))


def responses(pages: DataFrame, boxes: DataFrame, explain: bool = False) -> DataFrame:
    """(page, body): the JSON answer for every page, also for those without boxes."""
    out = pages.select("page", *[c for c in ("width", "height") if explain]).join(nested(boxes, explain), "page", "left")
    kind = nested(boxes, explain).schema["boxes"].dataType.simpleString()
    fields = [F.coalesce("boxes", F.array().cast(kind)).alias("boxes")]
    if explain and "meta" in boxes.columns:
        out = out.join(boxes.groupBy("page").agg(F.first("meta").alias("m")), "page", "left")
        fields.append(F.struct("width", "height", "m.form", "m.registration", F.col("m.stats").alias("witness")).alias("meta"))
    return out.select("page", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))


def eval_layers(boxes: DataFrame, missed: DataFrame, spare: DataFrame) -> DataFrame:
    """Boxes for an overlay that shows what matching found: labels without a box, and boxes without a label, over the rest."""
    corners = ["page", "x1", "y1", "x2", "y2"]
    graded = boxes.select(*corners, "is_checked", "reasons", F.lit(None).cast("string").alias("mark"))
    extra = lambda df, name: df.select(*corners, F.lit(False).alias("is_checked"), F.array().cast("array<string>").alias("reasons"), F.lit(name).alias("mark"))
    return graded.unionByName(extra(spare, "spare")).unionByName(extra(missed, "missed"))


def overlays(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, png): every page with its boxes outlined by their state, or by their mark if they have one."""
    mark = F.col("mark") if "mark" in boxes.columns else F.lit(None).cast("string")
    own = boxes.groupBy("page").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "is_checked", (F.size("reasons") > 0).alias("flagged"), mark.alias("mark"))).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                img = bgr(p.pixels, p.height, p.width, p.channels)
                for b in p.b if p.b is not None else ():
                    outline(img, (b["x1"], b["y1"], b["x2"], b["y2"]), MARKS[b["mark"]] if b["mark"] else AMBER if b["flagged"] else GREEN if b["is_checked"] else RED, max(2, p.width // 900))
                yield pd.DataFrame({"page": [p.page], "png": [png(img)]})

    return pages.join(own, "page", "left").select("page", "height", "width", "channels", "pixels", "b").mapInPandas(run, "page string, png binary")


def crop(img: np.ndarray, box: tuple[int, int, int, int], grow: float = 2.2, least: int = 260) -> np.ndarray:
    """The box with its surroundings, enlarged in whole-pixel steps and outlined, for a second look."""
    x1, y1, x2, y2 = box
    gx, gy = int(grow * (x2 - x1)), int(grow * (y2 - y1))
    left, top = max(0, x1 - gx), max(0, y1 - gy)
    part = img[top : y2 + gy, left : x2 + gx]
    f = max(1.0, least / (5 * max(1, x2 - x1)))
    rows, cols = (np.minimum((np.arange(int(n * f)) / f).astype(int), n - 1) for n in part.shape[:2])
    out = part[rows][:, cols].copy()
    outline(out, tuple(int(v * f) for v in (x1 - left, y1 - top, x2 - left, y2 - top)), MAGENTA, 2)
    return out


def public(df: DataFrame) -> DataFrame:
    """df without the columns that are its own business: those whose names start with _."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def slim(cards: DataFrame) -> DataFrame:
    """What a labelling page needs of a card, and nothing that gives its answer away."""
    return cards.select("id", "source", "bbox", "png")


def crops(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, box_id, png, key) for every given box; the key names the crop in the record of votes."""
    own = boxes.groupBy("page").agg(F.collect_list(F.struct("box_id", "x1", "y1", "x2", "y2")).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                img = bgr(p.pixels, p.height, p.width, p.channels)
                yield pd.DataFrame([(p.page, b["box_id"], png(crop(img, (b["x1"], b["y1"], b["x2"], b["y2"])))) for b in p.b], columns=["page", "box_id", "png"])

    made = pages.join(own, "page").select("page", "height", "width", "channels", "pixels", "b").mapInPandas(run, "page string, box_id int, png binary")
    return made.withColumn("key", F.substring(F.sha1("png"), 1, 16))


def markdown(report: DataFrame, order: str, path: str) -> None:
    """A report as a markdown table at a path, in order."""
    from tickgrid.sources.markdown import MarkdownTables

    report.sparkSession.dataSource.register(MarkdownTables)
    report.orderBy(order).write.format("markdown").mode("overwrite").save(path)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and figures that are gathered in the same pass by whatever action runs on it first."""
    told = Observation(name)
    return df.observe(told, *[c.alias(k) for k, c in metrics.items()]), told


def held(claims: DataFrame) -> DataFrame:
    """claims (name, stated, measured, holds) as they are; a row that doesn't hold fails whatever reads it, with both figures."""
    wrong = F.raise_error(F.concat_ws("", F.lit("claim "), "name", F.lit(": stated "), "stated", F.lit(", measured "), F.coalesce("measured", F.lit("nothing"))))
    return claims.withColumn("holds", F.when(F.coalesce("holds", F.lit(False)), F.lit(True)).otherwise(wrong.cast("boolean")))


def json_report(report: DataFrame, path: str) -> None:
    """A report as one JSON-lines file; reports are aggregates of a few rows."""
    report.coalesce(1).write.mode("overwrite").json(path)
