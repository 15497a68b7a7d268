"""A registered form as a second witness: its boxes confirm, add or question the detected ones, page by page.

Rows of the form are taken in reading order and a detection serves one row only, so each page is one ordered pass; a page
is one row with its boxes as a list, so the kernel is a map, which takes the pages of a batch together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.operators.alignment import aligned, lists, numbers
from tickgrid.operators.spatial import align

STATS = "struct<projected: int, agree: int, template_only: int, detect_only: int, trusted: boolean>"
BOX = "box_id int, x1 int, y1 int, x2 int, y2 int, witnesses array<string>, reasons array<string>"
SCHEMA = f"page_id long, {BOX}, stats {STATS}"
CORNERS = ("x1", "y1", "x2", "y2")
WITNESSES = pa.array([["structure"], ["structure", "template"], ["template"]])
REASONS = pa.array([[], ["EXTRA_BOX"], ["MISSING_IN_DETECT"]], pa.list_(pa.string()))
#: Filled rows that a task remembers, at most.
KNOWN = 50_000


def mapped(knots: Sequence[tuple[float, float]], y: float) -> float:
    """Height on the page for a height on the form; the end slopes go on outside, with runs of at least one pixel."""
    t, p = np.array(knots, float).T
    at = int(np.clip(np.searchsorted(t, y, "right") - 1, 0, len(t) - 2))
    a = at if y < t[-1] else at + 1
    run = max(1.0, t[at + 1] - t[at]) if y <= t[0] or y >= t[-1] else t[at + 1] - t[at]
    return float(p[a] + (y - t[a]) * (p[at + 1] - p[at]) / run)


def reading_rows(boxes: np.ndarray, tolerance: float) -> list[np.ndarray]:
    """Boxes in rows, each row from left to right; a row is as high as the tolerance allows around its first box."""
    mid = (boxes[:, 1] + boxes[:, 3]) / 2
    out: list[list[int]] = []
    for i in np.lexsort((boxes[:, 0], mid)).tolist():
        if not out or abs(mid[i] - mid[out[-1][0]]) >= tolerance:
            out.append([])
        out[-1].append(i)
    return [boxes[r][np.argsort(boxes[r, 0], kind="stable")] for r in out]


def pair_row(form_x: np.ndarray, page_x: np.ndarray) -> list[tuple[int, int]]:
    """Places of a form row and of a band of detections that belong together: all of them if there are as many.

    A gap inside a row is cheaper to stretch than to skip (slopes up to 2.5), so it may be told as one at the row's end.
    """
    if len(form_x) == len(page_x):
        return [(i, i) for i in range(len(form_x))]
    return align([(float(x), 1.0) for x in form_x], [(float(x), 1.0) for x in page_x], lookback=3, skip=0.3, slopes=(0.4, 2.5), least=1)


def filled_in(row: np.ndarray, pairs: list[tuple[int, int]], page_x: np.ndarray, height: float) -> list[tuple[int, int, int, int]]:
    """Boxes of a row that no detection shows, by the line through the pairs' left edges."""
    seen = [i for i, _ in pairs]
    slope, start = np.polyfit(row[seen, 0], page_x[[j for _, j in pairs]], 1)
    out = []
    for i in sorted(set(range(len(row))) - set(seen)):
        wide, tall = row[i, 2] - row[i, 0], row[i, 3] - row[i, 1]
        x, w = start + slope * row[i, 0], wide * slope
        h = w / max(0.5, wide / tall)
        out.append((int(x), int(height - h / 2), int(x + w), int(height + h / 2)))
    return out


def place_page(found: np.ndarray, form: np.ndarray, knots: Sequence[tuple[float, float]], side: float, least: float = 0.75) -> tuple[np.ndarray, list[tuple[int, int, int, int]], dict]:
    """(confirmed detections, added boxes, figures); boxes are added only on a page whose form is trusted."""
    confirmed, added = np.zeros(len(found), bool), []
    (t0, p0), (t1, p1) = knots[0], knots[-1]
    mid = (found[:, 1] + found[:, 3]) / 2
    for row in reading_rows(form, 0.8 * side / max(1e-6, (p1 - p0) / max(1.0, t1 - t0))) if len(form) else []:
        height = mapped(knots, float(((row[:, 1] + row[:, 3]) / 2).mean()))
        if height < -side:
            continue
        band = np.flatnonzero((np.abs(mid - height) < 0.55 * side) & ~confirmed)
        band = band[np.argsort(found[band, 0], kind="stable")]
        pairs = pair_row(row[:, 0], found[band, 0])
        confirmed[[band[j] for _, j in pairs]] = True
        if 2 <= len(pairs) < len(row) and len(pairs) == len(band):
            added += filled_in(row, pairs, found[band, 0], height)
    agree = int(confirmed.sum())
    trusted = bool(len(form)) and agree / len(form) >= least
    added = [b for b in added if trusted and b[2] - b[0] > 3 and b[3] - b[1] > 3]
    return confirmed, added, {"projected": len(form), "agree": agree, "template_only": len(added), "detect_only": int((~confirmed).sum()) if trusted else 0, "trusted": trusted}


def place_pages(start: np.ndarray, size: np.ndarray, corners: np.ndarray, forms: list[np.ndarray | None], knots: list[np.ndarray], side: np.ndarray, least: float = 0.75, known: dict | None = None) -> tuple[np.ndarray, list[tuple], dict[str, np.ndarray]]:
    """place_page for many pages: page p has the detections start[p] to start[p] + size[p]; forms[p] is None without a registration.

    Returns the confirmed detections, the added boxes (page, corners) and the pages' figures. Pages whose form falls into the
    same rows, under knots of the same number, are taken together, row by row. ``known`` keeps filled rows between calls.
    """
    pages, known = len(size), {} if known is None else known
    confirmed, open_fills, groups, cut = np.zeros(len(corners), bool), [], {}, {}
    mid, left = (corners[:, 1] + corners[:, 3]) / 2, corners[:, 0]
    for p in range(pages):
        form, k = forms[p], knots[p]
        if form is None or not len(form):
            continue
        (t0, p0), (t1, p1) = k[0], k[-1]
        at = (form.tobytes(), 0.8 * side[p] / max(1e-6, (p1 - p0) / max(1.0, t1 - t0)))
        if at not in cut:
            rows = reading_rows(form, at[1])
            cut[at] = (tuple(r.tobytes() for r in rows), rows)
        groups.setdefault((at[0], cut[at][0], len(k)), (cut[at][1], []))[1].append(p)
    for rows, members in groups.values():
        own = np.array(members)
        t, y = np.moveaxis(np.array([knots[p] for p in members], float), 2, 0)
        which = np.repeat(np.arange(len(own)), size[own])
        boxes = np.arange(len(which)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + start[own][which]
        tall, every, last = side[own], np.arange(len(own)), t.shape[1] - 2
        for row in rows:
            height = heights(t, y, float(((row[:, 1] + row[:, 3]) / 2).mean()), every, last)
            near = np.flatnonzero((np.abs(mid[boxes] - height[which]) < 0.55 * tall[which]) & ~confirmed[boxes] & ~(height < -tall)[which])
            near = near[np.lexsort((left[boxes[near]], which[near]))]
            count = np.bincount(which[near], minlength=len(own))
            first = np.cumsum(count) - count
            for n in np.unique(count[count > 0]).tolist():
                here = np.flatnonzero(count == n)
                band = boxes[near[first[here, None] + np.arange(n)]]
                if n == len(row):
                    confirmed[band] = True
                    continue
                xs = left[band]
                form_x = np.broadcast_to(row[:, 0], (len(here), len(row)))
                i, j, pairs = aligned(form_x, np.ones_like(form_x), xs, np.ones_like(xs), lookback=3, skip=0.3, slopes=(0.4, 2.5))
                confirmed[np.take_along_axis(band, np.maximum(j, 0), 1)[j >= 0]] = True
                for h in np.flatnonzero((pairs >= 2) & (pairs < len(row)) & (pairs == n)).tolist():
                    open_fills.append((own[here[h]], row, tuple(i[h, :n].tolist()), tuple(xs[h].tolist()), float(height[here[h]])))
    of = np.repeat(np.arange(pages), size)
    agree = np.bincount(of, weights=confirmed, minlength=pages).astype(np.int64)
    projected = np.array([0 if f is None else len(f) for f in forms], np.int64)
    trusted = (projected > 0) & (agree / np.maximum(projected, 1) >= least)
    added = []
    for p, row, seen, xs, height in open_fills:
        if trusted[p]:
            key = (row.tobytes(), seen, xs, height)
            if key not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[key] = [b for b in filled_in(row, [(i, j) for j, i in enumerate(seen)], np.array(xs), height) if b[2] - b[0] > 3 and b[3] - b[1] > 3]
            added += [(int(p), *b) for b in known[key]]
    new = np.bincount(np.array([a[0] for a in added], np.int64), minlength=pages) if added else np.zeros(pages, np.int64)
    return confirmed, added, {"projected": projected, "agree": agree, "template_only": new, "detect_only": np.where(trusted, size - agree, 0), "trusted": trusted}


def heights(t: np.ndarray, p: np.ndarray, y: float, every: np.ndarray, last: int) -> np.ndarray:
    """mapped() for the knots (t, p) of many pages, a row each."""
    at = np.clip((t <= y).sum(1) - 1, 0, last)
    end = (y <= t[:, 0]) | (y >= t[:, -1])
    a = np.where(y < t[:, -1], at, at + 1)
    run = t[every, at + 1] - t[every, at]
    run = np.where(end, np.maximum(1.0, run), run)
    return p[every, a] + (y - t[every, a]) * (p[every, at + 1] - p[every, at]) / run


def place(detected: DataFrame, registrations: DataFrame, forms: DataFrame, least: float = 0.75) -> DataFrame:
    """detected (page_id, box_id, corners), registrations (page_id, form, side, knots), forms (form, boxes) -> SCHEMA.

    Added boxes have a null box_id and the reason MISSING_IN_DETECT; on trusted pages unconfirmed detections get
    EXTRA_BOX. Pages without a registration keep their detections, with null stats. ``forms`` is the registry of blank
    forms, a few rows. A registered page without detections has no rows.
    """
    boxes = detected.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("y1", "x1", "box_id", "x2", "y2")]))).alias("found"))
    known = registrations.join(F.broadcast(forms), "form").select("page_id", "side", "knots", F.col("boxes").alias("form_boxes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled: dict = {}
        for batch in batches:
            start, size, found = lists(batch.column("found"))
            corners = np.stack([numbers(found, c) for c in CORNERS], 1)
            k0, kn, ks = lists(batch.column("knots"))
            f0, fn, fs = lists(batch.column("form_boxes"))
            told = batch.column("knots").is_valid().to_numpy(zero_copy_only=False)
            flat, form = np.stack([numbers(ks, "ty"), numbers(ks, "py")], 1), np.stack([numbers(fs, c) for c in CORNERS], 1)
            one = [(form[a : a + n] if t else None, flat[b : b + k]) for t, a, n, b, k in zip(told.tolist(), f0.tolist(), fn.tolist(), k0.tolist(), kn.tolist(), strict=True)]
            side = pc.cast(batch.column("side"), pa.float64()).to_numpy(zero_copy_only=False)
            confirmed, added, figures = place_pages(start, size, corners, [f for f, _ in one], [k for _, k in one], side, least, filled)
            of = np.concatenate([np.repeat(np.arange(len(size)), size), np.array([a[0] for a in added], np.int64)])
            extra = told[of[: len(confirmed)]] & figures["trusted"][of[: len(confirmed)]] & ~confirmed
            late = np.full(len(added), 2)
            seen = lambda c, at: pa.concat_arrays([found.field(c), pa.array([a[at] for a in added], pa.int32())])
            stats = pa.StructArray.from_arrays([pa.array(v, pa.bool_() if c == "trusted" else pa.int32()) for c, v in figures.items()], list(figures), mask=pa.array(~told))
            ids = pa.concat_arrays([found.field("box_id"), pa.nulls(len(added), pa.int32())])
            columns = [batch.column("page_id").take(pa.array(of)), ids, *[seen(c, 1 + n) for n, c in enumerate(CORNERS)], WITNESSES.take(pa.array(np.concatenate([confirmed.astype(np.int64), late]))), REASONS.take(pa.array(np.concatenate([extra.astype(np.int64), late]))), stats.take(pa.array(of))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "box_id", *CORNERS, "witnesses", "reasons", "stats"])

    return boxes.join(known, "page_id", "left").select("page_id", "found", "side", "knots", "form_boxes").mapInArrow(run, SCHEMA)


def page_stats(placed: DataFrame) -> DataFrame:
    """The witness figures of each page, once."""
    return placed.where("stats IS NOT NULL").groupBy("page_id").agg(F.first("stats").alias("s")).select("page_id", "s.*")
