"""Page images to boxes with ink features: the one stage that touches pixels, a map over pages with no shuffle.

Numpy kernels work on one page at a time; all rules, joins and figures downstream are DataFrame operations on its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.operators.placement import STATS, place_page
from tickgrid.operators.rules import classify, policies
from tickgrid.operators.spatial import align, knots_of

META = f"struct<form: string, registration: double, stats: {STATS}, width: int, height: int>"
SCHEMA = "page string, box_id int, x1 int, y1 int, x2 int, y2 int, ink double, n int, largest double, span double, outside double"
#: Pages narrower than this are read at twice their size and reported in their own coordinates.
NARROW = 1400


def grey(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    x = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    return x[:, :, 0].astype(np.float32) if channels == 1 else x[:, :, :3].astype(np.float32) @ np.array([0.114, 0.587, 0.299], np.float32)


def ink_mask(g: np.ndarray, offset: float = 15) -> np.ndarray:
    """Darker by the offset or more than the Gaussian mean of the block around it."""
    b = max(15, int(0.012 * g.shape[1])) | 1
    r = b // 2
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * (0.3 * (r - 1) + 0.8) ** 2))
    mean, k = np.rint(g).astype(np.float32), (k / k.sum()).astype(np.float32)
    for axis in (0, 1):
        n = mean.shape[axis]
        p = np.pad(mean, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        mean = sum(w * (p[i : i + n] if axis == 0 else p[:, i : i + n]) for i, w in enumerate(k))
    return np.rint(g) <= np.rint(mean) - offset


def long_runs(mask: np.ndarray, k: int) -> np.ndarray:
    """Pixels in horizontal runs of k or more."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (r, a), (_, z) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    keep = z - a >= k
    out = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    np.add.at(out, (r[keep], a[keep]), 1)
    np.add.at(out, (r[keep], z[keep]), -1)
    return out.cumsum(1)[:, :-1] > 0


@dataclass
class Parts:
    """Connected components of a mask, in the order of their first pixel: runs of pixels and the part that each is in."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    part: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray
    area: np.ndarray

    def boxes(self) -> list[tuple[int, int, int, int, int]]:
        return list(zip(*(v.tolist() for v in (self.x1, self.y1, self.x2, self.y2, self.area)), strict=True))

    def paint(self, shape: tuple[int, int], keep: np.ndarray) -> np.ndarray:
        """A mask of the parts to keep."""
        own = keep[self.part]
        out = np.zeros((shape[0], shape[1] + 1), np.int32)
        np.add.at(out, (self.row[own], self.start[own]), 1)
        np.add.at(out, (self.row[own], self.end[own]), -1)
        return out.cumsum(1)[:, :-1] > 0


def labelled(mask: np.ndarray, diagonal: bool = False) -> Parts:
    """By runs and union-find."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, a), (_, z) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    up = list(range(len(row)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first, reach = np.searchsorted(row, np.arange(mask.shape[0] + 1)).tolist(), int(diagonal)
    al, zl = a.tolist(), z.tolist()
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if al[i] < zl[j] + reach and al[j] < zl[i] + reach:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
            if zl[i] < zl[j]:
                i += 1
            else:
                j += 1
    names, part = np.unique(np.array([root(i) for i in range(len(row))], int), return_inverse=True)
    low = lambda v: np.minimum.reduceat(v[order], heads) if len(names) else np.zeros(0, int)
    order = np.argsort(part, kind="stable")
    heads = np.searchsorted(part[order], np.arange(len(names)))
    return Parts(row, a, z, part, low(a), low(row), -low(-z), -low(-row - 1), np.bincount(part, z - a, len(names)).astype(int))


def components(mask: np.ndarray, diagonal: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(x1, y1, x2, y2, area) of connected components."""
    return labelled(mask, diagonal).boxes()


def spread(mask: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Dilation by a block of so many rows and columns."""
    for axis, n in ((0, rows), (1, cols)):
        p = np.pad(mask, [(n // 2, n // 2) if a == axis else (0, 0) for a in (0, 1)])
        mask = np.logical_or.reduce([p.take(range(i, i + mask.shape[axis]), axis) for i in range(n)])
    return mask


def line_mask(ink: np.ndarray, side: int, share: float) -> np.ndarray:
    """Lines of a share of the side or more, without the residue of thick strokes, their ends drawn out to meet."""
    k, least = max(3, int(share * side)), int(0.75 * side)
    across, down = long_runs(ink, k), long_runs(ink.T, k).T
    wide, tall = labelled(across, diagonal=True), labelled(down, diagonal=True)
    return spread(wide.paint(ink.shape, wide.x2 - wide.x1 >= least), 3, 7) | spread(tall.paint(ink.shape, tall.y2 - tall.y1 >= least), 7, 3)


def holes(lines: np.ndarray, lo: float, hi: float) -> list[tuple[int, int, int, int]]:
    """Squarish, well-filled background regions that lines enclose."""
    return [(x1, y1, x2, y2) for x1, y1, x2, y2, area in components(~lines) if lo <= x2 - x1 <= hi and lo <= y2 - y1 <= hi and 0.78 <= (x2 - x1) / (y2 - y1) <= 1.4 and area > 0.8 * (x2 - x1) * (y2 - y1)]


def frame(ink: np.ndarray, k: int) -> np.ndarray:
    return long_runs(ink, k) | long_runs(ink.T, k).T


def box_side(ink: np.ndarray) -> int:
    """The commonest larger side of holes of 0.8 to 2.5 % of the page's width: bins of two from the least, the first on ties."""
    w = ink.shape[1]
    sides = np.array([max(x2 - x1, y2 - y1) for x1, y1, x2, y2 in holes(frame(ink, max(3, int(0.005 * w))), int(0.008 * w), int(0.025 * w))])
    if len(sides) < 5:
        return max(8, int(0.012 * w))
    n = np.bincount((sides - sides.min()) // 2)
    return max(8, int(sides.min() + 2 * n.argmax() + 1))


def features(ink: np.ndarray, box: tuple[int, int, int, int]) -> tuple[float, int, float, float, float]:
    """Ink share of the box's inside, its marks, the largest's share and span, and how much of that one lies outside."""
    x1, y1, x2, y2 = box
    w, h = x2 - x1, y2 - y1
    dx, dy = int(0.15 * w), int(0.15 * h)
    top, left = max(0, y1 + dy), max(0, x1 + dx)
    inner = ink[top : max(0, y2 - dy), left : max(0, x2 - dx)]
    share = float(inner.mean()) if inner.size else 0.0
    if share <= 0.01:
        return share, 0, 0.0, 0.0, 0.0
    marks = labelled(inner, diagonal=True)
    big = int(marks.area.argmax())
    run = int(np.flatnonzero(marks.part == big)[0])
    reach = int(1.2 * max(w, h))
    wy, wx = max(0, y1 - reach), max(0, x1 - reach)
    around = labelled(ink[wy : y2 + reach, wx : x2 + reach], diagonal=True)
    y, x = marks.row[run] + top - wy, marks.start[run] + left - wx
    traced = around.part == around.part[(around.row == y) & (around.start <= x) & (around.end > x)][0]
    gx, gy = int(0.25 * w), int(0.25 * h)
    lo, hi = max(0, x1 - gx - wx), max(0, x2 + gx - wx)
    rows = traced & (around.row >= y1 - gy - wy) & (around.row < y2 + gy - wy)
    inside = np.maximum(0, np.minimum(around.end[rows], hi) - np.maximum(around.start[rows], lo)).sum()
    whole = (around.end[traced] - around.start[traced]).sum()
    return share, len(marks.area), float(marks.area[big] / inner.size), float(np.hypot(marks.x2[big] - marks.x1[big], marks.y2[big] - marks.y1[big]) / np.hypot(w, h)), float(1 - inside / whole)


def ring_ink(ink: np.ndarray, box: tuple[int, int, int, int], side: int) -> float:
    """Share of ink in a ring around the box; a hole in a dark block has a dark ring."""
    x1, y1, x2, y2 = box
    m = max(3, int(0.4 * side))
    wide = ink[max(0, y1 - m) : y2 + m, max(0, x1 - m) : x2 + m]
    area = wide.size - (x2 - x1) * (y2 - y1)
    return float(wide.sum() - ink[max(0, y1) : y2, max(0, x1) : x2].sum()) / area if area > 0 else 0.0


def text_like(ink: np.ndarray, box: tuple[int, int, int, int]) -> bool:
    """Several small blobs and no stroke that stands out: letters of a table cell."""
    share, n, largest, _, _ = features(ink, box)
    return 0.03 < share < 0.5 and n >= 4 and largest < 0.08


def doubled(g: np.ndarray) -> np.ndarray:
    """Twice the size by cubic convolution (a = -0.75), one axis after the other."""

    def weight(d: np.ndarray) -> np.ndarray:
        d = np.abs(d)
        return np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, np.where(d < 2, -0.75 * (d**3 - 5 * d**2 + 8 * d - 4), 0))

    out = g.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        at = (np.arange(2 * n) + 0.5) / 2 - 0.5
        low = np.floor(at).astype(int)
        shape = [-1 if a == axis else 1 for a in (0, 1)]
        out = sum(weight(at - low - k).reshape(shape) * out.take(np.clip(low + k, 0, n - 1), axis) for k in (-1, 0, 1, 2))
    return np.clip(np.rint(out), 0, 255).astype(np.float32)


def off(values: list[int], share: float) -> np.ndarray:
    """True where a value differs from the median by more than the share of it."""
    v = np.array(values, float)
    return np.abs(v - np.median(v)) > share * np.median(v)


def sifted(ink: np.ndarray, side: int) -> list[tuple[tuple[int, int, int, int], str | None]]:
    """Candidate boxes in the order found, each with the reason for which it is rejected, or None."""
    grow, found = max(2, round(0.08 * side)), []
    for share in (0.6, 0.8):
        for x1, y1, x2, y2 in holes(line_mask(ink, side, share), int(0.6 * side), int(1.6 * side)):
            box = (x1 - grow, y1 - grow, x2 + grow, y2 + grow)
            if all(abs(box[0] + box[2] - b[0] - b[2]) / 2 + abs(box[1] + box[3] - b[1] - b[3]) / 2 > 0.3 * side for b in found):
                found.append(box)
    reason: dict = dict.fromkeys(found)
    reason.update({b: "RING_INK" for b in found if ring_ink(ink, b, side) >= 0.5})

    def left() -> list:
        return [b for b in found if reason[b] is None]

    if kept := left():
        reason.update({b: "SIZE_CONSENSUS" for b, bad in zip(kept, off([max(b[2] - b[0], b[3] - b[1]) for b in kept], 0.15), strict=True) if bad})
    if len(kept := left()) >= 5:
        reason.update({b: "TEXT_LIKE_SIZE_OUTLIER" for b, bad in zip(kept, off([b[3] - b[1] for b in kept], 0.10), strict=True) if bad and text_like(ink, b)})
    return [(b, reason[b]) for b in found]


def line_profile(ink: np.ndarray) -> np.ndarray:
    """Of each pixel row, the ink in runs of 15 % of the page's width or more."""
    return long_runs(ink, max(3, int(0.15 * ink.shape[1]))).sum(axis=1).astype(float)


def peaks(profile: np.ndarray, share: float = 0.2, gap: int = 8) -> list[tuple[float, float]]:
    """(height, weight) of a page's lines: runs of rows above a share of the most; of two closer than the gap the heavier."""
    bar = np.concatenate([[False], profile >= max(share * profile.max(initial=0.0), 1.0), [False]])
    edge = np.flatnonzero(bar[1:] != bar[:-1])
    out: list[tuple[float, float]] = []
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        line = ((a + z - 1) / 2, float(profile[a:z].max()))
        if not out or line[0] - out[-1][0] >= gap:
            out.append(line)
        elif line[1] > out[-1][1]:
            out[-1] = line
    return out


@dataclass
class Form:
    """A registered blank form: its lines, and its boxes as rows of x1, y1, x2, y2."""

    name: str
    lines: list[tuple[float, float]]
    boxes: np.ndarray


def register(lines: list[tuple[float, float]], forms: list[Form], floor: float = 0.35) -> tuple[Form, float, list[tuple[float, float]]] | None:
    """The form that a page is, its score and knots; the first of equal scores, or None below the floor."""
    best = None
    for form in forms:
        pairs = align(form.lines, lines)
        knots = knots_of([(form.lines[i][0], lines[j][0]) for i, j in pairs])
        score = len(pairs) / max(3, min(len(form.lines), len(lines)))
        if len(pairs) >= 3 and len(knots) >= 3 and (best is None or score > best[1]):
            best = (form, score, knots)
    return None if best is None or round(best[1], 3) < floor else (best[0], round(best[1], 3), best[2])


def boxes_of(g: np.ndarray, forms: list[Form] = ()) -> tuple[list[tuple], dict]:
    """(corners, features, witnesses, reasons, reason of rejection or None) of a page's boxes in reading order, and figures.

    Boxes that a registered form adds are measured like detected ones.
    """
    height, width = g.shape
    times = 2 if width < NARROW else 1
    ink = ink_mask(doubled(g) if times == 2 else g)
    clip = lambda b: (max(0, b[0]), max(0, b[1]), min(times * width, b[2]), min(times * height, b[3]))
    side = box_side(ink)
    sifted_ = [(clip(b), reason) for b, reason in sifted(ink, side)]
    kept = [b for b, reason in sifted_ if reason is None]
    seen, added, stats = np.zeros(len(kept), bool), [], None
    told = register(peaks(line_profile(ink)), list(forms)) if forms else None
    if told:
        seen, added, stats = place_page(np.array(kept, float).reshape(-1, 4), told[0].boxes, told[2], side)
    odd = ["EXTRA_BOX"] if stats and stats["trusted"] else []
    rows = [(b, ["structure", "template"] if ok else ["structure"], [] if ok else odd, None) for b, ok in zip(kept, seen, strict=True)]
    rows += [(clip(b), ["template"], ["MISSING_IN_DETECT"], None) for b in added]
    rows += [(b, ["structure"], [], reason) for b, reason in sifted_ if reason]
    out = [(*(v // times for v in b), *features(ink, b), witnesses, reasons, rejected) for b, witnesses, reasons, rejected in rows]
    figures = {"form": told[0].name if told else None, "registration": told[1] if told else None, "stats": stats, "width": width, "height": height}
    return sorted(out, key=lambda r: (r[1], r[0])), figures


def scan(pages: DataFrame, forms: list[Form] = ()) -> DataFrame:
    """pages (page, height, width, channels, pixels) -> SCHEMA, witnesses, reasons, ``rejected`` (or null) and META; box_id counts the rows.

    ``forms`` is the registry of blank forms, a few rows that every task gets.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*[x.split()[0] for x in SCHEMA.split(", ")], "witnesses", "reasons", "rejected", "meta"]
        for batch in batches:
            rows = []
            for p in batch.itertuples():
                found, meta = boxes_of(grey(p.pixels, p.height, p.width, p.channels), forms)
                rows += [(p.page, i, *b, meta) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page", "height", "width", "channels", "pixels").mapInPandas(run, f"{SCHEMA}, witnesses array<string>, reasons array<string>, rejected string, meta {META}")


def extract(pages: DataFrame, forms: list[Form] = ()) -> DataFrame:
    """The boxes that a scan keeps, with those that a form adds."""
    return scan(pages, forms).where("rejected IS NULL").drop("rejected")


def registry(blanks: DataFrame, boxes: DataFrame) -> list[Form]:
    """Forms from blank pages (as a source gives them) that have boxes (page, x1, y1, x2, y2), by name; the others are left out."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page": batch["page"], "lines": [[{"y": y, "w": w} for y, w in peaks(line_profile(ink_mask(grey(p.pixels, p.height, p.width, p.channels))))] for p in batch.itertuples()]})

    read = blanks.select("page", "height", "width", "channels", "pixels").mapInPandas(lines, "page string, lines array<struct<y: double, w: double>>")
    own = boxes.groupBy("page").agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("boxes"))
    return [Form(r["page"], [(x["y"], x["w"]) for x in r["lines"]], np.array(r["boxes"], float)) for r in read.join(own, "page").orderBy("page").collect()]


def detect(pages: DataFrame, forms: list[Form] = (), policy_rows: DataFrame | None = None) -> DataFrame:
    """Pages to graded boxes: candidates, registration, witness merge, features, rules; a second reader may follow."""
    return classify(extract(pages, forms), policy_rows if policy_rows is not None else policies(pages.sparkSession))


def rejects(scanned: DataFrame) -> DataFrame:
    """What a scan (kept or persisted by the caller) threw away, by reason, in the page's own coordinates."""
    return scanned.where("rejected IS NOT NULL").select("page", F.array("x1", "y1", "x2", "y2").alias("bbox"), F.array("rejected").alias("reasons"))
