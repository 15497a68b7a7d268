"""Monotone local alignment of many pairs of short sequences at once, in numpy: rows of a batch of equal lengths go together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(start, length, values) of a list column; a null is an empty list."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(size) - size, size, column.flatten()


def numbers(values: pa.Array, name: str) -> np.ndarray:
    """A field of structs as doubles, nulls as NaN."""
    return pc.cast(values.field(name), pa.float64()).to_numpy(zero_copy_only=False)


def aligned(ty: np.ndarray, tw: np.ndarray, py: np.ndarray, pw: np.ndarray, lookback: int = 4, skip: float = 0.3, slopes: tuple[float, float] = (0.45, 2.2)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alignments of templates (rows of ty, tw: height, weight) with pages (py, pw): (i, j, n), n pairs of places a row, in order.

    As spatial.align, for all rows at once: a cell's total is the likeness of its two weights and the best of what a cell
    before gives, at most ``lookback`` places away on both sides and with a slope within bounds, less the places skipped. Of
    equal totals the first counts. A missing height fits nowhere, of a missing weight the other one counts.
    """
    (rows, m), n = ty.shape, py.shape[1]
    ty, tw, py, pw = (np.ascontiguousarray(v.T) for v in (ty, tw, py, pw))
    best, back = np.empty((m * n, rows)), np.full((m * n, rows), -1, np.int32)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(m):
            before = [(a, rise, rise > 0) for a in range(max(0, i - lookback), i) for rise in (ty[i] - ty[a],)]
            for j in range(n):
                large = np.fmax(tw[i], pw[j])
                base = np.where(large > 0, np.fmin(tw[i], pw[j]) / large, 0.0)
                top, source = best[i * n + j], back[i * n + j]
                top[:] = base
                for a, rise, up in before:
                    for b in range(max(0, j - lookback), j):
                        run = py[j] - py[b]
                        slope = run / rise
                        total = best[a * n + b] + base - skip * float((i - a - 1) + (j - b - 1))
                        better = up & (run > 0) & (slope >= slopes[0]) & (slope <= slopes[1]) & (total > top)
                        np.copyto(top, total, where=better)
                        np.copyto(source, a * n + b, where=better)
    at, every, length = best.argmax(0), np.arange(rows), min(m, n)
    path = np.full((rows, length), -1, np.int64)
    for step in range(length):
        path[:, step] = at
        at = np.where(at >= 0, back[at, every], -1)
    size = (path >= 0).sum(1)
    place = size[:, None] - 1 - np.arange(length)
    path = np.where(place >= 0, np.take_along_axis(path, np.maximum(place, 0), 1), -1)
    return path // n, np.where(path >= 0, path % n, -1), size
