"""Sequences on a page: peaks of a profile as islands, and the alignment of sequences of lines, many at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.operators.alignment import aligned, lists, numbers


def islands(profile: DataFrame, key: str, at: str, value: str, share: float = 0.2) -> DataFrame:
    """Maximal runs of places whose value is at least a share of the profile's greatest, and at least 1: (key, pos, weight).

    A place opens a run where the place before is none of the run's: lag and a running sum name the runs. pos is a run's
    middle, weight its greatest value. Profiles of any length are spread by key alone; nulls are no places.
    """
    of_key = W.partitionBy(key)
    own = profile.where(F.col(value).isNotNull()).withColumn("_least", F.greatest(F.max(value).over(of_key) * F.lit(share), F.lit(1.0))).where(F.col(value) >= F.col("_least"))
    opens = F.coalesce(F.lag(at).over(of_key.orderBy(at)) + 1 != F.col(at), F.lit(True))
    own = own.withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum("_opens").over(of_key.orderBy(at)))
    return own.groupBy(key, "_run").agg(((F.min(at) + F.max(at)) / 2).cast("double").alias("pos"), F.max(value).cast("double").alias("weight")).drop("_run")


def thinned(runs: DataFrame, key: str, gap: float) -> DataFrame:
    """Of runs whose places lie closer than the gap the heavier, in order: each is held against the last that was kept.

    The runs of one key, which are few beside its places, are folded in one row.
    """
    none = F.array().cast("array<struct<pos: double, weight: double>>")

    def step(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        near = (F.size(kept) > 0) & (x["pos"] - last["pos"] < gap)
        swapped = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(x))
        return F.when(near & (x["weight"] > last["weight"]), swapped).when(near, kept).otherwise(F.concat(kept, F.array(x)))

    own = runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "weight"))).alias("_all"))
    return own.select(key, F.explode(F.aggregate("_all", none, step)).alias("p")).select(key, "p.pos", "p.weight")


def peaks(profile: DataFrame, key: str, at: str, value: str, share: float = 0.2, gap: float = 8) -> DataFrame:
    """The peaks (key, pos, weight) of profiles given as rows."""
    return thinned(islands(profile, key, at, value, share), key, gap)


def registrations(lines: DataFrame) -> DataFrame:
    """lines (page_id, form, template, page: arrays of struct<y, w>) -> page_id, form, pairs, score, knots.

    Rows stay where they lie; those of a batch with equally many lines on both sides are aligned together. Pairs rise on both
    sides, so each is a knot of the map from the form's heights to the page's. Sequences of fewer than two lines have no pairs.
    """
    kept = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in ("page_id", "form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (t0, m, t), (p0, n, p) = (lists(batch.column(c)) for c in ("template", "page"))
            (ty, tw), (py, pw) = ((numbers(v, "y"), numbers(v, "w")) for v in (t, p))
            least = np.minimum(m, n)
            size, width = np.zeros(len(m), np.int64), int(least.max(initial=1))
            up, across = np.zeros((len(m), width)), np.zeros((len(m), width))
            able = np.flatnonzero(least >= 2)
            shapes, shape = np.unique(np.stack([m[able], n[able]]), axis=1, return_inverse=True)
            for k, (a, b) in enumerate(shapes.T.tolist()):
                own = able[shape.ravel() == k]
                ts, ps = t0[own, None] + np.arange(a), p0[own, None] + np.arange(b)
                i, j, size[own] = aligned(ty[ts], tw[ts], py[ps], pw[ps])
                up[own, : min(a, b)], across[own, : min(a, b)] = np.take_along_axis(ty[ts], i, 1), np.take_along_axis(py[ps], j, 1)
            held = np.arange(width) < size[:, None]
            knots = pa.StructArray.from_arrays([pa.array(up[held]), pa.array(across[held])], ["ty", "py"])
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("form"), pa.array(size, pa.int32()), pa.array(least, pa.int32()), pa.ListArray.from_arrays(ends, knots)], ["page_id", "form", "pairs", "least", "knots"])

    own = lines.select("page_id", "form", "template", "page").mapInArrow(run, f"{kept}, pairs int, least int, knots array<struct<ty: double, py: double>>")
    return own.select("page_id", "form", "pairs", F.round(F.col("pairs") / F.greatest(F.lit(3), "least"), 3).alias("score"), "knots")
