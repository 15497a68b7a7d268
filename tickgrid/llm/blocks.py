"""Groups in blocks: a group too large for one task is cut into chunks, and pairs of chunks are compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import give_back


def with_blocks(df: DataFrame, size: Column, most: int, *key: Column) -> DataFrame:
    """Rows with (bx, by, own): each row goes to all blocks that pair its chunk with another.

    A group of ``size`` rows has ceil(size / most) chunks; each pair of its rows meets in exactly one block, (bx, by)
    with bx <= by; own is the row's chunk. Groups within ``most`` have the block (0, 0) alone.
    """
    n = F.ceil(size / F.lit(most)).cast("int")
    out = df.withColumn("_n", n).withColumn("own", F.when(F.col("_n") > 1, F.pmod(F.xxhash64(*key), F.col("_n")).cast("int")).otherwise(0))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.withColumn("bx", F.least("own", "_o")).withColumn("by", F.greatest("own", "_o")).drop("_n", "_o")


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows with equal keys from batches in which such rows follow each other; batch bounds don't matter."""
    tail: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        edges = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if tail and not (tail[-1][keys].iloc[-1].to_numpy() == k[0]).all():
            yield pd.concat(tail) if len(tail) > 1 else tail[0]
            tail = []
        bounds = [0, *edges.tolist(), len(batch)]
        for a, z in zip(bounds[:-2], bounds[1:-1], strict=True):
            part = batch.iloc[a:z]
            yield pd.concat([*tail, part]) if tail else part
            tail = []
        tail.append(batch.iloc[bounds[-2] :])
    if tail:
        yield pd.concat(tail) if len(tail) > 1 else tail[0]


def map_runs(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, rows: int = 4096) -> DataFrame:
    """f over each group of equal keys, rows in order; small groups share Arrow batches, so a group costs little."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for group in runs(batches, keys):
            out = f(group)
            if out is not None and len(out):
                held.append(out)
                n += len(out)
                if n >= rows:
                    yield pd.concat(held, ignore_index=True)
                    held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)
        give_back()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def map_groups(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None], schema: str) -> DataFrame:
    """f over frames of whole groups and the places where groups start; many small groups are one call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: pd.DataFrame | None = None

        def starts(frame: pd.DataFrame) -> np.ndarray:
            k = frame[keys].to_numpy()
            return np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1])

        for batch in batches:
            if not len(batch):
                continue
            frame = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            at = starts(frame)
            tail = frame.iloc[at[-1] :]
            if len(at) > 1 and (out := f(frame.iloc[: at[-1]], at)) is not None:
                yield out
        if tail is not None and (out := f(tail, np.array([0, len(tail)]))) is not None:
            yield out
        give_back()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


class Sets:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def link_rows(rows: list[tuple]) -> pd.DataFrame | None:
    """(a, b or None, n) as a frame; ids stay exact integers beside nulls."""
    if not rows:
        return None
    a, b, n = zip(*rows, strict=True)
    return pd.DataFrame({"a": np.array(a, np.int64), "b": pd.array(b, dtype="Int64"), "n": np.array(n, np.int64)})
