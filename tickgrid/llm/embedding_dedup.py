"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Vectors are compared only within a label. Equal vectors of a label are one class; each class gets a sign pattern in each
table. The bits of a pattern grow with the logarithm of the largest label's classes, so that unrelated vectors share a
bucket as rarely at any size, and the number of tables follows from the bits: a pair at the threshold is missed with
probability (1 - (1 - angle/pi)^bits)^tables, MISS at most. Classes that share a pattern in a table are verified by their
cosine in double precision; a link that an earlier table shows is left to that one, so each counts once. Buckets are cut
into blocks: what leaves a block is a count of links for each vector and the stars of its groups, never its pairs.

Result: vec_id, n_links (other rows linked directly), component_id, kept.

Cases: vectors that are null, empty, zero or with a null or non-finite component, and rows with a null label, link with
nothing: they are their own component. Vectors of another length than their fellow's never link with it. A row with a
null vec_id links and counts, and its component is named by ids that aren't null. Labels are compared as text. Repeated rows are copies: both count
as others; rows of one id share a row of the result for each vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import sized, spool
from tickgrid.llm.blocks import map_groups, with_blocks
from tickgrid.llm.components import components

COSINE, MISS, BLOCK = 0.98, 1e-5, 1024
#: Bits beyond the logarithm of a label's classes, and bounds on bits; pairs whose cosines are taken at once.
SPARE_BITS, LEAST_BITS, MOST_BITS, PAIRS = 5, 12, 48, 1 << 16


def layout(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits, tables) for so many classes in the largest label."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(n, 1)))) + SPARE_BITS))
    meet = (1 - np.arccos(min(1.0, cosine)) / np.pi) ** bits
    return bits, 1 if meet >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-meet)))


def planes(d: int, n: int, seed: int = 5) -> np.ndarray:
    """The same n hyperplanes for all vectors of a length."""
    return np.random.default_rng(seed + d).standard_normal((d, n))


def code_type(bits: int) -> np.dtype:
    """The integers that hold a pattern of so many bits."""
    return np.dtype("<i4" if bits < 32 else "<i8")


def sketch(bits: int, tables: int) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    """vector -> codes (its pattern in each table), the same as bytes, and its direction (length 1) as bytes of doubles."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[tuple] = [(None, None, None)] * len(batch)
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(batch):
                if v is not None and len(v):
                    by_length.setdefault(len(v), []).append(i)
            for d, every in by_length.items():
                if d not in held:
                    held[d] = planes(d, bits * tables)
                for at in (every[i : i + 1024] for i in range(0, len(every), 1024)):
                    x = np.array([np.asarray(batch.iloc[i], np.float64) for i in at])
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    signs = (x @ held[d] > 0).reshape(len(x), tables, bits)
                    for i, p, u in zip(at, signs @ (1 << np.arange(bits)), x, strict=True):
                        out[i] = p.tolist(), p.astype(code_type(bits)).tobytes(), u.tobytes()
            yield pd.DataFrame(out, columns=["codes", "pattern", "unit"], dtype=object)

    return run


def pairs_within(bounds: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in one group, for groups from bounds[i] to bounds[i + 1], some at a time."""
    size = np.diff(bounds)
    for n in np.unique(size[size > 1]).tolist():
        first = bounds[:-1][size == n]
        i, j = np.triu_indices(n, 1)
        for at in range(0, len(i), most):
            a, b = i[at : at + most], j[at : at + most]
            step = max(1, most // len(a))
            for g in range(0, len(first), step):
                yield (first[g : g + step, None] + a).ravel(), (first[g : g + step, None] + b).ravel()


def linked(rows: pd.DataFrame, bounds: np.ndarray, cosine: float, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that are links of their block and that no earlier table shows.

    What an earlier table shows is told by the patterns alone, so only the other pairs' cosines are taken.
    """
    size = rows["unit"].map(len).to_numpy() // 8
    x = np.zeros((len(rows), size.max()))
    for d in np.unique(size).tolist():
        of = size == d
        x[of, :d] = np.frombuffer(b"".join(rows["unit"][of]), np.float64).reshape(-1, d)
    tab, own = rows["tab"].to_numpy(), rows["own"].to_numpy()
    across = (rows["bx"] != rows["by"]).to_numpy()
    pattern = np.frombuffer(b"".join(rows["pattern"]), code_type(bits)).reshape(len(rows), -1)
    earlier = np.arange(pattern.shape[1])
    found = [(np.zeros(0, np.int64),) * 2]
    for a, b in pairs_within(bounds):
        own_pair = (size[a] == size[b]) & (~across[a] | (own[a] != own[b]))
        a, b = a[own_pair], b[own_pair]
        met = ((pattern[a] == pattern[b]) & (earlier < tab[a][:, None])).any(axis=1)
        a, b = a[~met], b[~met]
        good = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        found.append((a[good], b[good]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _verify(rows: pd.DataFrame, bounds: np.ndarray, cosine: float, bits: int) -> pd.DataFrame | None:
    """Links of whole blocks: (id, null, links) and (a, b, 0) that tie each group of linked vectors to one of them."""
    a, b = linked(rows, bounds, cosine, bits)
    if not len(a):
        return None
    ids, weight = rows["id"].to_numpy(), rows["copies"].to_numpy()
    degree = np.bincount(a, weight[b], len(rows)) + np.bincount(b, weight[a], len(rows))
    root = np.arange(len(rows))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    some, tied = np.flatnonzero(degree), np.flatnonzero(root != np.arange(len(rows)))
    return pd.DataFrame({"a": np.concatenate([ids[some], ids[tied]]), "b": pd.array([*[None] * len(some), *ids[root[tied]].tolist()], dtype="Int64"), "n": np.concatenate([degree[some].astype(np.int64), np.zeros(len(tied), np.int64)])})


def dedup(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce(v.isNotNull() & F.col(label_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    name = F.col(label_col).cast("string")
    key = lambda seed: F.when(good, F.xxhash64(F.lit(seed), name, v))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), name.alias("label"), v.alias("vector"), key(1).alias("k1"), key(2).alias("k2"))
    # a class has one label and, by 128 bits, one vector
    classes = rows.where("k1 is not null").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = spool(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    bits, tables = layout(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0, cosine)
    sketched = F.pandas_udf(sketch(bits, tables), "codes array<long>, pattern binary, unit binary")
    classes = spool(classes.withColumn("s", sketched("vector")).select("id", "label", "k1", "k2", "least", "copies", "s.*"), "patterns")

    held = sized(classes.select("id", F.xxhash64("label").alias("l"), F.posexplode("codes").alias("tab", "code")), "l", "tab", "code")
    held = with_blocks(held.join(classes.select("id", "copies", "pattern", "unit"), "id"), F.col("size"), BLOCK, F.col("id"))
    held = held.select("l", "code", "bx", "by", "tab", "id", "own", "copies", "pattern", "unit")
    found = spool(map_groups(held, ["l", "tab", "code", "bx", "by"], lambda rows, bounds: _verify(rows, bounds, cosine, bits), "a long, b long, n long"), "links")

    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    one = classes.select("id", "k1", "k2", "label", "least", "copies").join(links, "id", "left").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = one.groupBy("component").agg(F.min("least").alias("component_id"))
    one = one.join(names, "component").select("k1", "k2", "label", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", "k1", "k2").join(one, ["k1", "k2", "label"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
