"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

Two texts are linked if the Jaccard similarity of their sets of five-word runs is 0.8 or more. Equal texts form one
class, and classes are what is compared. Each class gets a MinHash signature, cut into trees; in a tree, signatures
sorted by their path form a prefix trie. A pair at the threshold shares a prefix of length d in some tree with
probability 1 - (1 - s^d)^trees; the shortest prefix used is the longest d at which that reaches the target recall.
Inside each node of that length, matched prefixes are shortened from the full path downwards, only as long as members
are not yet connected, and members whose signatures agree well enough are tied. Ties make candidate groups, and inside
a group *every* pair is verified by its exact sets, in blocks: the rows that leave a block are counts and a spanning
forest, never the pairs.

Result, a row per input row: doc_id, class_id (least doc_id reachable by links and equal texts), text_id (least doc_id
with the same text), n_links (other texts linked directly), n_copies (rows with the same text), kept.

Cases: null texts and texts with no word link with nothing: class_id is their own doc_id. A text of fewer than five
words is one run of all its words. Rows with a null doc_id take part, ids last: they get the class of their text, and
null where no id is in it. Where rows of one class share the least id, or have none, one text of them is kept: that with
the least hashes. A repeated row is a copy. Texts are named by 128 bits. Very long texts are hashed piecewise and
compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import batches_of, give_back, sized, small, spool, texts
from tickgrid.llm.blocks import Sets, link_rows, map_runs, with_blocks
from tickgrid.llm.components import components
from tickgrid.llm.textvec import maps, minhash, shingles

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 16, 8
#: Rows of a trie node, or of a candidate group, that one task takes at once; larger ones are cut into blocks.
NODE, BLOCK = 20_000, 256
#: Texts that go to Python at once.
ROWS = 1024


def prefix_length(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold is met with the target probability; 1 at least."""
    fit = [d for d in range(1, depth + 1) if 1 - (1 - similarity**d) ** trees >= recall]
    return max(fit, default=1)


def agreement_floor(similarity: float, n: int) -> float:
    """Share of equal MinHash values that a pair at the threshold misses about once in 30,000 times."""
    return similarity - 4 * (similarity * (1 - similarity) / n) ** 0.5


def text_key(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text with seeds of their own: 128 bits that name it."""
    return F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")


def sketches(docs: DataFrame, text_col: str, id_col: str, words: int) -> DataFrame:
    """id, h1, h2 (of the text), sig: null for texts with no word."""
    a, b = maps(TREES * DEPTH)

    @F.pandas_udf("sig binary, low binary")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sigs = [minhash(g, a, b) if len(g) else None for g in (shingles(t, words) for t in texts(batch))]
            rows = [(None, None) if s is None else (s.astype(">u4").tobytes(), s.astype(np.uint8).tobytes()) for s in sigs]
            yield pd.DataFrame(rows, columns=["sig", "low"], dtype=object)
        give_back()

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), *text_key(text), signature(text).alias("s"))
    return own.select("id", "h1", "h2", "s.sig", "s.low")


def _connect(group: pd.DataFrame, depth: int, shortest: int, floor: float) -> pd.DataFrame | None:
    """Ties of one trie node (or pair of its chunks): rows sorted by path, prefixes shortened from the full path."""
    n = len(group)
    if n < 2:
        return None
    path = np.frombuffer(b"".join(group["path"]), ">u4").reshape(n, depth)
    sig = np.frombuffer(b"".join(group["low"]), np.uint8).reshape(n, -1)
    ids, sets, ties = group["id"].to_numpy(), Sets(n), []
    same = path[1:] == path[:-1]
    shared = np.where(same.all(axis=1), depth, same.argmin(axis=1))  # longest common prefix of neighbours
    for d in range(depth, shortest - 1, -1):
        bounds = [0, *(np.flatnonzero(shared < d) + 1).tolist(), n]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            rest = np.arange(lo, hi)
            while len(rest) > 1:
                roots = np.array([sets.root(i) for i in rest.tolist()])
                if (roots == roots[0]).all():
                    break
                mine, rest = rest[roots == roots[0]], rest[roots != roots[0]]
                front = mine.tolist()
                while front and len(rest):
                    i = front.pop()
                    near = (sig[rest] == sig[i]).mean(axis=1) >= floor
                    if near.any():
                        for j in rest[near].tolist():
                            if sets.join(i, j):
                                ties.append((ids[i], ids[j]))
                        joined = {sets.root(i)}
                        with_ = np.array([sets.root(j) in joined for j in rest.tolist()])
                        front += rest[with_].tolist()
                        rest = rest[~with_]
        if len({sets.root(i) for i in range(n)}) == 1:
            break
    return pd.DataFrame(ties, columns=["a", "b"]) if ties else None


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix: exact Jaccard similarity of at least the threshold."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    both = np.zeros((n, n), np.float64)
    if n == 2:
        both[0, 1] = both[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        owner = np.repeat(np.arange(n), size.astype(int))
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        first = np.concatenate([[True], grams[1:] != grams[:-1]])
        place = np.cumsum(first) - 1
        often = np.bincount(place)[place] > 1
        owner, place = owner[often], place[often]
        if len(place):
            place = np.cumsum(np.concatenate([[0], place[1:] != place[:-1]]))
            for at in range(0, int(place[-1]) + 1, 8192):
                lo, hi = np.searchsorted(place, [at, at + 8192])
                m = np.zeros((n, min(8192, int(place[-1]) + 1 - at)), np.float32)
                m[owner[lo:hi], place[lo:hi] - at] = 1
                both += m @ m.T
    either = size[:, None] + size[None, :] - both
    return (both >= similarity * either - 1e-9) & (either > 0)


def _verify(group: pd.DataFrame, similarity: float) -> pd.DataFrame | None:
    """Links of one block: (id, null, links counted) and (a, b, 0) of a spanning forest."""
    ids, own = group["id"].to_numpy(), group["own"].to_numpy()
    bx, by = int(group["bx"].iloc[0]), int(group["by"].iloc[0])
    link = similar([np.asarray(g, np.int64) for g in group["grams"]], similarity)
    np.fill_diagonal(link, False)
    if bx != by:
        link &= own[:, None] != own[None, :]
    degree, sets, out = link.sum(axis=1), Sets(len(ids)), []
    for i in np.flatnonzero(degree).tolist():
        out.append((ids[i], None, int(degree[i])))
        for j in np.flatnonzero(link[i, :i]).tolist():
            if sets.join(i, j):
                out.append((ids[i], ids[j], 0))
    return link_rows(out)


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, text_id, class_id, n_links, n_copies, kept, bare (no word), h1, h2 (of the text)."""
    shortest, floor = prefix_length(similarity, recall), agreement_floor(similarity, TREES * DEPTH)
    with batches_of(docs.sparkSession, ROWS):
        rows = spool(sketches(docs, text_col, id_col, words), "forest")
    classes = rows.where("sig is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n_copies"), F.min("sig").alias("sig"), F.min("low").alias("low"))
    classes = spool(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    part = lambda t: F.expr(f"substring(sig, {4 * DEPTH * t + 1}, {4 * DEPTH})")
    head = lambda t: F.expr(f"xxhash64({t}, substring(sig, {4 * DEPTH * t + 1}, {4 * shortest}))")
    nodes = classes.select("id", F.posexplode(F.array(*[head(t) for t in range(TREES)])).alias("tree", "node"))
    members = sized(nodes, "node").join(classes.select("id", "sig", "low"), "id")
    path = F.element_at(F.array(*[part(t) for t in range(TREES)]), F.col("tree") + 1)
    members = with_blocks(members.select("id", "node", "size", path.alias("path"), "low"), F.col("size"), NODE, F.col("id"))
    ties = map_runs(members.select("node", "bx", "by", "id", "path", "low"), ["node", "bx", "by"], ["path", "id"], lambda g: _connect(g, DEPTH, shortest, floor), "a long, b long")

    groups = sized(components(ties), "component")
    groups = spool(groups.join(classes.select(F.col("id").alias("node"), "h1", "h2", "least"), "node"), "groups")
    found = verified(docs, groups, text_col, id_col, words, similarity)
    return result(rows, classes, found)


def verified(docs: DataFrame, groups: DataFrame, text_col: str, id_col: str, words: int, similarity: float) -> DataFrame:
    """Verified links inside candidate groups: (a, b, n) as _verify gives them."""

    @F.pandas_udf("array<long>")
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(t, words).view(np.int64) for t in texts(batch)], dtype=object)
        give_back()

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("own"), text.alias("text"), *text_key(text)).alias("d")
    # the id is a key of the join, so that the copies of a hot text are spread by it
    match = (F.col("d.h1") == F.col("g.h1")) & (F.col("d.h2") == F.col("g.h2")) & F.col("own").eqNullSafe(F.col("least"))
    own = own.join(small(groups).alias("g"), match).select(F.col("node").alias("id"), "component", "size", "text")
    one = own.groupBy("id").agg(F.first("component").alias("component"), F.first("size").alias("size"), F.min("text").alias("text"))
    held = one.select("id", "component", "size", grams("text").alias("grams"))
    blocks = with_blocks(held, F.col("size"), BLOCK, F.col("id"))
    return spool(map_runs(blocks.select("component", "bx", "by", "own", "id", "grams"), ["component", "bx", "by"], ["id"], lambda g: _verify(g, similarity), "a long, b long, n long"), "links")


def result(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    held = classes.select("id", "h1", "h2", "least", "n_copies").join(links, "id", "left").join(joined, "id", "left")
    held = held.withColumn("component", F.coalesce("component", "id"))
    # ids may be null or shared by texts of one component: the text kept has the least id, nulls last, then the least hashes
    first = held.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "h1", "h2", F.col("id").alias("first"))).alias("m"))
    held = held.join(first, "component").select("h1", "h2", F.col("least").alias("text_id"), F.col("m.least").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", (F.col("id") == F.col("m.first")).alias("stays"))
    out = rows.select("id", "h1", "h2", F.col("sig").isNull().alias("bare")).join(held, ["h1", "h2"], "left")
    kept = F.col("bare") | (F.col("stays") & F.col("id").eqNullSafe(F.col("text_id")))
    own = lambda c, e: F.when(F.col("bare"), e).otherwise(F.col(c)).alias(c)
    out = out.select(F.col("id").alias("doc_id"), own("text_id", F.col("id")), own("class_id", F.col("id")), own("n_links", F.lit(0)), own("n_copies", F.lit(1)), "bare", "h1", "h2", kept.alias("kept"))
    return out


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each class: that with the least id; of repeated such rows, one."""
    # dealt anew by id and text before rows are counted, so that Spark may split the join's hot texts
    verdict = join(docs, text_col, id_col, **options).select("doc_id", "h1", "h2", "kept", "bare").repartition("doc_id", "h1", "h2")
    rows = verdict.groupBy(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.max("kept").alias("_kept"), F.max("bare").alias("_bare"), F.count("*").alias("_n"))
    marks = spool(rows.where("NOT _kept OR (_n > 1 AND NOT _bare)").select("_id", "_h1", "_h2", F.col("_kept").alias("_twice")), "marks")
    n, twice = marks.agg(F.count("*"), F.count_if("_twice")).first()
    h1, h2 = text_key(F.coalesce(F.col(text_col), F.lit("")))
    match = lambda d: F.col(id_col).cast("long").eqNullSafe(d["_id"]) & (h1 == d["_h1"]) & (h2 == d["_h2"])
    once = docs.join(small(marks, n), match(marks), "left_anti")
    if not twice:
        return once
    again = marks.where("_twice")
    return once.unionByName(docs.join(small(again, twice), match(again), "left_semi").dropDuplicates([id_col, text_col]))
