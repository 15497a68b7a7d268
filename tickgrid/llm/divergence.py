"""How far the sources of a language are from each other, and from the language, in the words that they use.

A language keeps the terms that enough of its documents hold. Every (language, source) group, and every language, gives
each kept term a smoothed share in whole billionths; two groups are as far apart as their shares' absolute differences sum
to, and a term marks a group by how far its share there exceeds the language's. All arithmetic is in integers.

A pair's distance is a sum over all kept terms, most of which most groups lack, so terms are split by the number of groups
that hold them. Heavy terms are dealt into tiles, and each tile's shares stand in a dense matrix of groups by terms, with a
group's share for an absent term where it lacks one; blocks of its rows are compared in numpy. A light term is absent from
most groups, and the distance of two groups is put together from parts: what it were if neither held any light term; for
each group, what its own postings change against another group that lacks them, which only depends on that group's share
for an absent term and comes from sorted shares and their running sums; and a correction for each pair of groups in a light
term's posting list, whose length is bounded. Partial sums of all parts are added in each task and then by the shuffle.

Words are counted in each task by group and term before anything is shuffled, documents of a term likewise.

Cases: null text, language and source are empty. Groups whose documents hold no kept term, or no text, still have all their
pairs. A language without kept terms has distances of 0 and no terms. Repeated rows all count. Ties are in the order of the
items' bytes. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.llm.base import batches_of, cut, give_back, small, spool
from tickgrid.llm.words import ALPHA, numbered, windows

#: Documents of a language that hold a kept term; ranks of terms that are told; what smoothing adds to a count.
LEAST_DOCS, TERMS, ADDED = 30, 50, 5
BILLION = 1_000_000_000
#: A term is light if at most so many groups, and at most one in so many, hold it.
LIGHT_MOST, LIGHT_SHARE = 64, 4
#: Heavy terms a tile and groups a block, of which a dense matrix is made.
TILE, BLOCK = 128, 256
#: Numbers of partial sums that a task holds before it sends them on.
HELD = 1 << 22
#: Texts, and bytes of them, that go to Python at once, and bytes that are counted together: the more, the fewer counts.
ROWS, SIZE, WINDOW = 8192, 12 << 20, 8 << 20


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total) for 0 <= count <= total, exact in longs: a digit group of three at a time."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, total)
        rest = rest % total
    return out + 1


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with a null term for each group."""
    told = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    own = docs.select(told(lang_col, "lang"), told(source_col, "source"), F.col(text_col).cast("binary").alias("text"))
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[str, str], int] = {}
            of_row = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            lang, source = pa.array([g[0] for g in groups]), pa.array([g[1] for g in groups])
            zero = pa.array(np.zeros(len(groups), np.int64))
            yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(groups), pa.string()), zero, zero], names)
            open_row, held = -1, set()  # a text that may go on in the next window, and the terms that it has held so far
            for words, rows, _ in windows(batch.column("text").to_pylist(), ALPHA, window=WINDOW):
                ids, terms = numbered(words)
                key = (rows * len(terms) + ids)[ids > 0]
                key, n = np.unique(key, return_counts=True)
                row, term = np.divmod(key, len(terms))
                first = np.ones(len(key), bool)
                again = np.flatnonzero(row == open_row)
                first[again] = [terms[t] not in held for t in term[again].tolist()]
                if rows[-1] != open_row:
                    open_row, held = int(rows[-1]), set()
                held.update(terms[t] for t in term[row == open_row].tolist())
                both = of_row[row] * len(terms) + term
                order = np.argsort(both, kind="stable")
                both, at = both[order], np.flatnonzero(np.diff(both[order], prepend=-1))
                if not len(at):
                    continue
                g, t = np.divmod(both[at], len(terms))
                words_of = pa.array(terms, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(g)), source.take(pa.array(g)), words_of.take(pa.array(t)), pa.array(np.add.reduceat(n[order], at)), pa.array(np.add.reduceat(first[order].astype(np.int64), at))], names)
        give_back()

    counted = own.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    with batches_of(docs.sparkSession, ROWS, SIZE):
        return spool(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")


class _Sums:
    """Partial sums by pair of groups of a language, as dense blocks, sent on when they are many."""

    def __init__(self, block: int) -> None:
        self.block = block
        self.blocks: dict[tuple[str, int, int], np.ndarray] = {}

    def of(self, lang: str, bx: int, by: int) -> np.ndarray:
        key = (lang, bx, by)
        if key not in self.blocks:
            self.blocks[key] = np.zeros((self.block, self.block), np.int64)
        return self.blocks[key]

    def full(self) -> bool:
        return len(self.blocks) * self.block**2 > HELD

    def take(self) -> Iterator[pd.DataFrame]:
        for (lang, bx, by), own in self.blocks.items():
            i, j = np.nonzero(own)
            if len(i):
                yield pd.DataFrame({"lang": lang, "a": bx * self.block + i, "b": by * self.block + j, "v": own[i, j]})
        self.blocks.clear()


PAIR = "lang string, a long, b long, v long"


def heavy_pairs(heavy: DataFrame) -> DataFrame:
    """heavy (lang, tile, bx, by, g, term, p, p0) -> (lang, a, b, v) with a < b: sums of a tile's differences.

    Each tile and pair of blocks holds all groups of both blocks; a row with a null term gives a group's share for terms
    that it lacks, and as p the number of terms in the tile, since terms that none of these groups holds have no column.
    """
    keys = ["lang", "tile", "bx", "by"]

    def dense(frame: pd.DataFrame, sums: _Sums) -> None:
        lang, _, bx, by = frame[keys].iloc[0]
        column, terms = pd.factorize(frame["term"])  # -1 for the row of a group's absent share
        g = frame["g"].to_numpy()
        p = np.zeros((2 * BLOCK, len(terms)), np.int64)
        at = np.where(g // BLOCK == bx, g % BLOCK, BLOCK + g % BLOCK)
        own, share_of = column >= 0, frame["p"].to_numpy()
        absent = np.zeros(2 * BLOCK, np.int64)
        absent[at[~own]] = frame["p0"].to_numpy()[~own]
        unseen = int(share_of[~own][0]) - len(terms)
        p[:] = absent[:, None]
        p[at[own], column[own]] = share_of[own]
        there = np.zeros(2 * BLOCK, bool)
        there[at] = True
        total = sums.of(lang, int(bx), int(by))
        right = np.flatnonzero(there[:BLOCK]) if bx == by else np.flatnonzero(there[BLOCK:])
        other, lacking = (p[right], absent[right]) if bx == by else (p[BLOCK + right], absent[BLOCK + right])
        for i in np.flatnonzero(there[:BLOCK]).tolist():
            later = right > i if bx == by else slice(None)
            total[i, right[later]] += np.abs(other[later] - p[i]).sum(axis=1) + unseen * np.abs(lacking[later] - absent[i])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tickgrid.llm.blocks import runs

        sums = _Sums(BLOCK)
        for frame in runs(batches, keys):
            dense(frame, sums)
            if sums.full():
                yield from sums.take()
        yield from sums.take()
        give_back()

    return heavy.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, PAIR)


def light_pairs(postings: DataFrame) -> DataFrame:
    """postings (lang, held array<struct<g, p, p0>>), one row a light term -> corrections (lang, a, b, v) for its pairs of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums = _Sums(BLOCK)
        for batch in batches:
            lists = batch.column("held")
            size, start = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1]
            g, p, p0 = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            langs = batch.column("lang").to_pandas()
            for (lang, k), rows in langs.groupby([langs, size]).groups.items():
                x, y = np.triu_indices(k, 1)
                at = start[rows.to_numpy()][:, None]
                i, j = (at + x).ravel(), (at + y).ravel()
                v = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
                low, high = np.minimum(g[i], g[j]), np.maximum(g[i], g[j])
                block = low // BLOCK * (1 << 32) + high // BLOCK
                for b in np.unique(block).tolist():
                    own = block == b
                    np.add.at(sums.of(lang, b >> 32, b & 0xFFFFFFFF), (low[own] % BLOCK, high[own] % BLOCK), v[own])
                if sums.full():
                    yield from sums.take()
        yield from sums.take()
        give_back()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("v", pa.int64())]), preserve_index=False)

    return postings.mapInArrow(frames, PAIR)


def own_parts(groups: DataFrame) -> DataFrame:
    """groups (lang, g, p0, n_light, of array<struct<p, n>>, others array<struct<g, p0>>) -> (lang, a, b, v) with a < b.

    What a group's own light postings change against each other group, and, from the lesser group of a pair, the distance
    of two groups without light postings. A row for every pair, 0 or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, g, p0, n_light = (batch.column(c)[row].as_py() for c in ("lang", "g", "p0", "n_light"))
                held, others = batch.column("of")[row].values, batch.column("others")[row].values
                og, x = (others.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                base = np.abs(p0 - x)
                v = np.where(og > g, n_light * base, 0)
                if held is not None and len(held):
                    p, n = (held.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                    order = np.argsort(p)
                    p, n = p[order], n[order]
                    upto, weight = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * p)])
                    k = np.searchsorted(p, x, "right")
                    v = v + (x * upto[k] - weight[k]) + (weight[-1] - weight[k] - x * (upto[-1] - upto[k])) - upto[-1] * base
                own = og != g
                a, b = np.minimum(g, og[own]), np.maximum(g, og[own])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(v[own])], ["lang", "a", "b", "v"])
        give_back()

    return groups.mapInArrow(run, PAIR)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: distances to all other sources of the language, and the terms that mark a source."""
    counts = term_counts(docs, text_col, lang_col, source_col)
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("in_docs"), F.count("*").alias("in_groups"))
    kept = cut(by_term.where(F.col("in_docs") >= least_docs).drop("in_docs"))
    rows = spool(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "kept")

    # a row a group: numbered in its language, with its total and its share for a term that it lacks
    by_source = W.partitionBy("lang").orderBy("source")
    groups = counts.where("term IS NULL").select("lang", "source").join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("lang_total"))
    groups = groups.join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"]).withColumns({"g": (F.row_number().over(by_source) - 1).cast("long"), "n_groups": F.count("*").over(W.partitionBy("lang"))})
    own_share = lambda n, total: F.when(F.col("v") > 0, share(n + ADDED, total + F.col("v") * ADDED)).otherwise(0)
    groups = cut(groups.withColumn("p0", own_share(F.lit(0).cast("long"), F.col("total"))))

    told = rows.join(small(groups), ["lang", "source"]).withColumns({"p": own_share(F.col("n"), F.col("total")), "q": own_share(F.col("n_lang"), F.col("lang_total"))})
    light = (F.col("in_groups") <= LIGHT_MOST) & (F.col("in_groups") * LIGHT_SHARE <= F.col("n_groups"))
    told = spool(told.select("lang", "source", "term", "g", "n_groups", "p0", "p", "q", light.alias("light")), "shares")

    first = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    marks = told.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= terms)

    # heavy: terms dealt into tiles, each with all groups of the language
    of_lang = small(cut(groups.select("lang", "n_groups").distinct()))
    split = kept.join(of_lang, "lang").withColumn("light", light)
    sizes = cut(split.groupBy("lang").agg(F.count_if(~F.col("light")).alias("n_heavy"), F.count_if("light").alias("n_light")).withColumn("tiles", F.ceil(F.col("n_heavy") / TILE).cast("int")))
    dealt = lambda df: df.where("NOT light").join(small(sizes), "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int"))
    columns = ["lang", "tile", "g", "n_groups", "term", "p", "p0"]
    n_terms = dealt(split).groupBy("lang", "tile").agg(F.count("*").alias("p"))
    absent = groups.select("lang", F.lit(None).cast("string").alias("term"), "g", "n_groups", "p0").join(n_terms, "lang")
    tiles = dealt(told).select(*columns).unionByName(absent.select(*columns))
    own_block = F.floor(F.col("g") / BLOCK)
    tiles = tiles.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_groups") - 1) / BLOCK)))).withColumns({"bx": F.least(own_block, F.col("o")), "by": F.greatest(own_block, F.col("o"))})
    tiles = tiles.select("lang", "tile", "bx", "by", "g", "term", "p", "p0")

    # light: pairs within a posting list, and each group's postings against groups that lack them
    postings = told.where("light").groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("held")).where(F.size("held") > 1).select("lang", "held")
    values = told.where("light").groupBy("lang", "g", "p").agg(F.count("*").alias("n")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "n")).alias("of"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("g", "p0")).alias("others"))
    base = groups.select("lang", "g", "p0").join(values, ["lang", "g"], "left").join(others, "lang").join(sizes.select("lang", "n_light"), "lang", "left")
    base = base.select("lang", "g", "p0", F.coalesce("n_light", F.lit(0)).cast("long").alias("n_light"), "of", "others")

    pairs = heavy_pairs(tiles).unionByName(light_pairs(postings)).unionByName(own_parts(base)).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    name = lambda to, c: small(groups).select("lang", F.col("g").alias(to), F.col("source").alias(c))
    both = cut(pairs).select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("lang", "value", "e.x", "e.y")
    far = both.join(name("x", "source"), ["lang", "x"]).join(name("y", "item"), ["lang", "y"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return far.withColumn("rank", F.row_number().over(first)).unionByName(marks)
