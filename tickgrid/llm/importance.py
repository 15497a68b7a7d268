"""Importance resampling towards a target text, with bucketed n-grams and a Gumbel draw.

Features are all runs of one to ``orders`` words; a feature's bucket is its bytes' crc32 modulo the number of buckets. A
bucket's gain is the logarithm of its share in the target over its share in the corpus, both smoothed by one. A document's
weight is its features' mean gain; with Gumbel noise from its id added, the highest scores are a draw without replacement.

Occurrences come from suffix arrays of word ids: in each task the words of many texts get numbers, the positions are put
in order by the next ``orders`` numbers, and neighbours' common prefixes part them into runs of equal n-grams. Each run is
hashed once and its bucket is scattered to all its positions. The lists of buckets are written beside their documents, so
that texts are read and hashed once: counts, and scores after them, are read from these lists.

The draw ranks rows without bringing them together: rows are range-partitioned by score, and a row's rank is its place in
its partition plus the rows of the partitions before.

Cases: null and empty texts, and texts without words, have no features and weight 0; a null id is noised as an empty one.
Rows with equal scores are drawn by smaller id (null last), then in the order of the table; repeated rows all count. An
empty corpus gives no rows, an empty target makes all gains those of an unseen share. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.llm.base import batches_of, give_back, spool
from tickgrid.llm.words import ALNUM, numbered, windows

BUCKETS = 10_000
#: Words from which on a document may be drawn, and how many of a hundred are.
LEAST_WORDS, PERCENT = 20, 10
#: Texts that go to Python at once.
ROWS = 512


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next ``depth`` ids: ranks of short runs are joined to ranks of longer ones."""
    rank, span = ids, 1
    while span < depth:
        step = min(span, depth - span)
        after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1  # 0 is beyond the end
        span += step
    return np.argsort(rank, kind="stable")


def run_buckets(words: list[bytes], orders: int, buckets: int) -> np.ndarray:
    """A row for each position, a column for each order: the bucket of the n-gram there, -1 where a text ends before it does."""
    ids, _ = numbered(words)
    out = np.full((len(ids), orders), -1, np.int32)
    if not len(ids):
        return out
    ids = np.concatenate([ids, np.zeros(orders, np.int64)])
    at = suffix_order(ids, orders)
    at = at[at < len(words)]
    whole, shared = np.ones(len(at), bool), np.ones(len(at), bool)
    for n in range(orders):
        here = ids[at + n]
        whole &= here != 0
        shared[1:] &= here[1:] == here[:-1]  # the common prefix with the position before reaches this far
        shared[0] = False
        own = np.flatnonzero(whole)
        if not len(own):
            break
        run = np.cumsum(~shared)[own]
        first = np.flatnonzero(np.diff(run, prepend=-1))
        hashed = np.array([zlib.crc32(b" ".join(words[i : i + n + 1])) % buckets for i in at[own[first]].tolist()], np.int32)
        out[at[own], n] = np.repeat(hashed, np.diff(np.append(first, len(own))))
    return out


def listed(texts: list[bytes | None], orders: int, buckets: int, window: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, features of each text, and the buckets of all features in the texts' order."""
    n_words, n_features, all_buckets = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
    for words, rows, fresh in windows(texts, ALNUM, orders - 1, window):
        found = run_buckets(words, orders, buckets)
        size = np.zeros(len(rows) + orders, np.int64)
        size[: len(rows)] = np.fromiter(map(len, words), np.int64, len(words))
        n_words += np.bincount(rows[fresh & (size[: len(rows)] > 0)], minlength=len(texts))
        for n in range(orders):  # a run that ends among words told before was counted there
            ends = np.concatenate([fresh[n:], np.zeros(n, bool)])[: len(fresh)]
            found[~ends, n] = -1
        held = found >= 0
        n_features += np.bincount(rows, weights=held.sum(axis=1), minlength=len(texts)).astype(np.int64)
        all_buckets.append(found[held])
    return n_words, n_features, np.concatenate(all_buckets) if all_buckets else np.zeros(0, np.int32)


def occurrences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", orders: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, line, n_words, buckets) of every text, written to the shared folder; line numbers the rows."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("line"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n, found = listed(batch.column("text").to_pylist(), orders, buckets)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("line"), pa.array(n_words), lists], ["doc_id", "line", "n_words", "buckets"])
        give_back()

    with batches_of(docs.sparkSession, ROWS):
        return spool(own.mapInArrow(run, "doc_id long, line long, n_words long, buckets array<int>"), "occurrences", compression="zstd")


def counted(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket -> n, over all lists; each task sends one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the corpus, both smoothed; floored.

    Both sides are lists of occurrences. The result has one number a bucket, whatever the input.
    """
    spark = corpus.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(counted(corpus, buckets).withColumnRenamed("n", "s"), "bucket", "left").join(counted(target, buckets).withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    rows = both.collect()
    out = np.zeros(buckets, np.int64)
    at = np.array([r["bucket"] for r in rows])
    s, t = np.array([r["s"] for r in rows]), np.array([r["t"] for r in rows])
    out[at] = np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)
    return out


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, line, n_words, n_features, weight): the floored mean of the gains of a document's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = lists.offsets.to_numpy().astype(np.int64)
            held = lists.values.to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(gain[held])])
            n = np.diff(ends)
            weight = (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("line"), batch.column("n_words"), pa.array(n), pa.array(weight)], ["doc_id", "line", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, line long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: str) -> Column:
    """Thousandths of a Gumbel variable that the seed and the id fix, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``place``, 1, 2, 3... in the order given; no group of rows is brought into one task.

    The order must tell all rows apart; df must be cheap to read twice, as spooled tables are.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = spool(ranged, "placed").withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, seed: str = "2024", orders: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are drawn.
    """
    held = occurrences(docs, text_col, id_col, orders, buckets)
    wanted = occurrences(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), "text", "doc_id", orders, buckets)
    rows = spool(weighed(held, gains(held, wanted, buckets)).withColumn("score", F.col("weight") + noise("doc_id", seed)), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = placed(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("line")).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest).drop("line")
