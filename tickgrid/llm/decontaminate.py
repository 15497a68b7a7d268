"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Sets are the five-word runs of the lower-cased words of a text; a text of fewer words is one run of all its words, so it
matches texts of just these words. Items are partitioned by their set size; each item keeps a bottom-k MinHash sketch
(the k least hash values), with k and the number of sketch values that must be found set by the partition, so that an
item contained to the threshold is missed with probability under 1e-5. Where an item may lack fewer values than k, that
many and one more are kept and one hit is asked for, which misses nothing. A document is far larger than an item, so its
own sketch would say nothing about containment. Instead every partition is searched for itself, under the bound that its
sizes set: the sketches of larger items reach less far up the range of hash values, and a document's value is looked up in
the partitions whose largest sketch value isn't below it. Pairs with enough hits in their partition are candidates, and
their containment |item and document| / |item| is counted from whole sets.

DataFrame functions only. Sketches and items' sets are broadcast while their counted rows and bytes are within
base.BROADCAST_ROWS and BROADCAST_BYTES, and joined by shuffle beyond.

Cases: null or empty texts match nothing, nor do rows with a null id in a search (remove() finds them by their text).
Items are told apart by row, so items that share an id are searched each, and the id's best row counts; rows with the
same doc_id are one document whose best row counts. An empty table gives no rows. Punctuation and case don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import BROADCAST_BYTES, BROADCAST_ROWS, cut, fresh, small

WORDS, CONTAINMENT = 5, 0.8
#: Partitions by set size: (least size, sketch values kept, hits asked for).
PARTITIONS = ((1, 8, 1), (8, 8, 1), (32, 12, 2), (128, 16, 3), (512, 16, 3))


def grams(words: Column, n: int = WORDS) -> Column:
    """64-bit hashes of the runs of n words, repeats included; fewer words are one run."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    runs = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, runs).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def with_grams(df: DataFrame, text_col: str, keep: list[Column], n: int = WORDS) -> DataFrame:
    """keep and ``grams``; the words are a column of their own, so that they are split once."""
    return df.select(*keep, words_of(F.col(text_col)).alias("_words")).withColumn("grams", grams(F.col("_words"), n)).drop("_words")


def sketches(items: DataFrame, text_col: str = "text", id_col: str = "item_id", containment: float = CONTAINMENT) -> DataFrame:
    """item (a row's number), item_id, n (set size), part, need (hits asked for), own (whole set), sketch (its least hash values)."""
    own = with_grams(items, text_col, [F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id")])
    own = own.withColumn("own", F.array_sort(F.array_distinct("grams"))).where("size(own) > 0 AND item_id IS NOT NULL").withColumn("n", F.size("own"))
    keep, need, part = F.lit(0), F.lit(0), F.lit(0)
    for i, (least, k, hits) in enumerate(PARTITIONS):
        part = F.when(F.col("n") >= least, F.lit(i)).otherwise(part)
        keep = F.when(F.col("n") >= least, F.lit(k)).otherwise(keep)
        need = F.when(F.col("n") >= least, F.lit(hits)).otherwise(need)
    lack = F.col("n") - F.ceil(F.col("n") * containment - 1e-9).cast("int")  # values that a contained item may lack
    sure = lack < keep
    return own.select("item", "item_id", "n", part.alias("part"), F.when(sure, F.lit(1)).otherwise(need).alias("need"), "own", F.slice("own", F.lit(1), F.when(sure, lack + 1).otherwise(keep)).alias("sketch"))


def search(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment for every pair at the threshold or above."""
    index = cut(sketches(items, item_text, item_id, containment))
    probes = index.select("item", "part", "need", F.explode("sketch").alias("h"))
    bounds = probes.groupBy("part").agg(F.count("*").alias("k"), F.max("h").alias("top")).collect()  # a row a partition
    n_probes, n_values = sum(r["k"] for r in bounds), index.agg(F.sum("n")).first()[0] or 0
    read = with_grams(docs, text_col, [F.col(id_col).alias("doc_id")])
    # the outer form: Spark infers a filter for the inner one, pushes it down and would split the text for each word
    values = read.select("doc_id", F.explode_outer("grams").alias("h")).where(F.col("h") <= F.lit(max([r["top"] for r in bounds], default=-(1 << 63))))
    asked = F.array_compact(F.array(*[F.when(F.col("h") <= r["top"], r["part"]) for r in bounds])) if bounds else F.array().cast("array<int>")
    hits = values.select("doc_id", "h", F.explode(asked).alias("part")).join(small(probes, n_probes), ["part", "h"]).groupBy("doc_id", "item", "need").agg(F.count_distinct("h").alias("hits"))
    pairs = cut(hits.where("hits >= need AND doc_id IS NOT NULL").select("doc_id", "item"))
    sets = index.select("item", "item_id", "n", "own")
    n_docs = pairs.select("doc_id").distinct().count()
    again = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(small(pairs.select("doc_id").distinct(), n_docs), "doc_id", "left_semi")
    held = with_grams(again, "text", [F.col("doc_id")]).join(pairs, "doc_id").join(small(sets, 0 if n_values * 8 <= BROADCAST_BYTES else BROADCAST_ROWS + 1), "item")
    shared = held.select("doc_id", "item_id", F.col("n").alias("n_item"), F.size(F.array_intersect("own", "grams")).alias("n_shared"))
    shared = shared.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= containment)
    # of rows that share both ids the best counts: the highest containment, then the larger item
    best = shared.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that contain an item. A row with a null id is searched under its text's hash."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.sha2(text_col, 256)))
    found = search(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, "text", "key", **options)
    own = fresh(docs, "_dirty")
    dirty = cut(found.select(F.col("doc_id").alias(own)).distinct())
    return docs.join(small(dirty), key == F.col(own), "left_anti")
