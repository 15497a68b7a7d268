"""A corpus in five stages: language, near-duplicates, benchmark passages, mixing weights, token files.

Every stage is written as Parquet in the shared folder and read again by the next, so a lost executor costs one stage's
work; run() deletes a stage's files once the next has written its own. All but the last return the columns of documents.
Each stage first takes back what the stages before it broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickgrid.llm import decontaminate, jaccard_forest, language_id, mixing, token_store
from tickgrid.llm.base import discard, release, spool, table


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language: texts without one go, and so do ambiguous ones, unless the language given is the one told.

    The prediction fills a null language, and takes the place of one that it contradicts without ambiguity.
    """
    release()
    model = language_id.fit(language_id.train_split(docs))
    told = language_id.identify(docs, model, prefix="told_")
    agrees = F.coalesce(F.col("told_lang_pred") == F.col("lang"), F.lit(False))
    kept = told.where((F.col("told_lang_pred") != "und") & (agrees | ~F.col("told_ambiguous")))
    return kept.select(*[F.col("told_lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id."""
    release()
    return jaccard_forest.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is contained."""
    release()
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its mixing rate says."""
    release()
    return mixing.resample(docs, table(spark, sf_dir, "labels"), mixing.domain_of_labels(), mixing.TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and checksum, read back from the token files."""
    release()
    return token_store.checksums(token_store.read(token_store.write(docs)))


STAGES = [("language ID", with_language), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", without_benchmark), ("mixing sources to target weights", mixed), ("token-ID output", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
