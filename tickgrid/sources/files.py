"""Readers of page images, page labels, cards, regressions and policies. Bad files become rows, not failures."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickgrid.operators.rules import Policy, policy_from

BOX = "struct<bbox: array<int>, is_checked: boolean, ignore: boolean, note: string>"
CARD = "id: string, source: string, bbox: array<int>, stratum: string, note: string, detector_ink: double, label: string, suspected_misclick: boolean"


def images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, errors): pages have page, height, width, channels and bytes (BGR order); errors the undecodable files."""
    own = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    page = F.regexp_replace(F.element_at(F.split("origin", "/"), -1), r"\.[^.]*$", "")
    good = own.where("height > 0").select(page.alias("page"), "height", "width", F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))
    return good, own.where("height <= 0").select(page.alias("page"), "origin", F.lit("UNREADABLE").alias("reason"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """One row per labelled box: page, box_id (file order), corners, state, ignore."""
    raw = spark.read.schema(f"source string, boxes array<{BOX}>").json(path, multiLine=True)
    one = raw.select(F.regexp_replace("source", r"\.[^.]*$", "").alias("page"), F.posexplode("boxes").alias("box_id", "b"))
    corner = [F.col("b.bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return one.select("page", "box_id", *corner, F.coalesce("b.is_checked", F.lit(False)).alias("is_checked"), F.coalesce("b.ignore", F.lit(False)).alias("ignore"))


def cards(spark: SparkSession, path: str) -> DataFrame:
    """Judgment cards from a gold set (object with cards)."""
    raw = spark.read.schema(f"savedAt string, cards array<struct<{CARD}>>").json(path, multiLine=True)
    return raw.select(F.explode("cards").alias("c")).select("c.*").withColumn("suspected_misclick", F.coalesce("suspected_misclick", F.lit(False)))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Booth answers: a map of card id to F, E, N or U, as rows with their meaning."""
    names = F.create_map(*[F.lit(x) for kv in (("F", "filled"), ("E", "empty"), ("N", "not_a_checkbox"), ("U", "unsure")) for x in kv])
    raw = spark.read.schema("version int, labels map<string, string>").json(path, multiLine=True)
    return raw.select(F.explode("labels").alias("id", "code")).withColumn("label", names[F.col("code")])


def regressions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, cx int, cy int, check string, expect boolean, note string").json(path)


def policy(spark: SparkSession, path: str) -> Policy:
    """A policy file, by a closed schema: one small file, read as text by Spark so that any store will do."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return policy_from(json.loads(text), PurePosixPath(path).stem)


def synth_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled boxes under a folder and its subfolders that have parameters (form, factor, level): a manifest has none."""
    raw = spark.read.schema(f"source string, params struct<form: string, factor: string, level: string>, boxes array<{BOX}>").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path, multiLine=True)
    one = raw.where("params IS NOT NULL AND source IS NOT NULL").select(F.regexp_replace("source", r"\.[^.]*$", "").alias("page"), "params.*", F.posexplode("boxes").alias("box_id", "b"))
    return one.select("page", "form", "factor", "level", "box_id", F.col("b.bbox").alias("bbox"), F.coalesce("b.is_checked", F.lit(False)).alias("is_checked"))


def votes(spark: SparkSession, path: str) -> DataFrame:
    """A record of votes (one JSON object by crop key): key and verdict; no file, no rows."""
    schema = "map<string, struct<final: struct<is_checkbox: boolean, filled: boolean, route: string, confidence: double>>>"
    text = spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")
    one = text.select(F.explode(F.from_json("value", schema)).alias("key", "v"))
    return one.select("key", F.col("v.final.is_checkbox").alias("v_is_checkbox"), F.col("v.final.filled").alias("v_filled"), F.col("v.final.route").alias("route"), F.col("v.final.confidence").alias("v_confidence"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report that must be there and hold something."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    out = spark.read.json(path, multiLine=True)
    if not out.columns or out.isEmpty():
        raise ValueError(f"{path} is empty")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds files at a path, in whatever store it is."""
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
