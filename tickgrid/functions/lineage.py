"""Lineage cuts in the folder that driver and executors share, and what loops need between their rounds."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Whether a join takes rows as they lie only if they are dealt by all of its keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new folder in local mode only."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None)
    if not told and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        told = sc.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="spark-")
    if not told:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(told)
    return told


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later steps restart from its files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spool(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, a small part of a checkpoint's size; how rows are dealt to tasks is lost."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def as_dealt(spark: SparkSession) -> Iterator[None]:
    """While jobs run inside, joins on a page and more take rows that are dealt by page as they lie, without a shuffle."""
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)
