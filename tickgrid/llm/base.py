"""Helpers shared by the training-data operators: reading, lineage cuts, sized broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few longs a row) may be broadcast: about 30 MB.
BROADCAST_ROWS = 1_000_000
#: Bytes up to which a table with arrays may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Labels that a classifier is fitted on, at most: the most frequent, so that a dirty label column can't flood the driver.
LABELS = 256
_SHARED: list[Broadcast] = []
#: What a worker's modules remember between tasks.
KEPT: list[dict] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one in local mode only."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def spool(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later steps restart from the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key.replace("__", "."), value)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """While jobs run inside, at most so many rows, and bytes, go to Python at once: whole texts are large rows."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends at files in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; else df, for a shuffled join.

    df must be cheap to count, as tables that were cut or spooled are.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= bound else df


def sized(df: DataFrame, *keys: str) -> DataFrame:
    """df with ``size``, the number of rows with its key, for keys of two rows or more.

    Counts are combined before their shuffle and joined back, so a hot key is never sent through one task to be counted.
    df must be cheap to read twice, as tables that were cut or spooled are.
    """
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1"), list(keys))


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that release() takes back."""
    _SHARED.append(spark.sparkContext.broadcast(value))
    return _SHARED[-1]


def release() -> None:
    """Remove the executors' copies of what was shared so far; a task that needs one again fetches it anew."""
    while _SHARED:
        _SHARED.pop().unpersist()


def discard(df: DataFrame) -> None:
    """Delete the files that a spooled table is read from, when no reader needs them any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def unit(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the values of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def fold_of(id_col: str, k: int) -> Column:
    """crc32 of the id's text, modulo k; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % k


def sampled(df: DataFrame, label: str, per_label: int, *key: Column) -> DataFrame:
    """About per_label rows of each of the LABELS most frequent non-null labels, chosen by a hash of the key; all rows of a rarer one.

    The label counts are one narrow aggregation, joined back; they are never collected. Equally frequent labels go by their order.
    """
    own, rows = fresh(df, "_label"), fresh(df, "_rows")
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias(own)).agg(F.count("*").alias(rows))
    n = cut(n.orderBy(F.desc(rows), own).limit(LABELS))
    return df.join(small(n), F.col(label) == F.col(own)).where(unit(*key) * F.col(rows) < per_label).drop(own, rows)


def texts(batch: pd.Series) -> list[str]:
    return ["" if t is None or t != t else t for t in batch]


def give_back(keep: bool = False) -> None:
    """At the end of a Python task: return freed memory to the system, since idle workers are kept for later stages.

    What a worker remembers between tasks goes too, unless the task is of the kind that keeps it.
    """
    if not keep:
        for held in KEPT:
            held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def gathered(rows: DataFrame, label: str, vector: str) -> tuple[list, np.ndarray]:
    """Labels and vectors of a bounded sample on the driver; vectors come as bytes of half-precision floats.

    Only one full copy is held: the rows collected are half its size and go on return.
    """
    got = rows.select(label, vector).collect()
    x = np.empty((len(got), len(got[0][1]) // 2 if got else 0), np.float32)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(r[1], np.float16)
    return [r[0] for r in got], x
