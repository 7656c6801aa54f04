"""Small helpers on data frames shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

LAST = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on an Arrow batch of the session holds at most ``rows`` rows (a smaller setting stays): a batch of whole texts, and Spark's buffers
    for it, then hold a few MB. Spark reads the setting when a frame is computed, so a lazy frame needs it until then."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """``small_batches`` for what is computed inside; outside, the session has its own setting again."""
    before = spark.conf.get(BATCH_ROWS)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once and kept as a table of the folder that all executors share."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that a result of those names is about to replace, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def key(col: str | Column) -> Column:
    """An id as a long; null counts as the largest one."""
    return F.coalesce((F.col(f"`{col}`") if isinstance(col, str) else col).cast("long"), F.lit(LAST))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="eigenloom-")
        sc.setCheckpointDir(base)
    return df.checkpoint()
