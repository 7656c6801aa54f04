"""Tables that are either whole or not there: rows first, a marker with the caller's key last."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_MARK = pa.schema([("key", pa.string())])


def marker(spark: SparkSession, path: str) -> str | None:
    """The key under which the table at ``path`` was completed; None if it never was."""
    try:
        found = spark.read.schema("key string").parquet(f"{path}/complete").head(1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found[0].key if found else None


def mark(spark: SparkSession, path: str, key: str) -> None:
    frame = spark.createDataFrame(pa.Table.from_pylist([{"key": key}], schema=_MARK))
    frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/complete")


def complete_table(df: DataFrame, path: str, key: str) -> DataFrame:
    """``df`` as a stored table: computed and written once, read from then on.

    A table that was completed under the same key is taken as it is, by this session or a later one. What an interrupted session left, or
    another key's table, is written anew; its marker is withdrawn first.
    """
    spark = df.sparkSession
    found = marker(spark, path)
    if found is None or found != key:
        if found is not None:
            mark(spark, path, "")
        df.write.mode("overwrite").parquet(f"{path}/rows")
        mark(spark, path, key)
    return spark.read.schema(df.schema).parquet(f"{path}/rows")
