"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import key


def labelled(df: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text", use: Column | None = None) -> DataFrame:
    """(k, t, y): id, text and label (0 or 1) of at most ``rows`` labelled documents, those with the smallest hashes of their ids.

    Null ids and labels are left out; a document with several labels counts as 1 if one of them is. ``use`` is a condition on
    the label table's ``k``. At most ``rows`` ids are broadcast.
    """
    some = labels.select(key(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter(f"k < {2**63 - 1} AND y IS NOT NULL")
    some = some.filter(use) if use is not None else some
    some = some.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    docs = df.select(key(id_col).alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return docs.join(F.broadcast(some), "k").select("k", "t", "y")
