"""Checks and sampling on image tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import finite

BUCKET_DIGITS = 4  # hexadecimal digits: at most 65,536 buckets, whatever the number of rows
BROADCAST_KEYS = 2_000_000  # ids sent to every task, some tens of megabytes
BROADCAST_BYTES = 64 << 20  # and as text at most so many bytes
BOUNDARY_ROWS = 100_000  # ids that may be sorted in one task to find the edge of a subset


def shape_audit(images: DataFrame) -> DataFrame:
    """Images per shape, and how many of them lack finite pixels: one row per shape, counted on the map side."""
    whole = (F.size("pixels") == F.col("height") * F.col("width") * F.col("channels")) & F.forall(
        "pixels", lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))
    )
    broken = F.count(F.when(~F.coalesce(whole, F.lit(False)), 1))
    return images.groupBy("height", "width", "channels").agg(
        F.count(F.lit(1)).alias("n"), broken.alias("broken")
    )


def require_one_shape(images: DataFrame) -> tuple[int, int, int]:
    """The one shape of all images, or an error that lists what was found."""
    found = shape_audit(images).limit(20).collect()
    if len(found) != 1 or found[0].broken or None in found[0]:
        raise ValueError(f"images must share one shape and have all pixels, found {[tuple(r) for r in found]}")
    return found[0].height, found[0].width, found[0].channels


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both frames, only in the left, only in the right, and rows on each side.

    Each side is counted per key before the exchange, so a key that holds many rows moves once per task.
    """
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return per_key.agg(
        count((F.col("l") > 0) & (F.col("r") > 0)).alias("n_both"),
        count(F.col("r") == 0).alias("n_left_only"),
        count(F.col("l") == 0).alias("n_right_only"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("n_left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_right_rows"),
    )


def unmatched(left: DataFrame, right: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Rows of ``left`` without a partner.

    The distinct keys of ``right`` and their bytes are counted: few are broadcast, so ``left`` stays where it is. Many are
    copied ``salts`` times, so that the rows of one frequent key spread over as many tasks.
    """
    keys = right.select(key).distinct()
    n, held = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0))).first()
    if n <= BROADCAST_KEYS and held <= BROADCAST_BYTES:
        return left.join(F.broadcast(keys), key, "left_anti")
    copies = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = left.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return salted.join(copies.hint("merge"), [key, "_salt"], "left_anti").select(*left.columns)


def row_hash(key: str, seed: int) -> Column:
    """A portable order-free shuffle key: the same on every engine with md5."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Add ``position``, a seeded permutation 0..N-1. ``key`` must be unique.

    A prefix of the hash cuts the rows into even buckets of known start, each numbered on its own: there
    is no global sort and nothing depends on how the input was split, so a repeated task agrees with the first.
    """
    keyed = df.withColumn("_h", row_hash(key, seed)).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    placed = keyed.withColumn("_r", inside).join(F.broadcast(starts), "_b")
    return placed.withColumn("position", F.col("_start") + F.col("_r") - 1).drop("_h", "_b", "_r", "_start")


def subset_exact(df: DataFrame, key: str, n: int | None = None, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Exactly ``n`` (or ``int(N * fraction)``) rows without replacement. ``key`` must be unique.

    The subset is the n smallest hashes. Bucket counts over the key column alone locate the edge; the result
    is then a plain filter on the input, so the rows themselves are neither sorted nor shuffled.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    h = row_hash(key, seed)
    keys, prefix, digits, wanted = df.select(F.col(key).alias("k"), h.alias("h")), "", BUCKET_DIGITS, n
    while True:
        counts = keys.groupBy(F.substring("h", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        if wanted is None:
            wanted = int(sum(r.n for r in counts) * fraction)
        if wanted <= 0:
            return df.limit(0)
        for r in sorted(counts, key=lambda r: r.b):
            if wanted <= r.n:
                prefix, size = r.b, r.n
                break
            wanted -= r.n
        else:
            return df
        keys = keys.filter(F.substring("h", 1, digits) == prefix)
        if size <= BOUNDARY_ROWS:
            break
        if digits >= 32:
            raise ValueError(f"the key {key!r} is not unique: {size} rows share one hash")
        digits += BUCKET_DIGITS
    place = F.row_number().over(Window.orderBy("h", "k"))  # at most BOUNDARY_ROWS keys are left
    edge, *after = keys.withColumn("place", place).filter(F.col("place").between(wanted, wanted + 1)).orderBy("place").collect()
    if after and (after[0].h, after[0].k) == (edge.h, edge.k):
        raise ValueError(f"the key {key!r} is not unique: {edge.k} occurs more than once")
    return df.filter((h < edge.h) | ((h == edge.h) & (F.col(key) <= F.lit(edge.k))))


def summary(images: DataFrame, by: str = "split") -> DataFrame:
    """Rows and range of shapes per split."""
    dims = [f(c).alias(f"{name}_{c}") for c in ("height", "width", "channels") for name, f in (("min", F.min), ("max", F.max))]
    return images.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *dims)


def summary_types(images: DataFrame) -> DataFrame:
    """Column names and types, from the schema alone."""
    rows = [(f.name, f.dataType.simpleString()) for f in images.schema.fields]
    return images.sparkSession.createDataFrame(rows, "name string, type string")
