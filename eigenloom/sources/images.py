"""Image and vector tables: reading, writing and spreading them."""

from __future__ import annotations

import contextlib
import os
import shutil
import struct
import uuid
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "image_id bigint, label int, height int, width int, channels int, pixels array<double>"


def as_images(df: DataFrame, image_id: str, pixels: Column, shape: Sequence[int], label: str | None = None) -> DataFrame:
    """Give a frame the ``images`` layout; a projection, so unused columns are never read.

    Pixels keep their stored type, so float or byte images cross into Python at their own width. All
    computation is in double.
    """
    h, w, c = shape
    return df.select(
        F.col(image_id).cast("bigint").alias("image_id"),
        (F.col(label) if label else F.lit(None)).cast("int").alias("label"),
        F.lit(h).alias("height"),
        F.lit(w).alias("width"),
        F.lit(c).alias("channels"),
        pixels.alias("pixels"),
    )


def read_images(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Images written by ``write_images``; a split reads only its own folder."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split).drop("split")


def write_images(images: DataFrame, path: str, mode: str = "error") -> None:
    """Write images as Parquet, one folder per ``split`` if there is such a column."""
    writer = images.write.mode(mode)
    (writer.partitionBy("split") if "split" in images.columns else writer).parquet(path)


def images_from_rows(spark: SparkSession, rows) -> DataFrame:
    """A few images held by the caller, as tuples in the ``images`` order. For small input only."""
    return spark.createDataFrame(rows, IMAGES)


def distribute(images: DataFrame, parts: int) -> DataFrame:
    """Spread images evenly by id, e.g. when a table came in a few large files."""
    return images.repartition(parts, "image_id")


def vectors_from_columns(df: DataFrame, row_id: str | Column, columns: Sequence[str]) -> DataFrame:
    """Numeric columns as vectors, that is as images of one pixel and one channel per column."""
    return df.select(
        (F.col(row_id) if isinstance(row_id, str) else row_id).cast("bigint").alias("image_id"),
        F.lit(1).alias("height"),
        F.lit(1).alias("width"),
        F.lit(len(columns)).alias("channels"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("pixels"),
    )


def vectors_from_array(df: DataFrame, row_id: str, column: str, length: int) -> DataFrame:
    """An array column of fixed length as vectors."""
    return as_images(df, row_id, F.col(column), (1, 1, length)).drop("label")


@dataclass(frozen=True)
class SavedArray:
    """Where the values of a row-major array lie in a file, as plain bytes."""

    path: str
    shape: tuple[int, ...]
    dtype: np.dtype
    start: int

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:])) * self.dtype.itemsize


def _header(f, name: str) -> tuple[tuple[int, ...], np.dtype]:
    major, _ = np.lib.format.read_magic(f)
    header = np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = header(f)
    if fortran or dtype.hasobject:
        raise ValueError(f"{name} must be a plain row-major array")
    return shape, dtype


def stored_array(path: str, name: str) -> SavedArray | None:
    """An array of an npz archive whose member is stored as it is; None if the member is compressed."""
    with zipfile.ZipFile(path) as z:
        info = z.getinfo(f"{name}.npy")
        if info.compress_type != zipfile.ZIP_STORED:
            return None
        with z.open(info) as f:
            shape, dtype = _header(f, name)
            header = f.tell()
    with open(path, "rb") as f:
        f.seek(info.header_offset + 26)  # the lengths of name and extra field in the member's own header
        lengths = struct.unpack("<HH", f.read(4))
    return SavedArray(path, shape, dtype, info.header_offset + 30 + sum(lengths) + header)


def unpack_member(spark: SparkSession, path: str, name: str, folder: str) -> SavedArray:
    """A compressed member as a file of its own in ``folder``: one task reads the stream once, front to back.

    A compressed stream has no places to start from, so tasks that each read their range would decompress it over and over.
    """
    target = os.path.join(folder, f"{name}.npy")

    def unpack(it):
        for batch in it:
            os.makedirs(folder, exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}"
            with zipfile.ZipFile(path) as z, z.open(f"{name}.npy") as f, open(part, "wb") as out:
                shutil.copyfileobj(f, out, STEP_BYTES)
            os.replace(part, target)  # whole or not there, whichever attempt comes last
            yield batch

    spark.range(0, 1, 1, 1).mapInArrow(unpack, "id long").collect()
    with open(target, "rb") as f:
        shape, dtype = _header(f, name)
        return SavedArray(target, shape, dtype, f.tell())


def _rows(array: SavedArray, stream, first: int, count: int) -> np.ndarray:
    """``count`` rows from ``first`` on; a stream that stands there already is not moved."""
    at = array.start + first * array.row_bytes
    if stream.tell() != at:
        stream.seek(at)
    return np.frombuffer(stream.read(count * array.row_bytes), dtype=array.dtype).reshape(count, -1)


def archive_batches(it, x: SavedArray, y: SavedArray | None):
    """Arrow batches of images for batches of consecutive row numbers; each array is opened once."""
    dims, per = x.shape[1:], int(np.prod(x.shape[1:]))
    step = max(1, STEP_BYTES // max(1, per * 8))
    with contextlib.ExitStack() as open_files:
        pixels, labels = (open_files.enter_context(open(a.path, "rb")) if a else None for a in (x, y))
        for batch in it:
            ids = batch["id"].to_numpy()
            for a in range(0, len(ids), step):
                part = ids[a : a + step]  # spark.range gives consecutive ids within a partition
                count, first = len(part), int(part[0])
                v = _rows(x, pixels, first, count).astype(np.float64)
                label = pa.nulls(count, pa.int32())
                if y:
                    label = pa.array(_rows(y, labels, first, count).ravel().astype(np.int32))
                sides = [pa.array(np.full(count, d, np.int32)) for d in dims]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * per), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(part), label, *sides, lists], names=NAMES)


def read_npz(spark: SparkSession, path: str, x: str, y: str | None = None, parts: int | None = None, unpack: str | None = None) -> DataFrame:
    """Saved arrays ``x (N, H, W, C)`` and labels ``y (N)`` of an npz archive as images; the row number becomes the id.

    The archive must lie in a folder all executors see. The driver reads headers only. Members that are stored as they are, which is how arrays are
    saved by default, are read by offset: a task opens the file once and reads its own range front to back, in steps of ``STEP_BYTES``, so the
    whole costs each byte once. Compressed members have no offsets: they are refused, or with ``unpack``, a shared folder, unpacked there once.
    """
    arrays = []
    for name in (x, y):
        found = stored_array(path, name) if name else None
        if name and not found:
            if not unpack:
                raise ValueError(f"{name} is compressed: save it uncompressed, or give unpack, a folder for one unpacked copy")
            found = unpack_member(spark, path, name, unpack)
        arrays.append(found)
    images, labels = arrays
    if len(images.shape) != 4:
        raise ValueError(f"{x} must have four dimensions, found {images.shape}")
    n = images.shape[0]
    if labels and labels.shape != (n,):
        raise ValueError(f"{y} must have one label for each of the {n} images, found {labels.shape}")
    ranges = spark.range(0, n, 1, parts or spark.sparkContext.defaultParallelism)
    return ranges.mapInArrow(lambda it: archive_batches(it, images, labels), IMAGES)


STEP_BYTES = 8 << 20
NAMES = ["image_id", "label", "height", "width", "channels", "pixels"]
