"""Operators on ``maps`` rows: split, join, pool and choose channels. All but ``wide_features`` are narrow."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions.pixels import once
from . import hops as H
from . import kernels as K


def split_channels(images: DataFrame, dims, hop: int = -1) -> DataFrame:
    """Images as one map per channel."""

    def cut(it):
        for part, planes in H.good_batches(it, dims, 16 * dims[0] * dims[1] * dims[2]):
            ids = part["image_id"].to_numpy(zero_copy_only=False)
            yield H.map_rows(ids, hop, list(range(len(planes))), planes)

    return H.image_columns(images).mapInArrow(cut, H.MAPS)


def concat_channels(parts: Sequence[tuple[DataFrame, int]], hop: int) -> DataFrame:
    """Maps of several nodes as the channels of one hop. ``parts``: frames with their number of channels."""
    starts = np.cumsum([0, *(n for _, n in parts)])
    moved = [
        df.withColumn("channel", (F.col("channel") + int(s)).cast("int")).withColumn("hop", F.lit(hop))
        for (df, _), s in zip(parts, starts)
    ]
    return reduce(DataFrame.unionByName, moved)


def pool_maps(maps: DataFrame, block: int, how: str | Callable = "max", ragged: str = "pad") -> DataFrame:
    """Reduce every map in blocks; maps of one batch may differ in size."""
    return _pooled(maps.select(*H.MAP_NAMES), block, how, ragged, [])


def _pooled(maps: DataFrame, block: int, how: str | Callable, ragged: str, also: list[str]) -> DataFrame:
    def pooled(it):
        for batch in it:
            for rows, m in same_shape(batch):
                out = B.pool(m[None], block, how, ragged)[0]
                n, h, w = out.shape
                sides = [pa.array(np.full(n, v, np.int32)) for v in (h, w)]
                yield pa.RecordBatch.from_arrays(
                    [*(rows[c] for c in H.MAP_NAMES[:3]), *sides, H.lists(out.reshape(n, -1)), *(rows[c] for c in also)],
                    names=[*H.MAP_NAMES, *also],
                )

    return maps.mapInArrow(pooled, ", ".join([H.MAPS, *(f"{c} string" for c in also)]))


def same_shape(batch: pa.RecordBatch):
    """Yield the rows of a batch of ``maps`` by map size, with their values ``(n, H, W)``."""
    sides = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("height", "width")], axis=1)
    for h, w in np.unique(sides, axis=0):
        rows = batch.filter(pa.array((sides == (h, w)).all(axis=1)))
        yield rows, rows["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w)


def select_channels(maps: DataFrame, kernels: DataFrame, role: str) -> DataFrame:
    """Maps whose kernel has the given role.

    Two integers per kernel are broadcast: their number follows from the settings of the fit, not from the images.
    """
    chosen = kernels.filter(F.col("role") == role).select("hop", "channel")
    return maps.join(F.broadcast(chosen), ["hop", "channel"], "left_semi").select(*H.MAP_NAMES)


def pooled_roles(maps: DataFrame, kernels: DataFrame, block: int = 2, how: str | Callable = "max", ragged: str = "pad") -> DataFrame:
    """Pooled maps of the forwarded and emitted channels with their ``role``: one pass over ``maps``.

    ``kernels`` has a ``role``; three small columns per kernel are broadcast, as in ``select_channels``. Write it with
    ``partitionBy("role")`` to get both parts from one pass.
    """
    chosen = kernels.filter("role <> 'discard'").select("hop", "channel", "role")
    return _pooled(maps.join(F.broadcast(chosen), ["hop", "channel"]).select(*H.MAP_NAMES, "role"), block, how, ragged, ["role"])


def filter_channels(maps: DataFrame, kernels: DataFrame, th1: float = 0.001, th2: float = 0.0001, block: int = 2,
                    how: str | Callable = "max", ragged: str = "pad"):
    """Pool, then part into ``(forward maps, forward kernels, emit maps, emit kernels, report)``.

    Each part reads only its own channels; whoever needs both at once takes ``pooled_roles``.
    """
    kernels, out = part_kernels(kernels, th1, th2), []
    for role in ("forward", "emit"):
        out += [pool_maps(select_channels(maps, kernels, role), block, how, ragged), kernels.filter(F.col("role") == role)]
    return (*out, K.filter_report(kernels))


def part_kernels(kernels: DataFrame, th1: float, th2: float) -> DataFrame:
    """Kernels with the role that an inner hop gives them."""
    return K.assign_roles(kernels, th1, th2, 2**31 - 1)


def concat_hops(maps: Sequence[DataFrame]) -> DataFrame:
    """The outputs of several hops in one frame."""
    return reduce(DataFrame.unionByName, maps)


def by_image(maps: DataFrame, *keys: str) -> DataFrame:
    """``(image_id, keys, m)``: the maps of each image as an array of ``(hop, channel, v)``, in that order.

    An image must have each channel once: rows without an id, or several with the same id, hop and channel, are an error. They would
    otherwise grow into one long row. One shuffle, by image; repeated channels are found before anything is collected, so a group never
    holds more than the channels of one image.
    """
    known = F.when(F.col("image_id").isNull(), F.raise_error(F.lit("a map has no image_id"))).otherwise(F.col("image_id"))
    near = maps.select(known.alias("image_id"), *keys, "hop", "channel", "v").repartition("image_id")
    once_each = near.groupBy("image_id", *keys, "hop", "channel").agg(F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v"))
    twice = F.raise_error(F.concat(F.lit("image "), F.col("image_id").cast("string"), F.lit(" has channel "), F.col("channel").cast("string"),
                                   F.lit(" of hop "), F.col("hop").cast("string"), F.lit(" more than once")))
    checked = once_each.withColumn("v", F.when(F.col("n") > 1, twice).otherwise(F.col("v")))
    return checked.groupBy("image_id", *keys).agg(F.sort_array(F.collect_list(F.struct("hop", "channel", "v"))).alias("m"))


def wide_features(maps: DataFrame) -> DataFrame:
    """One row per image, channels end to end by (hop, channel), from a table of maps; see ``by_image`` for what it asks of ids.

    ``SubspaceModel.features`` gives the same from the images without a shuffle, and keeps rows with repeated or null ids apart.
    """
    return by_image(maps).select("image_id", F.flatten(F.transform("m", lambda s: s["v"])).alias("features"))


def stack_channels(maps: DataFrame) -> DataFrame:
    """Images with all channels of ``maps`` in channel order: the inverse of ``split_channels``; see ``by_image``."""
    one = by_image(maps, "height", "width").withColumn("m", F.transform("m", lambda s: s["v"]))
    cells = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
    pixels = once(F.col("m"), lambda m: F.flatten(F.transform(cells, lambda p: F.transform(m, lambda v: F.get(v, p)))))
    return one.select("image_id", "height", "width", F.size("m").alias("channels"), pixels.alias("pixels"))


def as_vector(features: DataFrame) -> DataFrame:
    """``features`` as the vector type that ``pyspark.ml`` estimators take."""
    return features.withColumn("features", array_to_vector("features"))
