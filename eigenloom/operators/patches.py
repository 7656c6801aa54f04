"""Patches as a table, and maps back from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import pixels as P
from ..spec import HopSpec
from . import hops as H
from .project import patch_rows


def patch_table(images: DataFrame, dims, spec: HopSpec) -> DataFrame:
    """``(image_id, r, c, f)``: one row per patch. Chunks are bounded, whatever the image size."""
    size = 8 * dims[0] * dims[1] * dims[2]

    def cut(it):
        for part, planes in H.good_batches(it, dims, size):
            ids = part["image_id"].to_numpy(zero_copy_only=False)
            for im, rows, x in B.patch_chunks(B.enter(planes, spec), spec):
                n, hr = im.stop - im.start, rows.stop - rows.start
                yield patch_rows(ids[im], rows.start, hr, x.shape[1] // (n * hr), x.T, "f")

    return H.image_columns(images).mapInArrow(cut, "image_id bigint, r int, c int, f array<double>")


def patch_table_sql(images: DataFrame, dims, window: int, stride: int = 1, order: str = "ijc") -> DataFrame:
    """The same table from column expressions only."""
    wp = (dims[1] - window) // stride + 1
    cut = images.select("image_id", F.posexplode(P.patches(F.col("pixels"), *dims, window, stride, order)).alias("p", "f"))
    return cut.select("image_id", F.floor(F.col("p") / wp).cast("int").alias("r"), (F.col("p") % wp).cast("int").alias("c"), "f")


def explode_values(patches: DataFrame, *keys: str, column: str = "f") -> DataFrame:
    """Long form: ``keys..., k, value``."""
    return patches.select(*keys, F.posexplode(column).alias("k", "value"))


def maps_from_values(values: DataFrame, hop: int | None, height: int, width: int) -> DataFrame:
    """``maps`` rows from ``(image_id, channel, r, c, value)``; with ``hop=None`` the column ``hop`` of ``values`` is part of the key.

    Every cell of a map must be there exactly once, or the map's row is an error.
    One group is one channel of one image, so its size is the map's and does not grow with the table.
    """
    number = F.col("hop") if hop is None else F.lit(hop)
    cells = F.sort_array(F.collect_list(F.struct("r", "c", "value")))
    keyed = values.select("image_id", number.cast("int").alias("hop"), "channel", "r", "c", "value")
    places = F.transform("cells", lambda s: (s["r"] * width + s["c"]).cast("int"))
    inside = F.forall("cells", lambda s: (s["c"] >= 0) & (s["c"] < width))
    whole = F.coalesce((places == F.sequence(F.lit(0), F.lit(height * width - 1))) & inside, F.lit(False))
    wrong = F.raise_error(F.format_string(f"image %s, channel %s: not every cell of a {height} x {width} map occurs exactly once", "image_id", "channel"))
    v = F.when(whole, F.transform("cells", lambda s: s["value"])).otherwise(wrong)
    return keyed.groupBy("image_id", "hop", "channel").agg(cells.alias("cells")).select(
        "image_id", "hop", "channel", F.lit(height).alias("height"), F.lit(width).alias("width"), v.alias("v")
    )
