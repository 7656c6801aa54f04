"""Stored maps between the hops of a deep fit: when they pay, and how a fit goes on from them.

Recomputing costs ``D (D + 1) / 2`` hop passes for D hops, each from the images, and keeps nothing. Stored maps cost one pass a hop and one more to write
them, and their bytes, which are several times those of the images. ``worth_storing`` weighs both for the hops that are left.

A stored hop is a folder with its maps as an ``images`` table (one row per image, the forwarded channels as its channels), the model so far, and a marker that is
written last. A fit that is started again with the same folder and settings goes on behind the last complete hop, also after a lost driver.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hops as H
from ..operators import kernels as K
from ..operators import trees as T
from ..sources.complete import mark, marker
from ..sources.models import load_model, save_model

#: What one core does in a second: multiply-adds in matrix products, bytes read from and written to a shared store.
FLOPS, READ, WRITE = 2e9, 2e8, 1e8

_STATE = pa.schema([("state", pa.string())])


def hop_flops(tree: list[dict]) -> float:
    """Multiply-adds per image for the maps that ``tree`` forwards."""
    return float(sum(n["out"][0] * n["out"][1] * n["weights"].shape[1] * len(n["forward"]) for hop in tree for n in hop["nodes"]))


def worth_storing(tree: list[dict], dims, out, left: int, biased: bool, extra_scan: bool) -> bool:
    """Are stored maps behind ``tree`` (from images of ``dims``) cheaper than recomputing them for the ``left`` hops to come?

    ``out``: height, width and channels of the maps; ``biased``: one more pass at the end for biases; ``extra_scan``: storing needs a scan for open biases first.
    """
    if T.model_bytes(tree) > T.MODEL_BYTES:
        return False  # a hop that does not fit into one task is scored by lineages
    above = hop_flops(tree) / FLOPS + 8 * np.prod(dims) / READ
    stored, passes = 8 * np.prod(out), left + biased
    return bool((1 + extra_scan) * above + stored / WRITE + passes * stored / READ < passes * above)


def forward_images(images: DataFrame, tree: list[dict], dims) -> DataFrame:
    """What the last hop of ``tree`` forwards, as images with one channel per forwarded kernel. Map-only."""
    above, size = T.slim(tree), T.tree_bytes(T.slim(tree), dims)

    def onward(it):
        for part, planes in H.good_batches(it, dims, size):
            out = H.advance(planes, above)
            c, n, h, w = out.shape
            sides = [pa.array(np.full(n, v, np.int32)) for v in (h, w, c)]
            pixels = H.lists(np.ascontiguousarray(out.transpose(1, 2, 3, 0)).reshape(n, -1))
            yield pa.RecordBatch.from_arrays([part["image_id"].cast(pa.int64()), *sides, pixels], names=list(H.COLUMNS))

    return H.image_columns(images).mapInArrow(onward, "image_id bigint, height int, width int, channels int, pixels array<double>")


def fit_key(hops, th1: float, th2: float, emit: str, row) -> str:
    """Settings and first image of a fit: what a stored hop must agree with to be used."""
    pixels = hashlib.sha256(np.asarray(row.pixels, dtype=np.float64).tobytes()).hexdigest()
    plain = [[s.to_json() for s in hops], th1, th2, emit, row.image_id, row.height, row.width, row.channels, pixels]
    return hashlib.sha256(json.dumps(plain).encode()).hexdigest()


@dataclass
class Stages:
    """The folder of one fit."""

    spark: SparkSession
    path: str
    key: str

    def write(self, hop: int, maps: DataFrame, model, state: dict) -> DataFrame:
        """Store the maps behind ``hop`` with the model so far; returns the stored maps."""
        at = f"{self.path}/hop{hop}"
        if marker(self.spark, at) is not None:
            mark(self.spark, at, "")
        maps.write.mode("overwrite").parquet(f"{at}/maps")
        save_model(model, self.spark, f"{at}/model", mode="overwrite")
        K.small_frame(self.spark, [{"state": json.dumps(state)}], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{at}/state")
        mark(self.spark, at, self.key)
        return self.maps(hop)

    def maps(self, hop: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/hop{hop}/maps").select(*H.COLUMNS)

    def last(self, depth: int) -> int | None:
        """The last hop that an earlier run with the same key completed."""
        return next((h for h in range(depth - 1, -1, -1) if marker(self.spark, f"{self.path}/hop{h}") == self.key), None)

    def read(self, hop: int, hooks) -> tuple[list[dict], dict]:
        """The tree up to ``hop`` and the state of the fit behind it."""
        at = f"{self.path}/hop{hop}"
        state = json.loads(self.spark.read.parquet(f"{at}/state").select(F.col("state")).head(1)[0][0])
        return load_model(self.spark, f"{at}/model", hooks).tree, state
