"""The step-by-step interface: fit one hop, filter, fit the next on the forwarded maps.

``SubspaceEstimator`` does the same in fewer scans. These functions are for callers that keep the maps
as a table or put their own DataFrame steps between the hops.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..operators import hops as H
from ..operators import kernels as K
from ..operators import packed as PK
from ..operators import trees as T
from ..sources.complete import complete_table
from ..spec import HopSpec
from .estimator import SubspaceEstimator, SubspaceModel, read_nodes

FUNCTIONAL = HopSpec(window=5, stride=1, ddof=0)


def fit_joint(images: DataFrame, energy_multiplier: float = 1.0, spec: HopSpec = FUNCTIONAL):
    """Fit one hop over all channels together: ``(kernels, maps of the images, model)``.

    ``alive`` in ``kernels`` says whether the node has any energy, so that roles need no look at its other kernels.
    """
    model = SubspaceEstimator([replace(spec, channelwise=False)], th2=0.0).fit(images)
    kernels = model.kernels(images.sparkSession).drop("role")
    alive = any(r["local_energy"] * float(energy_multiplier) > 0 for r in model.tree[0]["nodes"][0]["rows"])
    kernels = kernels.withColumn("energy", F.col("local_energy") * F.lit(float(energy_multiplier))).withColumn("alive", F.lit(alive))
    return kernels, model.transform_maps(images, "all"), model


class ChannelwiseHop:
    """One hop fitted channel by channel on ``maps`` rows."""

    def __init__(self, hop: int, spec: HopSpec, channels: list[int], shape, nodes: list[dict]):
        self.hop, self.spec, self.channels, self.shape, self.nodes = hop, spec, channels, shape, nodes

    def kernels(self, spark) -> DataFrame:
        h, w = self.shape
        tree = [{"spec": self.spec, "nodes": self.nodes}]
        table = SubspaceModel(tree, (h, w, len(self.channels)), 0.0, 0.0, "tail").kernels(spark)
        return table.drop("role").withColumn("hop", F.lit(self.hop))

    def transform(self, maps: DataFrame) -> DataFrame:
        """Each map row becomes one row per kernel of its channel; other channels are left out. No shuffle."""
        spec, hop, shape = self.spec, self.hop, self.shape
        most = max((len(n["weights"]) for n in self.nodes), default=1)
        nodes = dict(zip(self.channels, T.slim([{"spec": spec, "nodes": self.nodes}], "all")[0]["nodes"]))

        def score(it):
            for ch, rows, planes, bad in channel_batches(it, shape, most):
                if bad:
                    raise ValueError(f"{bad} maps do not have the fitted shape {shape} or miss values")
                if ch in nodes:
                    out = B.project(B.enter(planes, spec), spec, nodes[ch], nodes[ch]["give"])[0]
                    ids = rows["image_id"].to_numpy(zero_copy_only=False)
                    yield H.map_rows(ids, hop, [nodes[ch]["first"] + q for q in nodes[ch]["give"]], out)

        return maps.select(*H.MAP_NAMES).mapInArrow(score, H.MAPS)


def channel_batches(it, shape, copies: int = 1):
    """Yield ``(channel, rows, planes (1, n, H, W), malformed)`` from batches of ``maps``.

    ``copies``: maps that come out of one; slices are cut so that all of them stay within BATCH_BYTES. A slice is sorted by channel once.
    """
    h, w = shape
    step = max(1, H.BATCH_BYTES // max(1, 8 * h * w * (1 + copies)))
    for whole in it:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            ok = H.usable(batch, {"height": h, "width": w}, "v", h * w)
            bad = int((~ok).sum())
            if bad:
                batch = batch.filter(pa.array(ok))
                yield None, None, None, bad
            channels = batch["channel"].to_numpy(zero_copy_only=False)
            order = np.argsort(channels, kind="stable")
            batch, channels = batch.take(pa.array(order)), channels[order]
            ends = np.flatnonzero(np.diff(channels)) + 1
            for lo, hi in zip(np.r_[0, ends], np.r_[ends, len(channels)]):
                if hi > lo:
                    rows = batch.slice(int(lo), int(hi - lo))
                    v = rows["v"].flatten().to_numpy(zero_copy_only=False)
                    yield int(channels[lo]), rows, np.array(v.reshape(1, -1, h, w), dtype=np.float64), 0


def fit_channelwise(maps: DataFrame, energy: Mapping[int, float] | None = None, spec: HopSpec = FUNCTIONAL,
                    store: str | None = None, key: str = ""):
    """Fit one hop on every channel of ``maps`` at once: ``(kernels, new maps, fitted hop)``.

    ``energy``: energy of each channel, 1 where missing. One scan for the sums of all channels, one more for
    a bias. Should the values of a channel lie far from zero, the sums are taken again around its mean.

    ``maps`` that are not a table yet are computed anew by every scan and by the new maps. With ``store``, a folder that all executors share, they are
    written there once and read from there by all of these; a later call with the same folder and ``key`` finds them complete.
    """
    if store:
        maps = complete_table(maps.select(*H.MAP_NAMES), store, key)
    spec, first = replace(spec, channelwise=True), maps.select(*H.MAP_NAMES).head(1)
    if not first:
        raise ValueError("there are no maps to fit on")
    shape, hop = (first[0].height, first[0].width), first[0].hop + 1
    if None in shape:
        raise ValueError(f"map {first[0].image_id} of channel {first[0].channel} has no shape")
    *out, k = B.map_shape(*shape, 1, spec)
    rows = _channel_kernels(maps, spec, shape, None)
    if any(r.poor_shift for r in rows):
        rows = _channel_kernels(maps, spec, shape, {r.node: np.array(r.mean) for r in rows if r.kidx == 0})
    channels = sorted({r.node for r in rows})
    parents = [{"node": ch, "parent_channel": ch, "parent_energy": float((energy or {}).get(ch, 1.0))} for ch in channels]
    number, first_kernel, nodes_in = {ch: i for i, ch in enumerate(channels)}, 0, []
    for p in parents:
        mine = sorted((r for r in rows if r.node == p["node"]), key=lambda r: r.kidx)
        for r in mine:
            nodes_in.append(Row(**{**r.asDict(), **p, "node": number[r.node], "channel": first_kernel + r.kidx,
                                   "energy": r.local_energy * p["parent_energy"], "role": "emit"}))
        first_kernel += len(mine)
    nodes = read_nodes(nodes_in, tuple(out), "tail")
    if spec.need_bias:
        for r in _channel_maxima(maps, spec, shape, {ch: nodes[i]["mean"] for ch, i in number.items()}).collect():
            nodes[number[r.channel]]["bias"] = float(np.sqrt(r.sq / k))
    fitted = ChannelwiseHop(hop, spec, channels, shape, nodes)
    return fitted.kernels(maps.sparkSession), fitted.transform(maps), fitted


def _channel_kernels(maps: DataFrame, spec: HopSpec, shape, shift) -> list[Row]:
    """One scan: the kernels of every channel, keyed by channel number."""

    def sums(it):
        state, bad = {}, 0
        for ch, _, planes, b in channel_batches(it, shape):
            bad += b
            if ch is not None:
                H.add_patches(state, ch, B.enter(planes, spec), spec, None if shift is None else shift[ch])
                if len(state) * state[ch][2].nbytes > H.STATE_BYTES:
                    yield from H.state_rows(state)  # sums add up, so a full table is handed on at any time
                    state.clear()
        yield from H.state_rows(state, bad)

    stats = PK.summed(maps.select(*H.MAP_NAMES).mapInArrow(sums, PK.SCHEMA))
    rows = K.solve(stats, spec, shift).collect()
    bad = sum(r.n for r in rows if r.node < 0)
    if bad:
        raise ValueError(f"{bad} maps do not have the shape {shape} of the first one, or miss values")
    return rows


def _channel_maxima(maps: DataFrame, spec: HopSpec, shape, means: dict) -> DataFrame:
    def maxima(it):
        best: dict = {}
        for ch, _, planes, _ in channel_batches(it, shape):
            if ch is not None:
                best[ch] = max(best.get(ch, 0.0), H.largest(B.enter(planes, spec), spec, {"mean": means[ch]}))
        columns = [pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["channel", "sq"])

    partial = maps.select(*H.MAP_NAMES).mapInArrow(maxima, "channel int, sq double")
    return partial.groupBy("channel").agg(F.max("sq").alias("sq"))
