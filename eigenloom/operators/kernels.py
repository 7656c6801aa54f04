"""Kernels from statistics: one small eigen-problem per node, then energies, numbers and roles.

All frames here hold at most one row per kernel. Their size follows from the settings (window, number
of channels, thresholds), never from the number of images.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import HopSpec
from . import packed as PK

SOLVED = (
    "node int, kidx int, is_dc boolean, use_dc boolean, k int, n bigint, mean array<double>, "
    "dc_energy double, spread double, poor_shift boolean, weights array<double>, local_energy double, alive boolean"
)
ROUNDING, ZERO_REL, TIE = 1e-24, 1e-14, 1e-9  # squared rounding noise; lost digits in sums; equal magnitudes
POOR_SHIFT = 1e6  # squared distance of shift and mean, in units of the variance, that costs too many digits


def node_kernels(
    n: float, s: np.ndarray, gram: np.ndarray, shift: np.ndarray, spec: HopSpec, floor: float = 0.0
) -> dict:
    """Mean, kernels and energies of one node from the sums of its shifted patches.

    With ``S = G/n - ss'/n**2`` and ``P`` the projector that removes a patch's own mean, the residual
    covariance is ``P S P`` and the DC energy ``1'S1 / K``: one pass over the data feeds everything.
    Variances up to ``floor`` are rounding noise of the hop before and count as zero.
    """
    k = len(s)
    m = s / n
    cov = gram / n - np.outer(m, m)
    spread, moment = max(np.trace(cov), 0.0), np.trace(gram) / n
    zero = floor + ZERO_REL * moment
    dc_energy = max(cov.sum() / k, 0.0)
    side = cov.mean(axis=0)
    ac = (cov - side - side[:, None] + side.mean()) * (n / (n - spec.ddof) if n > spec.ddof else 1.0)
    values, vectors = np.linalg.eigh((ac + ac.T) / 2)
    values, vectors = np.clip(values[::-1], 0.0, None), vectors.T[::-1]
    if spec.sign_align:
        size = np.abs(vectors)
        lead = (size >= (1 - TIE) * size.max(axis=1, keepdims=True)).argmax(axis=1)
        vectors = vectors * np.sign(vectors[np.arange(k), lead])[:, None]
    use_dc = bool(spec.use_dc and dc_energy > zero)
    if use_dc:
        vectors = np.vstack([np.full((1, k), 1 / np.sqrt(k * dc_energy)), vectors[:-1]])
        values = np.concatenate([[dc_energy], values[:-1]])
    total = values.sum()
    energy = values / total if total > zero else np.zeros_like(values)
    keep = len(values) if spec.num_kernels == -1 else min(spec.num_kernels, len(values))
    return {
        "mean": shift + m,
        "dc_energy": dc_energy,
        "use_dc": use_dc,
        "spread": spread,
        "poor_shift": bool(moment > floor + ROUNDING * (shift @ shift) + POOR_SHIFT * spread),
        "weights": np.ascontiguousarray(vectors[:keep]),
        "energy": energy[:keep],
    }


def solve(stats: DataFrame, spec: HopSpec, shift=None, floor=None) -> DataFrame:
    """Kernels of every node from packed ``stats``; a task holds the Gram matrix of one node at a time.

    ``shift``: what was subtracted from the patches of each node, by node; nothing if None. ``floor``: the
    variance below which a node counts as constant, by node; 0 if None. The mean stands in the row of kernel 0 only.
    Node -1 carries the number of malformed images and passes through as a row with ``kidx = -1``.
    """

    def solved(it):
        for node, n, s, gram, _ in PK.nodes(it):
            if node < 0:
                yield _rows([[node], [-1], [False], [False], [0], [int(n)], [[]], [0.0], [0.0], [False], [[]], [0.0], [False]])
                continue
            k, base = len(s), np.zeros(len(s)) if shift is None else shift[node]
            r = node_kernels(n, s, gram, base, spec, 0.0 if floor is None else floor[node])
            step = max(1, PK.SENT_VALUES // max(1, k))
            for at in range(0, len(r["weights"]), step):
                w = r["weights"][at : at + step]
                m, numbers = len(w), range(at, at + len(w))
                means = [r["mean"] if q == 0 else None for q in numbers]
                yield _rows([[node] * m, numbers, [r["use_dc"] and q == 0 for q in numbers], [r["use_dc"]] * m, [k] * m, [int(n)] * m, means,
                             [r["dc_energy"]] * m, [r["spread"]] * m, [r["poor_shift"]] * m, list(w), r["energy"][at : at + step], [bool(r["energy"].any())] * m])

    return PK.by_node(stats).mapInArrow(solved, SOLVED)


_SOLVED = pa.schema([
    ("node", pa.int32()), ("kidx", pa.int32()), ("is_dc", pa.bool_()), ("use_dc", pa.bool_()), ("k", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())),
    ("dc_energy", pa.float64()), ("spread", pa.float64()), ("poor_shift", pa.bool_()), ("weights", pa.list_(pa.float64())), ("local_energy", pa.float64()),
    ("alive", pa.bool_()),
])


def _rows(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, _SOLVED)], schema=_SOLVED)


def small_frame(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A local relation: no job, no Python worker."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def child_energy(kernels: DataFrame, parents: DataFrame) -> DataFrame:
    """``energy = local_energy * energy of the channel the node was cut from``.

    ``parents (node, parent_channel, parent_energy)``: one row per node, so at most 1/th1 rows.
    """
    return kernels.join(F.broadcast(parents), "node", "left").withColumn(
        "energy", F.col("local_energy") * F.coalesce("parent_energy", F.lit(1.0))
    )


def number_channels(kernels: DataFrame) -> DataFrame:
    """Number the kernels of each hop by (node, kidx): the order of the output channels."""
    order = Window.partitionBy("hop").orderBy("node", "kidx")
    return kernels.withColumn("channel", (F.row_number().over(order) - 1).cast("int"))


def number_children(kernels: DataFrame) -> DataFrame:
    """The nodes of the next hop: forwarded channels, numbered in channel order."""
    order = Window.partitionBy("hop").orderBy("channel")
    return (
        kernels.filter("role = 'forward'")
        .select("hop", F.col("channel").alias("parent_channel"), F.col("energy").alias("parent_energy"),
                (F.row_number().over(order) - 1).cast("int").alias("node"))
        .withColumn("hop", F.col("hop") + 1)
    )


def role(energy: Column, th1: float, th2: float, last: Column, alive: Column | None = None) -> Column:
    """``forward`` to the next hop, ``emit`` as a feature, or ``discard``.

    Inner hops forward ``E >= th1`` and emit ``th2 <= E < th1``; the last hop emits ``E >= th2``, so a channel with
    energy 0 too if ``th2`` is 0. ``alive``: false for the channels of a node without any energy, which are always discarded.
    """
    chosen = F.when(~last & (energy >= th1), "forward").when(energy >= th2, "emit").otherwise("discard")
    return chosen if alive is None else F.when(alive, chosen).otherwise("discard")


def assign_roles(kernels: DataFrame, th1: float, th2: float, depth: int) -> DataFrame:
    """Kernels with their roles. Nodes without energy come marked from ``solve`` (``alive``); else a window over each node's kernels finds them."""
    alive = F.col("alive") if "alive" in kernels.columns else F.max("energy").over(Window.partitionBy("hop", "node")) > 0
    return kernels.withColumn("role", role(F.col("energy"), th1, th2, F.col("hop") >= depth - 1, alive))


def filter_report(kernels: DataFrame) -> DataFrame:
    """How many channels each hop forwards, emits and discards."""
    return kernels.groupBy("hop", "role").agg(F.count(F.lit(1)).alias("n"))
