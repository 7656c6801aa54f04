"""Means, covariance and DC variance from the small ``stats`` table, and row-wise centring.

``stats`` has one packed row per node and feature (see ``packed``). Each result is one pass over the Gram matrix of each node, however many patches went into
the sums, so the data behind ``stats`` is read once for each result.

Sums are taken relative to a shift, because ``G/N - mm'`` loses the digits that a large offset takes. A shift that was measured here travels
in ``stats`` (rows with ``i = -2``) and is added back to the means; one that the caller gave is not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import pixels as P
from ..spec import HopSpec, check_hops
from . import hops as H
from . import packed as PK
from . import vectors as V

LOOK = 1024  # rows whose mean is the shift; any shift gives the same results up to rounding


def row_stats(rows: DataFrame, k: int, shift: np.ndarray | None = None, column: str = "f") -> DataFrame:
    """``stats`` of any frame with an array column of length ``k`` (patches or plain vectors).

    Short rows are summed by generated JVM code, long ones by matrix products on Arrow batches. ``shift=None``: the mean of the first rows.
    """
    given = shift is not None
    if not given:
        seen = [r[0] for r in rows.select(column).filter(F.size(column) == k).head(LOOK)]
        shift = _middle(np.array([v for v in seen if None not in v], dtype=np.float64).reshape(-1, k))
    shift, one = np.asarray(shift, dtype=np.float64), F.lit(1)
    images = rows.select(F.lit(0).cast("bigint").alias("image_id"), one.alias("height"), one.alias("width"),
                         F.lit(k).alias("channels"), F.col(column).alias("pixels"))
    if k <= V.MAX_K:
        stats = V.vector_stats(images, shift)
    else:
        stats = H.image_stats(images, [], HopSpec(window=1, stride=1), shift[None], (1, 1, k))
    return stats if given else carry_shift(stats, shift[None])


def patch_stats(images: DataFrame, dims, spec: HopSpec) -> DataFrame:
    """``stats`` of the patches of a first hop, per channel if the spec says so, relative to the mean patch of the first image."""
    spec, (h, w, c) = check_hops([spec], 1)[0], dims
    nodes, k = (c if spec.channelwise else 1), B.map_shape(h, w, 1 if spec.channelwise else c, spec)[2]
    row = images.select("pixels").filter(F.size("pixels") == h * w * c).head(1)
    shift = np.zeros((nodes, k))
    if row and None not in row[0].pixels:
        planes = np.asarray(row[0].pixels, dtype=np.float64).reshape(1, h, w, c).transpose(3, 0, 1, 2)
        for i in range(nodes):
            chunks = B.patch_chunks(H.node_input(planes, spec, {"source": i}), spec)
            shift[i] = _middle(np.concatenate([x for _, _, x in chunks], axis=1).T)
    return carry_shift(H.image_stats(images, [], spec, shift, dims), shift)


def _middle(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.isfinite(rows).all(axis=1)]
    return rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])


def carry_shift(stats: DataFrame, shift: np.ndarray) -> DataFrame:
    """``stats`` with the shift of its nodes, by node, in rows ``i = -2``; written into the plan, no scan."""
    rows = [(n, -2, row.tolist()) for n, row in enumerate(shift) if row.any()]
    return stats.unionByName(stats.sparkSession.createDataFrame(rows, PK.SCHEMA)) if rows else stats


def counts(stats: DataFrame) -> DataFrame:
    return stats.filter("node >= 0 and i = -1").groupBy("node").agg(F.sum(F.get("row", F.lit(0))).cast("bigint").alias("n"))


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def _by_node(stats: DataFrame, schema: str, rows: Callable) -> DataFrame:
    """One row set per node from ``rows(n, mean relative to the shift, population covariance, shift)``."""
    names = [tuple(c.split()) for c in schema.split(", ")]

    def results(it):
        for node, n, s, gram, shift in PK.nodes(it):
            if n == 0:  # nothing but a shift
                continue
            m = s / n
            out = {"node": node, **rows(n, m, gram / n - np.outer(m, m), shift)}
            size = max(np.size(v) for v in out.values())
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(out[c], size), _TYPES[t]) for c, t in names], names=[c for c, _ in names])

    return PK.by_node(stats.filter("node >= 0")).mapInArrow(results, schema)


def _cells(value: np.ndarray) -> dict:
    i, j = np.indices(value.shape)
    return {"i": i.ravel(), "j": j.ravel(), "value": value.ravel()}


def feature_means(stats: DataFrame) -> DataFrame:
    """``(node, k, value)``; relative to the shift if the caller gave one."""
    return _by_node(stats, "node int, k int, value double", lambda n, m, c, shift: {"k": np.arange(len(m)), "value": m + shift})


def covariance(stats: DataFrame) -> DataFrame:
    """``(node, n, i, j, value)``: population covariance of the features, both triangles."""
    return _by_node(stats, "node int, n bigint, i int, j int, value double", lambda n, m, c, _: {"n": int(n), **_cells(c)})


def residual_covariance(stats: DataFrame, ddof: int = 1) -> DataFrame:
    """``(node, i, j, value)`` after each patch lost its own mean: the covariance centred on both sides."""

    def centred(n, m, c, _):
        side = c.mean(axis=0)
        return _cells((c - side - side[:, None] + side.mean()) * (n / max(n - ddof, 1.0)))

    return _by_node(stats, "node int, i int, j int, value double", centred)


def dc_variance(stats: DataFrame) -> DataFrame:
    """``(node, value)``: K times the population variance of the patch means."""
    return _by_node(stats, "node int, value double", lambda n, m, c, _: {"value": [c.sum() / len(m)]})


# ---- row by row ----


def add_dc(patches: DataFrame, column: str = "f") -> DataFrame:
    return patches.withColumn("dc", P.patch_mean(F.col(column)))


def remove_dc(patches: DataFrame, column: str = "f") -> DataFrame:
    return patches.withColumn(column, P.residual(F.col(column)))


def remove_mean(patches: DataFrame, mean, column: str = "f") -> DataFrame:
    """``mean``: K numbers, written into the plan as literals."""
    return patches.withColumn(column, P.minus(F.col(column), P.literal_array(mean)))


def bias(patches: DataFrame, mean, column: str = "f") -> DataFrame:
    """One row: the largest residual norm over sqrt(K)."""
    z = remove_dc(remove_mean(patches.select(column), mean, column), column)
    return z.agg((F.max(P.norm(F.col(column))) / F.sqrt(F.lit(len(mean)))).alias("value"))
