"""Projection of patch rows, its inverse, and the error between two patch tables.

Patch rows are many and wide, so none of these operators shuffles or multiplies them one by one: kernels travel as one matrix per node, a batch of patches is one matrix
product, and two patch tables meet as one row per image and band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import pixels as P
from ..spec import HopSpec
from . import hops as H
from . import trees as T

KEYS = ("image_id", "r", "c")
BROADCAST_VALUES = 4_000_000  # 32 MB of kernel weights
OUTPUT_VALUES = 1 << 20  # coefficients in one Arrow batch
BAND = 64  # patch rows of an image that are compared at a time


def kernel_matrices(kernels: DataFrame) -> DataFrame:
    """``(node, kidx array<int>, weights array<double>)``: one row per node, its kernels end to end. A group is the kernels of one node."""
    ordered = F.sort_array(F.collect_list(F.struct("kidx", "weights")))
    return kernels.groupBy("node").agg(ordered.alias("m")).select("node", F.col("m.kidx").alias("kidx"), F.flatten("m.weights").alias("weights"))


def project_on_kernels(patches: DataFrame, kernels: DataFrame, salts: int = 64) -> DataFrame:
    """``(image_id, r, c, node, kidx, value)`` for centred patches ``(image_id, r, c, node, f)`` and any table ``(node, kidx, weights)``.

    A node's patches in a batch are multiplied with its kernel matrix at once; rows per kernel are made last, from the products. The kernel values are
    counted first: a small table is sent along with the tasks and the patches stay where they are. A large one is dealt by node into buckets of about
    ``BROADCAST_VALUES`` values, each copied ``salts`` times; the patches are shuffled to a copy of their node's bucket, so that the patches of one node, which may be all
    patches, spread over as many tasks, and a task holds one bucket. Patches of nodes without kernels give no rows; a patch of another length
    than its node's kernels is an error.
    """
    matrices = kernel_matrices(kernels.select("node", "kidx", "weights"))
    values = matrices.agg(F.sum(F.size("weights"))).first()[0] or 0
    rows = patches.select(*KEYS, F.col("node").cast("int").alias("node"), F.col("f").cast("array<double>").alias("f"))
    if values <= BROADCAST_VALUES:
        known = {r.node: _matrix(r.kidx, r.weights) for r in matrices.collect()}

        def at_once(it):
            for batch in it:
                yield from _products(batch, known)

        return rows.mapInArrow(at_once, _PRODUCTS)
    buckets = int(-(-values // BROADCAST_VALUES))
    bucket, none = F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int"), F.lit(None)
    copies = matrices.select(
        bucket.alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"),
        none.cast("bigint").alias("image_id"), none.cast("int").alias("r"), none.cast("int").alias("c"), F.col("node").cast("int").alias("node"), F.col("weights").alias("f"), "kidx")
    salt = F.pmod(F.xxhash64(*KEYS), F.lit(salts)).cast("int")
    dealt = rows.select(bucket.alias("bucket"), salt.alias("salt"), F.lit(1).alias("side"), *KEYS, "node", "f", none.cast("array<int>").alias("kidx"))
    met = copies.unionByName(dealt).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "side")

    def by_bucket(it):
        key, known = None, {}
        for batch in it:
            bucket, salt, side = (batch[c].to_numpy() for c in ("bucket", "salt", "side"))
            cut = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(salt) != 0) | (np.diff(side) != 0)]) if len(side) else []
            for lo, hi in zip(cut, np.r_[cut[1:], len(side)].astype(int) if len(side) else []):
                part = batch.slice(int(lo), int(hi - lo))
                if key != (bucket[lo], salt[lo]):
                    key, known = (bucket[lo], salt[lo]), {}
                if side[lo]:
                    yield from _products(part, known)
                else:
                    for node, kidx, f in zip(*(part[c] for c in ("node", "kidx", "f"))):
                        known[node.as_py()] = _matrix(kidx.values.to_numpy(), f.values.to_numpy())

    return met.mapInArrow(by_bucket, _PRODUCTS)


_PRODUCTS = "image_id bigint, r int, c int, node int, kidx int, value double"


def _matrix(kidx, weights) -> tuple[np.ndarray, np.ndarray]:
    """(kernel numbers, kernel matrix with a kernel per row)."""
    return np.asarray(kidx, np.int32), np.asarray(weights, np.float64).reshape(len(kidx), -1)


def _products(batch: pa.RecordBatch, known: dict):
    """Rows per patch and kernel of a batch, node by node."""
    at = pc.indices_nonzero(pc.and_(pc.is_valid(batch["node"]), pc.is_valid(batch["f"])))
    batch = batch.take(at) if len(at) < batch.num_rows else batch
    nodes = batch["node"].to_numpy()
    for node in np.unique(nodes).tolist():
        if node not in known:
            continue
        kidx, weights = known[node]
        mine = np.flatnonzero(nodes == node)
        step = max(1, OUTPUT_VALUES // max(1, len(kidx)))
        for lo in range(0, len(mine), step):
            rows = batch.take(pa.array(mine[lo : lo + step]))
            n, k = rows.num_rows, len(kidx)
            if not pc.all(pc.equal(pc.list_value_length(rows["f"]), weights.shape[1]), min_count=0).as_py():
                raise ValueError(f"a patch of node {node} does not have the {weights.shape[1]} values of its kernels")
            x = rows["f"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            each = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays([*(rows[c].take(each) for c in KEYS), pa.array(np.full(n * k, node, np.int32)), pa.array(np.tile(kidx, n)), pa.array((x @ weights.T).ravel())], names=[*KEYS, "node", "kidx", "value"])


def coefficients(images: DataFrame, tree: list[dict], dims, hop: int = 0, node: int = 0) -> DataFrame:
    """``(image_id, r, c, y)``: all coefficients of one node, one row per patch, before any pooling."""
    spec, one = tree[hop]["spec"], {**tree[hop]["nodes"][node], "source": 0 if hop else node}
    above = T.leading_to(T.slim(tree[:hop]), [node])
    size = T.tree_bytes(above, dims)

    def score(it):
        for part, planes in H.good_batches(it, dims, size):
            ids = part["image_id"].to_numpy(zero_copy_only=False)
            planes = H.node_input(H.advance(planes, above), spec, one)
            hp, wp = one["out"]
            for im, rows, x in B.patch_chunks(planes, spec):
                y = B.coefficients(x, spec, one, list(range(len(one["weights"]))))
                n, hr = im.stop - im.start, rows.stop - rows.start
                yield patch_rows(ids[im], rows.start, hr, wp, y.T, "y")

    return H.image_columns(images).mapInArrow(score, "image_id bigint, r int, c int, y array<double>")


def patch_rows(ids: np.ndarray, first_row: int, rows: int, cols: int, values: np.ndarray, name: str) -> pa.RecordBatch:
    """Arrow rows ``(image_id, r, c, name)`` for patches in (image, row, column) order."""
    r = np.repeat(np.arange(first_row, first_row + rows, dtype=np.int32), cols)
    columns = [
        pa.array(np.repeat(ids, rows * cols)),
        pa.array(np.tile(r, len(ids))),
        pa.array(np.tile(np.arange(cols, dtype=np.int32), len(ids) * rows)),
        H.lists(values),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[*KEYS, name])


def invert(coefs: DataFrame, node: dict, spec: HopSpec, exact: bool = True, dc: DataFrame | None = None) -> DataFrame:
    """Patches back from their coefficients: ``(image_id, r, c, f)``.

    The kernel of the patch mean has norm ``1/sqrt(L)``, so the plain formula scales that part by ``1/L``.
    ``exact`` multiplies it by L first; ``exact=False`` gives the plain formula.
    ``dc``: the rows ``(image_id, hop, node, v)`` of the same node, if at hand; another number of patches than ``coefs`` has is an error.
    """
    if dc is not None:
        require_same_patches(coefs, dc)

    def back(it):
        for part in it:
            y = part["y"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).T
            yield pa.RecordBatch.from_arrays([*(part[k] for k in KEYS), H.lists(_back(y, node, spec, exact).T)], names=[*KEYS, "f"])

    return coefs.select(*KEYS, "y").mapInArrow(back, "image_id bigint, r int, c int, f array<double>")


def _back(y: np.ndarray, node: dict, spec: HopSpec, exact: bool) -> np.ndarray:
    """Patch columns ``(K, patches)`` from coefficient columns."""
    b, y = node["bias"] if spec.need_bias else 0.0, y.copy()
    if node["use_dc"]:
        y[0] += b
        if exact:
            y[0] *= node["dc_energy"]
    return node["weights"].T @ y - b + node["mean"][:, None]


def require_same_patches(coefs: DataFrame, dc: DataFrame) -> None:
    """An error unless there is one patch mean for each row of coefficients; one aggregate over both."""
    ones = coefs.select(F.lit(1).alias("y"), F.lit(0).alias("d"))
    both = ones.unionByName(dc.select(F.lit(0).alias("y"), F.coalesce(F.greatest(F.size("v"), F.lit(0)), F.lit(0)).alias("d")))
    n = both.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("y"), F.coalesce(F.sum("d"), F.lit(0)).alias("d")).first()
    if n.y != n.d:
        raise ValueError(f"{n.y} rows of coefficients do not go with {n.d} patch means")


def reconstruction_error(a: DataFrame, b: DataFrame, column: str = "f") -> DataFrame:
    """One row: mean absolute difference over all values of matching patches ``(image_id, r, c)`` of two tables, and how many patches ``n`` that is.

    The patches of an image are put together inside each task first, a row per image and band of ``BAND`` patch rows, and both tables' rows are hashed on
    (image, band): no patch is shuffled on its own, and a task holds one band of one image from both sides.

    Patches of one side only, a null key among them, are counted in ``n_left_only`` and ``n_right_only``; pairs of unlike length or
    with null values in ``n_unlike``. None of these is part of ``mae``, which is null if nothing matches. Patches that share a key pair off one by one in the order of their
    values; what is left over counts as one-sided. For the error of a fitted node ``round_trip_error`` needs no exchange.
    """
    sides = [_banded(df.select(*(F.col(k).cast(t).alias(k) for k, t in zip(KEYS, ("bigint", "int", "int"))), F.col(column).cast("array<double>").alias("f")), side) for side, df in enumerate((a, b))]
    met = sides[0].unionByName(sides[1]).repartition("image_id", "band").sortWithinPartitions("image_id", "band", "side")

    def compare(it):
        total, key, held = np.zeros(6), None, ([], [])
        for batch in it:
            for row in range(batch.num_rows):
                now = batch["image_id"][row].as_py(), batch["band"][row].as_py()
                if now[0] is None:
                    total[3 + batch["side"][row].as_py()] += batch["r"][row].as_py()[0]
                    continue
                if now != key:
                    total += _compared(*held)
                    key, held = now, ([], [])
                held[batch["side"][row].as_py()].append(batch.slice(row, 1))
        total += _compared(*held)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=["gap", "cells", *COUNTS])

    partial = met.mapInArrow(compare, ", ".join(f"{c} double" for c in ("gap", "cells", *COUNTS)))
    return partial.agg((F.sum("gap") / F.nullif(F.sum("cells"), F.lit(0.0))).alias("mae"), *[F.coalesce(F.sum(c), F.lit(0.0)).cast("bigint").alias(c) for c in COUNTS])


COUNTS = ("n", "n_left_only", "n_right_only", "n_unlike")
_BANDED = "image_id bigint, band int, side int, r array<int>, c array<int>, f array<array<double>>"


def _banded(patches: DataFrame, side: int) -> DataFrame:
    """The patches of each image and band as one row per batch that holds some of them."""

    def pack(it):
        for batch in it:
            keys = [batch[c] for c in KEYS]
            usable = pc.and_(pc.and_(pc.is_valid(keys[0]), pc.is_valid(keys[1])), pc.is_valid(keys[2])).to_numpy(zero_copy_only=False)
            alone = int((~usable).sum())
            if alone:  # a null key matches nothing: only the number of its patches goes on
                batch = batch.filter(pa.array(usable))
                yield pa.RecordBatch.from_pylist([{"image_id": None, "band": -1, "side": side, "r": [alone], "c": [], "f": []}], _BANDED_ARROW)
            if not batch.num_rows:
                continue
            ids, r = batch["image_id"].to_numpy(), batch["r"].to_numpy()
            order = np.lexsort((r // BAND, ids))
            batch, ids, band = batch.take(pa.array(order)), ids[order], (r // BAND)[order]
            first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (band[1:] != band[:-1])])
            yield _bands(ids[first], band[first], side, np.r_[first, len(ids)], batch["r"], batch["c"], batch["f"])

    return patches.mapInArrow(pack, _BANDED)


_BANDED_ARROW = pa.schema([
    ("image_id", pa.int64()), ("band", pa.int32()), ("side", pa.int32()), ("r", pa.list_(pa.int32())), ("c", pa.list_(pa.int32())), ("f", pa.list_(pa.list_(pa.float64()))),
])


def _bands(ids, band, side: int, cut, r, c, f) -> pa.RecordBatch:
    offsets = pa.array(cut.astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, v) for v in (r, c, f)]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(band.astype(np.int32)), pa.array(np.full(len(ids), side, np.int32)), *lists], names=_BANDED_ARROW.names)


def _packed(rows: list[pa.RecordBatch]):
    """(keys sorted, values as a matrix in that order) if no patch has null values, all are of one length and no key repeats; else None."""
    keys = [np.concatenate([row[c].flatten().to_numpy() for row in rows]).astype(np.int64) for c in ("r", "c")]
    values = pa.concat_arrays([row["f"].flatten() for row in rows])
    lengths = pc.list_value_length(values)
    if values.null_count or values.flatten().null_count or pc.min(lengths).as_py() != pc.max(lengths).as_py():
        return None
    key = (keys[0] << 32) + keys[1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    return None if (key[1:] == key[:-1]).any() else (key, values.flatten().to_numpy().reshape(len(key), -1)[order])


def _patches(rows: list[pa.RecordBatch]) -> list[tuple]:
    """(r, c, has null values, values) of the patches of some packed rows, sorted."""
    out = []
    for row in rows:
        for r, c, f in zip(row["r"].flatten().to_pylist(), row["c"].flatten().to_pylist(), row["f"].flatten()):
            whole = f.is_valid and not f.values.null_count
            out.append((r, c, not whole, tuple(f.values.to_pylist()) if whole else ()))
    return sorted(out)


def _compared(left: list, right: list) -> np.ndarray:
    """(gap, cells, n, left only, right only, unlike) of one band of one image."""
    if left and right:
        a, b = _packed(left), _packed(right)
        if a and b and a[1].shape[1] == b[1].shape[1]:
            _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
            gap = np.abs(a[1][i] - b[1][j])
            return np.array([gap.sum(), gap.size, len(i), len(a[0]) - len(i), len(b[0]) - len(i), 0])
    out, i, j = np.zeros(6), 0, 0
    a, b = _patches(left), _patches(right)
    while i < len(a) and j < len(b):
        if a[i][:2] != b[j][:2]:
            left_first = a[i][:2] < b[j][:2]
            out[3 if left_first else 4] += 1
            i, j = i + left_first, j + (not left_first)
            continue
        x, y = a[i], b[j]
        if x[2] or y[2] or len(x[3]) != len(y[3]):
            out[5] += 1
        else:
            out += [np.abs(np.subtract(x[3], y[3])).sum(), len(x[3]), 1, 0, 0, 0]
        i, j = i + 1, j + 1
    out[3] += len(a) - i
    out[4] += len(b) - j
    return out


def round_trip_error(images: DataFrame, tree: list[dict], dims, hop: int = 0, node: int = 0, exact: bool = True) -> DataFrame:
    """One row: mean absolute error ``mae`` of the patches of one node on their way to coefficients and back, and their number ``n``.

    Both ends of the way are in the same pass, so nothing is joined and a task sends one row.
    """
    spec, one = tree[hop]["spec"], {**tree[hop]["nodes"][node], "source": 0 if hop else node}
    above = T.leading_to(T.slim(tree[:hop]), [node])
    size = T.tree_bytes(above, dims)

    def compare(it):
        gap, values, n = 0.0, 0, 0
        for _, planes in H.good_batches(it, dims, size):
            for _, _, x in B.patch_chunks(H.node_input(H.advance(planes, above), spec, one), spec):
                y = B.coefficients(x.copy(), spec, one, list(range(len(one["weights"]))))
                gap += float(np.abs(_back(y, one, spec, exact) - x).sum())
                values, n = values + x.size, n + x.shape[1]
        yield pa.RecordBatch.from_pydict({"gap": [gap], "cells": [values], "n": [n]})

    partial = H.image_columns(images).mapInArrow(compare, "gap double, cells bigint, n bigint")
    return partial.agg((F.sum("gap") / F.sum("cells")).alias("mae"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
