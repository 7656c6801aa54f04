"""Passes over an image table. Each is one scan and ships only per-task sums, maxima or final maps.

An image row holds all that its own hop tree needs. So a pass recomputes the earlier hops from the
pixels instead of storing their maps, which are several times larger than the images: no intermediate
table, no shuffle of pixels, and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..spec import HopSpec
from . import packed as PK
from . import trees as T

BATCH_BYTES = 64 << 20  # maps of one sub-batch of images inside a task
STATE_BYTES = 512 << 20  # Gram matrices a task may hold; more nodes are split over several frames
COLUMNS = ("image_id", "height", "width", "channels", "pixels")


def image_columns(images: DataFrame, keep=()) -> DataFrame:
    return images.select(F.col("image_id").cast("bigint").alias("image_id"), *COLUMNS[1:], *keep)


def usable(part: pa.RecordBatch, sides: dict[str, int], column: str, size: int) -> np.ndarray:
    """Rows with the expected sides and ``size`` values, all of them finite numbers."""
    ok = np.ones(part.num_rows, dtype=bool)
    checks = [pc.equal(part[name], want) for name, want in sides.items()]
    for check in (*checks, pc.equal(pc.list_value_length(part[column]), size)):
        ok &= pc.fill_null(check, False).to_numpy(zero_copy_only=False)
    values = part[column].flatten()
    fine = pc.fill_null(pc.is_finite(values), False) if pa.types.is_floating(values.type) else pc.is_valid(values)
    if not pc.all(fine, min_count=0).as_py():
        ok[np.unique(pc.list_parent_indices(part[column]).filter(pc.invert(fine)).to_numpy())] = False
    return ok


def read_batches(it: Iterator[pa.RecordBatch], dims, image_bytes: int):
    """Yield ``(rows, planes (C, n, H, W), malformed)`` for slices whose maps stay within BATCH_BYTES."""
    h, w, c = dims
    sides = {"height": h, "width": w, "channels": c}
    step = max(1, BATCH_BYTES // max(1, image_bytes))
    for batch in it:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            ok = usable(part, sides, "pixels", h * w * c)
            bad = int((~ok).sum())
            if bad:
                part = part.filter(pa.array(ok))
            x = part["pixels"].flatten().to_numpy(zero_copy_only=False)
            planes = x.reshape(part.num_rows, h, w, c).transpose(3, 0, 1, 2)
            yield part, np.ascontiguousarray(planes, dtype=np.float64), bad


def node_input(planes: np.ndarray, spec: HopSpec, node: dict) -> np.ndarray:
    return B.enter(planes[node["source"]][None] if spec.channelwise else planes, spec)


def advance(planes: np.ndarray, tree: list[dict]) -> np.ndarray:
    """The planes that reach the hop after ``tree``: one per forwarded channel."""
    for hop in tree:
        spec = hop["spec"]
        planes = np.concatenate([
            B.project(node_input(planes, spec, node), spec, node, node["forward"])[0]
            for node in hop["nodes"] if node["forward"]
        ])
    return planes


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---- statistics ----


def image_stats(images: DataFrame, tree: list[dict], spec: HopSpec, shift: np.ndarray, dims) -> DataFrame:
    """``stats (node, i, row)`` of every node of the hop after ``tree``, in one scan; the rows are those of ``packed``.

    Values are taken relative to ``shift``. Each task sends its sums once, a record per node and feature.
    """
    nodes, k = shift.shape
    tree = T.slim(tree)
    per = max(1, STATE_BYTES // (8 * k * (k + 2)))
    if tree:
        per = min(per, max(1, nodes * T.MODEL_BYTES // T.model_bytes(tree)))
    source, frames = image_columns(images), []
    for lo in range(0, nodes, per):
        part = range(lo, min(nodes, lo + per))
        above = T.leading_to(tree, part) if tree and len(part) < nodes else tree
        frames.append(_partial_sums(source, above, spec, shift, dims, part))
    return PK.summed(union(frames))


def add_patches(state: dict, node: int, planes: np.ndarray, spec: HopSpec, shift: np.ndarray | None) -> None:
    """Add the shifted patches of ``planes`` to the sums of one node."""
    for _, _, x in B.patch_chunks(planes, spec):
        if shift is not None:
            x -= shift[:, None]
        n, s, g = state.get(node, (0, 0.0, 0.0))
        state[node] = (n + x.shape[1], s + x.sum(axis=1), g + x @ x.T)


def state_rows(state: dict, bad: int = 0) -> Iterator[pa.RecordBatch]:
    """The sums as packed rows, in batches of bounded size."""
    rows = (line for node, sums in state.items() for line in PK.lines(node, *sums))
    return PK.batches([(-1, -1, [float(bad)]), *rows] if bad else rows)


def _partial_sums(source, tree, spec, shift, dims, part: range) -> DataFrame:
    size, skipped = T.tree_bytes(tree, dims), part.start if tree else 0

    def sums(it):
        state, bad = {}, 0
        for _, planes, b in read_batches(it, dims, size):
            bad += b
            planes = advance(planes, tree)
            for i in part:
                add_patches(state, i, node_input(planes, spec, {"source": i - skipped}), spec, shift[i])
        yield from state_rows(state, bad if part.start == 0 else 0)

    return source.mapInArrow(sums, PK.SCHEMA)


def residual_maxima(images: DataFrame, tree: list[dict], hops: list[int], dims) -> DataFrame:
    """``(hop, node, sq)``: the largest squared residual norm of each node of ``hops``, in one scan."""
    parts = T.lineages(T.slim(tree), lambda h, _: h in hops)
    frames = [_partial_maxima(image_columns(images), part, dims) for part in parts]
    return union(frames).groupBy("hop", "node").agg(F.max("sq").alias("sq"))


def _partial_maxima(source, tree, dims) -> DataFrame:
    size = T.tree_bytes(tree, dims)
    schema = pa.schema([("hop", pa.int32()), ("node", pa.int32()), ("sq", pa.float64())])

    def maxima(it):
        best: dict = {}
        for _, planes, _ in read_batches(it, dims, size):
            for h, hop in enumerate(tree):
                for node in hop["nodes"]:
                    if node["own"]:
                        key = h, node["id"]
                        best[key] = max(best.get(key, 0.0), largest(node_input(planes, hop["spec"], node), hop["spec"], node))
                if h + 1 < len(tree):
                    planes = advance(planes, [hop])
        yield pa.RecordBatch.from_pylist([{"hop": h, "node": i, "sq": v} for (h, i), v in best.items()], schema)

    return source.mapInArrow(maxima, "hop int, node int, sq double")


def largest(planes: np.ndarray, spec: HopSpec, node: dict) -> float:
    """The largest squared residual norm of a node's patches."""
    best = 0.0
    for _, _, x in B.patch_chunks(planes, spec):
        x = B.centred(x, node["mean"], True)
        best = max(best, float((x * x).sum(axis=0).max(initial=0.0)))
    return best


# ---- output ----

MAPS = "image_id bigint, hop int, channel int, height int, width int, v array<double>"
DC = "image_id bigint, hop int, node int, v array<double>"


def _score(planes, tree, dc=False):
    """Yield ``(hop, node, channels, maps, patch means)`` of every node, computing only the kernels in use."""
    for h, hop in enumerate(tree):
        onward = []
        for node in hop["nodes"]:
            give, on = node["give"], node["forward"]
            keep = sorted(set(give) | set(on))
            maps, means = B.project(node_input(planes, hop["spec"], node), hop["spec"], node, keep, dc)
            if on:
                onward.append(_pick(maps, keep, on))
            yield h, node, [node["first"] + q for q in give], _pick(maps, keep, give), means
        if onward:
            planes = np.concatenate(onward) if len(onward) > 1 else onward[0]


def _pick(maps: np.ndarray, kept: list[int], some: list[int]) -> np.ndarray:
    return maps if some == kept else maps[[kept.index(q) for q in some]]


def gives(h: int, node: dict) -> bool:
    return bool(node["give"])


def lists(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int64) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def good_batches(it, dims, size):
    for part, planes, bad in read_batches(it, dims, size):
        if bad:
            raise ValueError(f"{bad} images do not have the fitted shape {dims} or miss pixels")
        if part.num_rows:
            yield part, planes


OUTPUT = {"double": np.float64, "float": np.float32}  # computation is always in double


def check_select(select: str) -> str:
    if select not in ("emit", "forward", "all"):
        raise ValueError("select must be 'emit', 'forward' or 'all'")
    return select


def score_maps(images: DataFrame, tree: list[dict], dims, select: str = "emit", dtype: str = "double") -> DataFrame:
    """One row per image and chosen channel. Map-only and lazy."""
    kind = OUTPUT[dtype]

    def scored(tree):
        size = T.tree_bytes(tree, dims)

        def score(it):
            for part, planes in good_batches(it, dims, size):
                ids = part["image_id"].to_numpy(zero_copy_only=False)
                for h, _, channels, maps, _ in _score(planes, tree):
                    if channels:
                        yield map_rows(ids, h, channels, maps.astype(kind, copy=False))

        return image_columns(images).mapInArrow(score, MAPS.replace("array<double>", f"array<{dtype}>"))

    return union([scored(part) for part in T.lineages(T.slim(tree, check_select(select)), gives)])


MAP_NAMES = ["image_id", "hop", "channel", "height", "width", "v"]


def map_rows(ids: np.ndarray, hop: int, channels: list[int], maps: np.ndarray) -> pa.RecordBatch:
    """Arrow rows of ``maps`` for some channels ``(k, n, H, W)`` of the images ``ids``."""
    k, n, h, w = maps.shape
    hop, h_, w_ = (pa.array(np.full(k * n, v, np.int32)) for v in (hop, h, w))
    numbers = pa.array(np.repeat(np.asarray(channels, np.int32), n))
    columns = [pa.array(np.tile(ids, k)), hop, numbers, h_, w_, lists(maps.reshape(k * n, -1))]
    return pa.RecordBatch.from_arrays(columns, names=MAP_NAMES)


def score_dc(images: DataFrame, tree: list[dict], dims) -> DataFrame:
    """Patch means after centring and bias, one row per image, hop and node."""

    def scored(tree):
        size = T.tree_bytes(tree, dims)

        def score(it):
            for part, planes in good_batches(it, dims, size):
                n, ids = part.num_rows, part["image_id"].cast(pa.int64())
                for h, node, _, _, means in _score(planes, tree, True):
                    if node["own"]:
                        numbers = (pa.array(np.full(n, v, np.int32)) for v in (h, node["id"]))
                        columns = [ids, *numbers, lists(means.reshape(n, -1))]
                        yield pa.RecordBatch.from_arrays(columns, names=["image_id", "hop", "node", "v"])

        return image_columns(images).mapInArrow(score, DC)

    return union([scored(part) for part in T.lineages(T.slim(tree))])


def score_wide(images: DataFrame, tree: list[dict], dims, select: str, keep=(), dtype: str = "double") -> DataFrame:
    """One row per input row: all chosen channels end to end, by (hop, channel, row, column).

    A large tree is scored by one narrow pass per lineage in the same stage; each appends its channels to the row it is given. So no pass
    holds more than one lineage, and neither ids nor their uniqueness matter: repeated and null ids keep their own rows at any model size.
    """
    parts = T.lineages(T.slim(tree, check_select(select)), gives)
    rows = image_columns(images, [c for c in keep if c not in COLUMNS])
    for number, part in enumerate(parts):
        rows = _widened(rows, part, dims, keep, dtype, number == 0, number == len(parts) - 1)
    return rows


def _widened(rows: DataFrame, tree: list[dict], dims, keep, dtype: str, first: bool, last: bool) -> DataFrame:
    kind, size = OUTPUT[dtype], T.tree_bytes(tree, dims)
    given = rows.columns if first else rows.columns[:-1]
    names = ["image_id", *(c for c in keep if c != "image_id")] if last else given
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def score(it):
        for part, planes in good_batches(it, dims, size):
            n = part.num_rows
            got = [m.transpose(1, 0, 2, 3).reshape(n, -1) for _, _, ch, m, _ in _score(planes, tree) if ch]
            if not first:
                got.insert(0, part["features"].flatten().to_numpy().reshape(n, -1))
            wide = np.concatenate(got, axis=1) if got else np.empty((n, 0))
            values = lists(wide.astype(kind, copy=False))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names), values], names=[*names, "features"])

    return rows.mapInArrow(score, f"{types}, features array<{dtype}>")
