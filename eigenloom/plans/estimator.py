"""``SubspaceEstimator`` learns the hops, ``SubspaceModel`` scores images with them."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..operators import hops as H
from ..operators import kernels as K
from ..operators import trees as T
from ..operators import vectors as V
from ..spec import HopSpec, check_hops, out_side


class SubspaceEstimator(Estimator):
    """Fits the kernels of every hop on an ``images`` frame.

    One scan per hop gives the sums of all its nodes; if any hop needs a bias, one more scan at the end
    gives all of them together. Each scan starts from the images, so give it a stored table, not a long
    computation. ``th1``: energy from which a channel goes to the next hop; ``th2``: energy from
    which it is a feature. ``emit='all'`` makes every channel from ``th2`` on a feature, forwarded or not.

    ``maps``: how a hop gets at the maps of the hop before it. ``recompute``: from the images, nothing is stored; ``stored``: from a table
    in ``store`` (a folder that all executors share), written once per hop; ``auto``: stored where that is cheaper for the hops that are left, if there is a ``store``.
    The model is the same. A fit that is started again with the same ``store``, settings and images goes on behind the last complete hop; other
    images need another folder.
    """

    def __init__(self, hops: Sequence[HopSpec], depth: int | None = None, th1: float = 0.005, th2: float = 0.001,
                 emit: str = "tail", maps: str = "auto", store: str | None = None):
        super().__init__()
        if emit not in ("tail", "all"):
            raise ValueError("emit must be 'tail' or 'all'")
        if maps not in ("auto", "recompute", "stored"):
            raise ValueError("maps must be 'auto', 'recompute' or 'stored'")
        if maps == "stored" and not store:
            raise ValueError("stored maps need a folder: give store")
        self.hops, self.th1, self.th2, self.emit = check_hops(hops, depth), float(th1), float(th2), emit
        self.maps, self.store = maps, store

    def _fit(self, images: DataFrame) -> "SubspaceModel":
        first = H.image_columns(images).head(1)
        if not first:
            raise ValueError("there are no images to fit on")
        row = first[0]
        dims = (row.height, row.width, row.channels)
        if None in dims or row.pixels is None or len(row.pixels) != row.height * row.width * row.channels:
            raise ValueError(f"image {row.image_id} does not have the pixels its shape asks for")
        if None in row.pixels or not np.isfinite(np.asarray(row.pixels, dtype=np.float64)).all():
            raise ValueError(f"image {row.image_id} misses pixels")
        h, w, c = dims
        sample = np.asarray(row.pixels, dtype=np.float64).reshape(1, h, w, c).transpose(3, 0, 1, 2)
        run = _Fit(self, images, dims, V.fits(self.hops, dims))
        if self.store and self.maps != "recompute":
            from .stages import Stages, fit_key

            run.stages = Stages(images.sparkSession, self.store, fit_key(self.hops, self.th1, self.th2, self.emit, row))
            sample = run.resumed(sample)
        while sample is not None and len(run.tree) < len(self.hops):
            sample = run.next_hop(sample)
            if sample is not None:
                run.store_maps()
        run.biases()
        model = SubspaceModel(run.tree, dims, self.th1, self.th2, self.emit, run.vectors)
        model.passes = run.passes
        return model


class _Fit:
    """State of one fit: the hops so far and those whose bias is still open.

    ``images`` of ``dims`` are what hop ``base`` reads: the caller's images, or the stored maps behind hop ``base - 1``. ``passes``: what each scan was for
    and how many hops it computed.
    """

    def __init__(self, est: SubspaceEstimator, images: DataFrame, dims, vectors: bool):
        self.est, self.images, self.dims, self.vectors = est, images, dims, vectors
        self.base, self.stages, self.passes = 0, None, []
        self.tree: list[dict] = []
        self.open: list[int] = []
        self.parents = [{"node": 0, "parent_channel": -1, "parent_energy": 1.0}]
        if est.hops[0].channelwise:
            self.parents = [{"node": i, "parent_channel": i, "parent_energy": 1.0} for i in range(dims[2])]
        self.floor = [0.0] * len(self.parents)

    def next_hop(self, sample: np.ndarray) -> np.ndarray | None:
        """Fit the next hop; return the sample's planes behind it, or None if nothing goes on."""
        h, est = len(self.tree), self.est
        spec = est.hops[h]
        if self.open and not self._carries_constants(h):
            self.biases()
        if self.tree:
            sample = H.advance(sample, T.slim(self.tree[-1:]))
        shape = (*sample.shape[2:], 1 if spec.channelwise else sample.shape[0])
        *out, _ = B.map_shape(*shape, spec)
        for side in out:
            out_side(side, spec.pool_after, spec.ragged)  # an impossible pooling fails before the scan
        shift = np.stack([_patch_mean(H.node_input(sample, spec, {"source": p["node"]}), spec) for p in self.parents])
        rows = self._solved(spec, shift, h)
        if any(r.poor_shift for r in rows):  # the first image was far off: take the sums again around the mean
            means = {r.node: r.mean for r in rows if r.kidx == 0}
            rows = self._solved(spec, np.array([means[i] for i in range(len(shift))]), h)
        self.tree.append({"spec": spec, "nodes": read_nodes(rows, tuple(out), est.emit)})
        if spec.need_bias:
            self.open.append(h)
        onward = [r for r in rows if r.role == "forward"]
        if not onward:
            if h + 1 < len(est.hops):
                warnings.warn(f"no channel of hop {h} reaches th1 = {est.th1}: depth is {h + 1}")
            return None
        onward = sorted(onward, key=lambda r: r.channel)
        self.parents = [{"node": i, "parent_channel": r.channel, "parent_energy": r.energy} for i, r in enumerate(onward)]
        # a map can carry no less than the rounding of the patches it was projected from
        self.floor = [K.ROUNDING * float(np.dot(r.weights, r.weights)) * r.spread for r in onward]
        return sample

    def store_maps(self) -> None:
        """Store what the last hop forwards, if that is asked for or pays; with its bias, which is found first."""
        left, est, hop = len(self.est.hops) - len(self.tree), self.est, self.tree[-1]
        if not self.stages or not left:
            return
        from .stages import forward_images, worth_storing

        tree = T.slim(self.tree[self.base:])
        side = hop["nodes"][0]["out"]
        out = (*(out_side(v, hop["spec"].pool_after, hop["spec"].ragged) for v in side), len(self.parents))
        biased = any(s.need_bias for s in est.hops[len(self.tree):])
        if est.maps == "auto" and not worth_storing(tree, self.dims, out, left, biased, bool(self.open)):
            return
        if T.model_bytes(tree) > T.MODEL_BYTES:
            return
        self.biases()
        maps = forward_images(self.images, self.tree[self.base:], self.dims)
        self.passes.append(("write", len(self.tree) - self.base))
        model = SubspaceModel(self.tree, self.dims, est.th1, est.th2, est.emit)
        state = {"parents": self.parents, "floor": self.floor, "dims": out}
        self.images = self.stages.write(len(self.tree) - 1, maps, model, state)
        self.dims, self.base = out, len(self.tree)

    def resumed(self, sample: np.ndarray) -> np.ndarray:
        """Take up the last hop that an earlier run stored, if there is one; returns the sample's planes that its last hop read."""
        hop = self.stages.last(len(self.est.hops) - 1)
        if hop is None:
            return sample
        hooks = {f.__name__: f for s in self.est.hops for f in (s.patch_fn, s.pool_fn) if callable(f)}
        self.tree, state = self.stages.read(hop, hooks)
        self.parents, self.floor, self.dims = state["parents"], state["floor"], tuple(state["dims"])
        self.images, self.base = self.stages.maps(hop), hop + 1
        return H.advance(sample, T.slim(self.tree[:-1]))

    def _solved(self, spec: HopSpec, shift: np.ndarray, h: int) -> list[Row]:
        """One scan: all kernels of hop ``h``."""
        if self.vectors:
            stats = V.vector_stats(self.images, shift[0])
        else:
            stats = H.image_stats(self.images, self.tree[self.base:], spec, shift, self.dims)
        self.passes.append(("sums", h - self.base + 1))
        rows = self._kernels(stats, spec, shift, h).collect()
        if any(r.node < 0 for r in rows):
            bad = next(r.n for r in rows if r.node < 0)
            raise ValueError(f"{bad} images do not have the shape {self.dims} of the first one, or miss pixels")
        return rows

    def _kernels(self, stats: DataFrame, spec: HopSpec, shift: np.ndarray, h: int) -> DataFrame:
        schema = pa.schema([("node", pa.int32()), ("parent_channel", pa.int32()), ("parent_energy", pa.float64())])
        parents = K.small_frame(self.images.sparkSession, self.parents, schema)
        solved = K.solve(stats, spec, shift, self.floor).withColumn("hop", F.lit(h))
        numbered = K.number_channels(K.child_energy(solved, parents))
        return K.assign_roles(numbered, self.est.th1, self.est.th2, len(self.est.hops))

    def _carries_constants(self, h: int) -> bool:
        """Does a constant added to a map of hop h-1 reach hop h as a constant? Then its bias can wait."""
        before, spec = self.tree[-1], self.est.hops[h]
        side = before["nodes"][0]["out"]
        pooled = tuple(out_side(v, before["spec"].pool_after, before["spec"].ragged) for v in side)
        steps = [(before["spec"].pool_after, before["spec"].ragged, side), (spec.pool_before, spec.ragged, pooled)]
        ragged = any(b > 1 and how == "pad" and any(v % b for v in dims) for b, how, dims in steps)
        own = any(callable(s.pool_fn) and b > 1 for s, b in ((before["spec"], steps[0][0]), (spec, steps[1][0])))
        return spec.patch_fn is None and not ragged and not own

    def biases(self) -> None:
        """Find the open biases in one scan and move the means of the next hop accordingly."""
        if not self.open:
            return
        if self.vectors:
            found = V.largest_residual(self.images, self.tree[0]["nodes"][0])
        else:
            found = H.residual_maxima(self.images, self.tree[self.base:], [h - self.base for h in self.open], self.dims)
        self.passes.append(("bias", max(self.open) - self.base + 1))
        for r in found.collect():
            node = self.tree[self.base + r.hop]["nodes"][r.node]
            node["bias"] = float(np.sqrt((r.sq or 0.0) / len(node["mean"])))
        for h in self.open:
            if h + 1 < len(self.tree):
                constants = channel_constants(self.tree[h])
                grow = _sum_growth(self.tree[h]["spec"], "pool_after") * _sum_growth(self.tree[h + 1]["spec"], "pool_before")
                for node in self.tree[h + 1]["nodes"]:
                    node["mean"] = node["mean"] + grow * constants[node["parent"]]
        self.open = []


def _patch_mean(planes: np.ndarray, spec: HopSpec) -> np.ndarray:
    sums = [(x.sum(axis=1), x.shape[1]) for _, _, x in B.patch_chunks(planes, spec)]
    return sum(s for s, _ in sums) / sum(n for _, n in sums)


def _sum_growth(spec: HopSpec, step: str) -> int:
    return max(1, getattr(spec, step)) ** 2 if spec.pool_fn == "sum" else 1


def channel_constants(hop: dict) -> dict[int, float]:
    """What the bias adds to each output channel of a hop."""
    out = {}
    for node in hop["nodes"]:
        for q, w in enumerate(node["weights"]):
            out[node["first"] + q] = node["bias"] * (w.sum() - (q == 0 and node["use_dc"]))
    return out


def read_nodes(rows: Sequence[Row], out: tuple[int, int], emit: str) -> list[dict]:
    """Nodes with their kernels as arrays, from kernel rows of one hop."""
    nodes = []
    for r in sorted(rows, key=lambda r: (r.node, r.kidx)):
        if r.kidx == 0:
            nodes.append({"parent": r.parent_channel, "first": r.channel, "k": r.k, "n": r.n, "mean": np.array(r.mean),
                          "bias": 0.0, "dc_energy": r.dc_energy, "use_dc": r.use_dc, "out": out, "rows": [],
                          "forward": [], "emit": []})
        node = nodes[-1]
        node["rows"].append({"is_dc": r.is_dc, "local_energy": r.local_energy, "energy": r.energy, "role": r.role})
        node.setdefault("_w", []).append(r.weights)
        if r.role == "forward":
            node["forward"].append(r.kidx)
        if r.role == "emit" or (emit == "all" and r.role == "forward"):
            node["emit"].append(r.kidx)
    for node in nodes:
        node["weights"] = np.array(node.pop("_w"))
    return nodes


def _cast(df: DataFrame, column: str, dtype: str) -> DataFrame:
    return df if dtype == "double" else df.withColumn(column, F.col(column).cast(f"array<{dtype}>"))


class SubspaceModel(Model):
    """The fitted hops. ``transform`` and its relatives are lazy, map-only plans."""

    def __init__(self, tree: list[dict], dims, th1: float, th2: float, emit: str, vectors: bool = False):
        super().__init__()
        self.tree, self.dims, self.th1, self.th2, self.emit, self.vectors = tree, tuple(dims), th1, th2, emit, vectors

    @property
    def depth(self) -> int:
        return len(self.tree)

    def transform_maps(self, images: DataFrame, select: str = "emit", dtype: str = "double") -> DataFrame:
        """``maps``: one row per image, hop and channel.

        ``select``: ``emit``, ``forward`` or ``all``; ``dtype``: ``double`` or ``float`` output.
        """
        if self.vectors:
            node, spec = self._only()
            return _cast(V.vector_maps(images, node, spec, self._chosen(select)), "v", dtype)
        return H.score_maps(images, self.tree, self.dims, select, dtype)

    def _transform(self, images: DataFrame) -> DataFrame:
        return self.transform_maps(images)

    def features(self, images: DataFrame, select: str = "emit", keep: Sequence[str] = (), dtype: str = "double") -> DataFrame:
        """One row per input row: ``image_id``, the columns in ``keep`` and ``features``, an array. Narrow at every model size."""
        if self.vectors:
            node, spec = self._only()
            return _cast(V.vector_wide(images, node, spec, self._chosen(select), keep), "features", dtype)
        return H.score_wide(images, self.tree, self.dims, select, tuple(keep), dtype)

    def dc(self, images: DataFrame) -> DataFrame:
        """``dc``: the patch means of each node after centring and bias."""
        if self.vectors:
            return V.vector_dc(images, *self._only())
        return H.score_dc(images, self.tree, self.dims)

    def _only(self):
        return self.tree[0]["nodes"][0], self.tree[0]["spec"]

    def _chosen(self, select: str) -> list[int]:
        return T.slim(self.tree, H.check_select(select))[0]["nodes"][0]["give"]

    # ---- the model as tables ----

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = [
            {"hop": h, "node": i, "parent_channel": n["parent"], "k": n["k"], "n": n["n"], "mean": n["mean"].tolist(),
             "bias": n["bias"], "dc_energy": n["dc_energy"], "use_dc": n["use_dc"], "need_bias": hop["spec"].need_bias,
             "out_height": n["out"][0], "out_width": n["out"][1]}
            for h, hop in enumerate(self.tree) for i, n in enumerate(hop["nodes"])
        ]
        return K.small_frame(spark, rows, NODES)

    def kernels(self, spark: SparkSession) -> DataFrame:
        rows = [
            {"hop": h, "node": i, "kidx": q, "channel": n["first"] + q, "weights": n["weights"][q].tolist(), **r}
            for h, hop in enumerate(self.tree) for i, n in enumerate(hop["nodes"]) for q, r in enumerate(n["rows"])
        ]
        return K.small_frame(spark, rows, KERNELS)


def _fields(*pairs) -> pa.Schema:
    return pa.schema(pairs)


_ARRAY = pa.list_(pa.float64())
NODES = _fields(
    ("hop", pa.int32()), ("node", pa.int32()), ("parent_channel", pa.int32()), ("k", pa.int32()), ("n", pa.int64()),
    ("mean", _ARRAY), ("bias", pa.float64()), ("dc_energy", pa.float64()), ("use_dc", pa.bool_()),
    ("need_bias", pa.bool_()), ("out_height", pa.int32()), ("out_width", pa.int32()),
)
KERNELS = _fields(
    ("hop", pa.int32()), ("node", pa.int32()), ("kidx", pa.int32()), ("channel", pa.int32()), ("is_dc", pa.bool_()),
    ("weights", _ARRAY), ("local_energy", pa.float64()), ("energy", pa.float64()), ("role", pa.string()),
)
