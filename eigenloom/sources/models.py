"""A fitted model as three small Parquet tables: ``nodes``, ``kernels`` and ``meta``."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

from ..operators.kernels import small_frame
from ..plans.estimator import SubspaceModel, read_nodes
from ..spec import HopSpec

META = pa.schema([("key", pa.string()), ("value", pa.string())])


def save_model(model: SubspaceModel, spark: SparkSession, path: str, mode: str = "error") -> None:
    """Write the tables; ``meta`` comes last, so a folder with ``meta`` is complete."""
    meta = {"depth": model.depth, "th1": model.th1, "th2": model.th2, "emit": model.emit, "dims": model.dims,
            "vectors": model.vectors}
    rows = [{"key": k, "value": json.dumps(v)} for k, v in meta.items()]
    rows += [{"key": f"hop{h}", "value": hop["spec"].to_json()} for h, hop in enumerate(model.tree)]
    tables = [("nodes", model.nodes(spark)), ("kernels", model.kernels(spark)), ("meta", small_frame(spark, rows, META))]
    for name, df in tables:
        df.coalesce(1).write.mode(mode).parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, hooks: dict[str, Callable] | None = None) -> SubspaceModel:
    """Read a model back. ``hooks`` gives the patch functions that were saved by name."""
    meta = {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}
    get = {k: json.loads(meta[k]) for k in ("depth", "th1", "th2", "emit", "dims", "vectors")}
    nodes = spark.read.parquet(f"{path}/nodes")
    kernels = spark.read.parquet(f"{path}/kernels")
    rows = kernels.join(nodes, ["hop", "node"]).collect()
    tree = []
    for h in range(get["depth"]):
        here = [r for r in rows if r.hop == h]
        out = (here[0].out_height, here[0].out_width)
        hop_nodes = read_nodes(here, out, get["emit"])
        biases = {r.node: r.bias for r in here}
        for i, node in enumerate(hop_nodes):
            node["bias"] = biases[i]
        tree.append({"spec": HopSpec.from_json(meta[f"hop{h}"], hooks), "nodes": hop_nodes})
    return SubspaceModel(tree, get["dims"], get["th1"], get["th2"], get["emit"], get["vectors"])
