"""Short vectors (images of one pixel): the whole fit and projection as generated JVM code.

Up to ``MAX_K`` features the Gram sums are plain aggregate expressions, so no value crosses into
Python and only the columns in use are read. Longer vectors take the Arrow pass in ``hops``.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import HopSpec

MAX_K = 12


def fits(specs: list[HopSpec], dims) -> bool:
    """One joint hop on single pixels of at most MAX_K channels."""
    h, w, c = dims
    s = specs[0]
    return (
        len(specs) == 1 and (h, w, s.window) == (1, 1, 1) and c <= MAX_K and not s.channelwise
        and s.patch_fn is None and s.pool_before <= 1 and s.pool_after <= 1
    )


def elements(k: int) -> list[Column]:
    return [F.get(F.col("pixels"), F.lit(i)).cast("double") for i in range(k)]


def malformed(k: int) -> Column:
    """True where a row is not a 1 x 1 x K image with finite numbers only."""
    shape = (F.col("height") == 1) & (F.col("width") == 1) & (F.col("channels") == k) & (F.size("pixels") == k)
    return ~F.coalesce(reduce(and_, map(finite, elements(k)), shape), F.lit(False))


def finite(x: Column) -> Column:
    """NaN counts as larger than infinity."""
    return F.abs(x) < F.lit(float("inf"))


def vector_stats(images: DataFrame, shift: np.ndarray) -> DataFrame:
    """``stats (node, i, row)`` as in ``packed``, from one aggregate row; node -1 counts malformed rows."""
    k = len(shift)
    bad = malformed(k)
    x = [F.when(~bad, e - F.lit(float(m))).alias(f"x{i}") for i, (e, m) in enumerate(zip(elements(k), shift))]
    x0 = F.col("x0")
    sums = {(-1, -1): F.count(x0).cast("double")}
    sums.update({(i, -1): F.sum(f"x{i}") for i in range(k)})
    sums.update({(i, j): F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)})
    missing = F.count(F.when(x0.isNull(), 1)).cast("double").alias("bad")
    one = images.select(*x).agg(missing, *[v.alias(_name(c)) for c, v in sums.items()])
    lines = {(0, -1): [(-1, -1)], **{(0, i): [(i, -1), *((i, j) for j in range(i, k))] for i in range(k)}}
    rows = [_line(node, i, [F.col(_name(c)) for c in cells]) for (node, i), cells in lines.items()]
    return one.select(F.inline(F.array(*rows, _line(-1, -1, [F.col("bad")])))).filter("node = 0 or row[0] > 0")


def _line(node: int, i: int, values: list[Column]) -> Column:
    return F.struct(F.lit(node).alias("node"), F.lit(i).alias("i"), F.array(*values).alias("row"))


def _name(cell) -> str:
    return f"s_{cell[0]}_{cell[1]}".replace("-", "m")


def centred(node: dict, residual: bool) -> list[Column]:
    k = len(node["mean"])
    x = [e - F.lit(float(m)) for e, m in zip(elements(k), node["mean"])]
    if not residual:
        return x
    d = reduce(add, x) / k
    return [v - d for v in x]


def largest_residual(images: DataFrame, node: dict) -> DataFrame:
    z = centred(node, True)
    sq = F.max(F.when(~malformed(len(z)), reduce(add, [v * v for v in z])))
    return images.agg(sq.alias("sq")).select(F.lit(0).alias("hop"), F.lit(0).alias("node"), "sq")


def projected(node: dict, spec: HopSpec, keep: list[int]) -> list[Column]:
    """The kept output channels as columns of plain arithmetic."""
    bias = float(node["bias"]) if spec.need_bias else 0.0
    x = [v + bias for v in centred(node, spec.center == "residual")]
    out = []
    for q in keep:
        y = reduce(add, [v * float(w) for v, w in zip(x, node["weights"][q])])
        out.append(y - bias if q == 0 and node["use_dc"] else y)
    return out


def checked(k: int, value: Column) -> Column:
    """The value, or an error for a malformed row."""
    return F.when(malformed(k), F.raise_error(F.lit(f"a row is not a vector of {k} values"))).otherwise(value)


def vector_maps(images: DataFrame, node: dict, spec: HopSpec, keep: list[int]) -> DataFrame:
    """As ``score_maps``."""
    rows = [F.struct(F.lit(int(node["first"] + q)).alias("channel"), F.array(y).alias("v"))
            for q, y in zip(keep, projected(node, spec, keep))]
    if not rows:
        empty = "image_id bigint, hop int, channel int, height int, width int, v array<double>"
        return images.sparkSession.createDataFrame([], empty)
    wide = images.select(_id(), F.explode(checked(len(node["mean"]), F.array(*rows))).alias("m"))
    one = F.lit(1)
    return wide.select("image_id", F.lit(0).alias("hop"), "m.channel", one.alias("height"), one.alias("width"), "m.v")


def vector_wide(images: DataFrame, node: dict, spec: HopSpec, keep: list[int], also=()) -> DataFrame:
    """As ``score_wide``."""
    features = F.array(*projected(node, spec, keep)).cast("array<double>")
    return images.select(_id(), *also, checked(len(node["mean"]), features).alias("features"))


def vector_dc(images: DataFrame, node: dict, spec: HopSpec) -> DataFrame:
    """As ``score_dc``."""
    x = centred(node, spec.center == "residual")
    dc = reduce(add, x) / len(x) + (float(node["bias"]) if spec.need_bias else 0.0)
    zero = F.lit(0)
    return images.select(_id(), zero.alias("hop"), zero.alias("node"), checked(len(x), F.array(dc)).alias("v"))


def _id() -> Column:
    return F.col("image_id").cast("bigint").alias("image_id")
