"""Column expressions on pixel arrays. All run inside the JVM, row by row, without a shuffle.

Arrays are flat, channel last and row-major: value (r, c, ch) of an H x W x C image sits at
``(r * W + c) * C + ch``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import out_side, patch_side

# Channel means and deviations used to normalise 32 x 32 colour images scaled to [0, 1].
COLOUR_MEAN = (0.4914, 0.4822, 0.4465)
COLOUR_STD = (0.247, 0.243, 0.261)


def _range(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Spark merges chained projections, so without this an array expression used inside a lambda would be
    computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lookup(values: Sequence[float], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i + 1).cast("int"))


def channel_normalise(pixels: Column, mean: Sequence[float], std: Sequence[float], scale: float = 255.0) -> Column:
    """``(x / scale - mean[c]) / std[c]`` with one mean and deviation per channel."""
    if len(mean) != len(std):
        raise ValueError("mean and std need one value per channel each")
    c = F.lit(len(mean))
    return F.transform(pixels, lambda x, k: (x / F.lit(scale) - _lookup(mean, k % c)) / _lookup(std, k % c))


def channel_last(pixels: Column, h: int, w: int, c: int) -> Column:
    """From (C, H, W) to (H, W, C)."""
    return once(pixels, lambda px: F.transform(
        _range(h * w * c), lambda k: F.get(px, (k % c) * (h * w) + F.floor(k / c).cast("int"))))


def channel_first(pixels: Column, h: int, w: int, c: int) -> Column:
    """From (H, W, C) to (C, H, W)."""
    return once(pixels, lambda px: F.transform(
        _range(h * w * c), lambda k: F.get(px, (k % (h * w)) * c + F.floor(k / (h * w)).cast("int"))))


def pad(pixels: Column, h: int, w: int, c: int, p: int, fill: float = 0.0) -> Column:
    """Constant border of ``p`` pixels on all four sides. Copies whole image rows, not single values."""
    if p == 0:
        return pixels
    edge, side = (F.array_repeat(F.lit(float(fill)), n) for n in (p * (w + 2 * p) * c, p * c))

    def rows(px):
        def row(r):
            return F.concat(side, F.slice(px, r * (w * c) + 1, F.lit(w * c)).cast("array<double>"), side)

        return F.flatten(F.transform(_range(h), row))

    return F.concat(edge, once(pixels, rows), edge)


def patches(pixels: Column, h: int, w: int, c: int, window: int, stride: int = 1, order: str = "ijc") -> Column:
    """All patches of an image as an array of arrays, by (row, column) of the patch.

    Nested inside the row, so exploding the result never copies the pixels once per patch.
    """
    hp, wp, k2 = patch_side(h, window, stride), patch_side(w, window, stride), window * window

    def feature(px, r, col):
        def at(k):
            if order == "ijc":
                di, dj, ch = F.floor(k / (window * c)), F.floor(k / c) % window, k % c
            else:
                ch, di, dj = F.floor(k / k2), F.floor(k / window) % window, k % window
            return F.get(px, (((r * stride + di) * w + col * stride + dj) * c + ch).cast("int"))

        return at

    return once(pixels, lambda px: F.transform(
        _range(hp * wp), lambda p: F.transform(_range(k2 * c), feature(px, F.floor(p / wp), p % wp))))


def pool_map(v: Column, h: int, w: int, block: int, how: str = "max", ragged: str = "pad") -> Column:
    """Reduce the blocks of one channel's map; an incomplete block is zero-filled or dropped."""
    hb, wb = out_side(h, block, ragged), out_side(w, block, ragged)

    def cells(m, p):
        r0, c0 = F.floor(p / wb) * block, (p % wb) * block
        out = []
        for a in range(block):
            for b in range(block):
                inside = (r0 + a < h) & (c0 + b < w)
                value = F.get(m, ((r0 + a) * w + c0 + b).cast("int"))
                out.append(F.when(inside, value).otherwise(F.lit(0.0)))
        return F.array(*out)

    def total(xs):
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    fold = {"max": F.array_max, "min": F.array_min, "sum": total, "avg": lambda xs: total(xs) / (block * block)}
    return once(v, lambda m: F.transform(_range(hb * wb), lambda p: fold[how](cells(m, p))))


def channel_slice(pixels: Column, size: int, c: int, ch: Column) -> Column:
    """The map of one channel of an (H, W, C) image with ``size`` = H * W."""
    return once(pixels, lambda px: F.transform(_range(size), lambda p: F.get(px, (p * c + ch).cast("int"))))


# ---- one vector or patch at a time ----


def total(f: Column) -> Column:
    return F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x)


def patch_mean(f: Column) -> Column:
    return total(f) / F.size(f)


def minus(f: Column, g: Column) -> Column:
    """Elementwise difference of two arrays."""
    return F.zip_with(f, g, lambda x, y: x - y)


def residual(f: Column) -> Column:
    """The array less its own mean."""
    return once(f, lambda g: once(patch_mean(g), lambda m: F.transform(g, lambda v: v - m)))


def norm(f: Column) -> Column:
    return F.sqrt(F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x * x))


def dot(f: Column, g: Column) -> Column:
    return F.aggregate(F.zip_with(f, g, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
