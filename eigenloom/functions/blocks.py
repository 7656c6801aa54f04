"""Numpy helpers that run inside Spark tasks on one Arrow batch of images.

A batch is held as channel planes ``(C, n, H, W)``, so that the maps of one channel lie together.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from ..spec import HopSpec, out_side, patch_side

CHUNK_BYTES = 8 << 20  # patch matrix worked on at a time: sized for the cache, not for the data
FOLD = {"max": np.maximum, "min": np.minimum, "avg": np.add, "sum": np.add}


def pool(planes: np.ndarray, block: int, how, ragged: str) -> np.ndarray:
    """Reduce non-overlapping blocks; an incomplete block is zero-filled or dropped.

    ``how`` is a name or a numpy reducer ``(cells, axis)``.
    """
    if block <= 1:
        return planes
    c, n, h, w = planes.shape
    hb, wb = out_side(h, block, ragged), out_side(w, block, ragged)
    if c * n == 0:
        return np.empty((c, n, hb, wb))
    if hb * block > h or wb * block > w:
        planes = np.pad(planes, ((0, 0), (0, 0), (0, hb * block - h), (0, wb * block - w)))
    planes = planes[:, :, : hb * block, : wb * block]
    if callable(how):
        return how(planes.reshape(c, n, hb, block, wb, block), axis=(3, 5))
    out = planes[:, :, ::block, ::block].copy()
    for a, b in list(np.ndindex(block, block))[1:]:
        FOLD[how](out, planes[:, :, a::block, b::block], out=out)
    return out / block**2 if how == "avg" else out


def patch_chunks(planes: np.ndarray, spec: HopSpec):
    """Yield ``(images, rows, X)``: patch columns ``X (K, patches)`` for a slice of images and map rows.

    The chunk is bounded in bytes, so neither a large batch nor one large image blows up K-fold.
    """
    c, n, h, w = planes.shape
    if spec.patch_fn is not None:
        step = max(1, CHUNK_BYTES // (8 * c * h * w))
        for a in range(0, n, step):
            x = np.asarray(spec.patch_fn(planes[:, a : a + step].transpose(1, 2, 3, 0)), dtype=np.float64)
            yield slice(a, a + x.shape[0]), slice(0, x.shape[1]), x.reshape(-1, x.shape[-1]).T.copy()
        return
    win, s = spec.window, spec.stride
    hp, wp = patch_side(h, win, s), patch_side(w, win, s)
    axes = (4, 5, 0, 1, 2, 3) if spec.order == "ijc" else (0, 4, 5, 1, 2, 3)
    row_bytes = 8 * win * win * c * wp
    images = max(1, CHUNK_BYTES // (row_bytes * hp))
    rows = hp if images > 1 else max(1, CHUNK_BYTES // row_bytes)
    for a in range(0, n, images):
        for r in range(0, hp, rows):
            r2 = min(hp, r + rows)
            view = sliding_window_view(planes[:, a : a + images, r * s : (r2 - 1) * s + win], (win, win), axis=(2, 3))
            x = view[:, :, ::s, ::s].transpose(axes).reshape(win * win * c, -1)
            yield slice(a, min(n, a + images)), slice(r, r2), x.copy() if np.may_share_memory(x, planes) else x


def map_shape(h: int, w: int, c: int, spec: HopSpec) -> tuple[int, int, int]:
    """``(H', W', K)`` of the patches that ``spec`` cuts from an ``h x w x c`` image."""
    if spec.patch_fn is not None:
        return tuple(np.asarray(spec.patch_fn(np.zeros((1, h, w, c)))).shape[1:])
    h, w = (out_side(v, spec.pool_before, spec.ragged) for v in (h, w))
    return patch_side(h, spec.window, spec.stride), patch_side(w, spec.window, spec.stride), spec.window**2 * c


def enter(planes: np.ndarray, spec: HopSpec) -> np.ndarray:
    """What a hop does to its input before cutting patches."""
    return planes if spec.patch_fn is not None else pool(planes, spec.pool_before, spec.pool_fn, spec.ragged)


def centred(x: np.ndarray, mean: np.ndarray, residual: bool) -> np.ndarray:
    """Remove the feature mean and, for the residual, each patch's own mean. Works in place."""
    x -= mean[:, None]
    if residual:
        x -= x.mean(axis=0)
    return x


def coefficients(x: np.ndarray, spec: HopSpec, node: dict, keep: list[int]) -> np.ndarray:
    """Kept coefficients ``(k, patches)`` of the columns ``x``, which are centred and biased in place."""
    bias = node["bias"] if spec.need_bias else 0.0
    if spec.center == "residual":
        centred(x, node["mean"], True)
        x += bias
    else:
        centred(x, node["mean"] - bias, False)
    y = node["weights"][keep] @ x
    if bias and node["use_dc"] and 0 in keep:
        y[keep.index(0)] -= bias
    return y


def project(planes: np.ndarray, spec: HopSpec, node: dict, keep: list[int], dc: bool = False):
    """Maps of the kept kernels ``(k, n, H', W')`` and, if asked, the patch means ``(n, H', W')`` of one node."""
    n, (hp, wp) = planes.shape[1], node["out"]
    maps, means = np.empty((len(keep), n, hp, wp)), np.empty((n, hp, wp)) if dc else None
    for im, rows, x in patch_chunks(planes, spec):
        y = coefficients(x, spec, node, keep)
        shape = (im.stop - im.start, rows.stop - rows.start, wp)
        maps[:, im, rows] = y.reshape(-1, *shape)
        if dc:
            means[im, rows] = x.mean(axis=0).reshape(shape)
    return pool(maps, spec.pool_after, spec.pool_fn, spec.ragged), means
