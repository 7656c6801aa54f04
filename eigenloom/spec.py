"""Settings of one hop, checked when they are written down."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

POOLS = ("max", "min", "avg", "sum")


@dataclass(frozen=True)
class HopSpec:
    """How one hop cuts patches and builds kernels.

    ``window``/``stride``: square patches, stride = window tiles the image.
    ``pool_before``/``pool_after``: block side of a pooling step before the patches or after the
    projection (0 = none); ``ragged`` says whether an incomplete block at the right or lower edge
    is filled with zeros (``pad``) or left out (``drop``).
    ``channelwise``: hop 0 only; later hops always work channel by channel.
    ``num_kernels``: keep the first n kernels (-1 = all). ``center``: project ``x - mean`` or the
    residual that also lost its patch mean. ``order``: feature order inside a patch, pixel position
    first (``ijc``) or channel first (``cij``).
    ``pool_fn``: a name from ``POOLS`` or a numpy reducer ``(cells, axis) -> values``.
    ``patch_fn``: own neighbourhood function, numpy ``(n, H, W, C) -> (n, H', W', K)``, run per batch
    inside the Spark task in place of the built-in pooling and patches. Functions are saved by name only.
    """

    window: int = 2
    stride: int = 1
    pool_before: int = 0
    pool_after: int = 0
    pool_fn: str | Callable = "max"
    ragged: str = "pad"
    channelwise: bool | None = None
    use_dc: bool = True
    need_bias: bool = False
    num_kernels: int = -1
    sign_align: bool = True
    ddof: int = 1
    center: str = "mean"
    order: str = "ijc"
    patch_fn: Callable | None = None

    def __post_init__(self):
        _require(self.window >= 1 and self.stride >= 1, "window and stride must be at least 1")
        _require(self.pool_before >= 0 and self.pool_after >= 0, "pooling blocks must be 0 or more")
        _require(self.pool_fn in POOLS or callable(self.pool_fn), f"pool_fn must be one of {POOLS} or a function")
        _require(self.ragged in ("pad", "drop"), "ragged must be 'pad' or 'drop'")
        _require(self.num_kernels == -1 or self.num_kernels >= 1, "num_kernels must be -1 or positive")
        _require(self.ddof in (0, 1), "ddof must be 0 or 1")
        _require(self.center in ("mean", "residual"), "center must be 'mean' or 'residual'")
        _require(self.order in ("ijc", "cij"), "order must be 'ijc' or 'cij'")
        _require(self.patch_fn is None or callable(self.patch_fn), "patch_fn must be callable")

    def to_json(self) -> str:
        """The settings as JSON, with functions replaced by their names."""
        plain = asdict(replace(self, patch_fn=None, pool_fn="max" if callable(self.pool_fn) else self.pool_fn))
        names = {k: getattr(self, k).__name__ for k in ("patch_fn", "pool_fn") if callable(getattr(self, k))}
        return json.dumps({"settings": plain, "functions": names}, sort_keys=True)

    @staticmethod
    def from_json(text: str, hooks: dict[str, Callable] | None = None) -> "HopSpec":
        d, hooks = json.loads(text), hooks or {}
        missing = sorted(set(d["functions"].values()) - set(hooks))
        _require(not missing, f"this model needs the functions {missing}: pass them in hooks")
        return HopSpec(**{**d["settings"], **{k: hooks[name] for k, name in d["functions"].items()}})


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def check_hops(hops: Sequence[HopSpec], depth: int | None) -> list[HopSpec]:
    """The hops to run: ``depth`` is clamped to the number of specs, with a warning."""
    _require(bool(hops), "at least one HopSpec is needed")
    _require(all(isinstance(h, HopSpec) for h in hops), "hops must be HopSpec objects")
    depth = len(hops) if depth is None else int(depth)
    _require(depth > 0, "depth must be positive")
    if depth > len(hops):
        warnings.warn(f"depth {depth} needs {depth} hop specs, only {len(hops)} given: depth is {len(hops)}")
        depth = len(hops)
    _require(all(h.channelwise is not False for h in hops[1:]), "hops after the first are always channel-wise")
    return [replace(h, channelwise=bool(h.channelwise) or i > 0) for i, h in enumerate(hops[:depth])]


def out_side(side: int, block: int, ragged: str) -> int:
    """Side of a map after pooling in blocks."""
    if block <= 1:
        return side
    _require(ragged == "pad" or side >= block, f"a map side of {side} is smaller than the pooling block {block}")
    return -(-side // block) if ragged == "pad" else side // block


def patch_side(side: int, window: int, stride: int) -> int:
    """Number of patches along one side."""
    _require(side >= window, f"a map side of {side} is smaller than the window {window}")
    return (side - window) // stride + 1
