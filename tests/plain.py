"""A slow two-pass model in plain numpy, written from the definitions, to test against."""

import numpy as np


def patches(x, window, stride, order="ijc"):
    """(n, H, W, C) -> (n, H', W', K), one patch at a time."""
    n, h, w, c = x.shape
    rows, cols = range(0, h - window + 1, stride), range(0, w - window + 1, stride)
    out = np.empty((n, len(rows), len(cols), window * window * c))
    for a, i in enumerate(rows):
        for b, j in enumerate(cols):
            cut = x[:, i : i + window, j : j + window, :]
            cut = cut if order == "ijc" else np.moveaxis(cut, -1, 1)
            out[:, a, b] = cut.reshape(n, -1)
    return out


def pool(x, block, how, ragged):
    if block <= 1:
        return x
    n, h, w, c = x.shape
    if ragged == "pad":
        x = np.pad(x, ((0, 0), (0, -h % block), (0, -w % block), (0, 0)))
    h, w = x.shape[1] // block, x.shape[2] // block
    out = np.empty((n, h, w, c))
    fold = {"max": np.max, "min": np.min, "avg": np.mean, "sum": np.sum}.get(how, how)
    for i in range(h):
        for j in range(w):
            cut = x[:, i * block : (i + 1) * block, j * block : (j + 1) * block, :]
            out[:, i, j] = fold(cut, axis=(1, 2))
    return out


def node(x, spec):
    """Kernels of a sample matrix (n, K): means first, then the covariance of what is left."""
    n, k = x.shape
    mean = x.mean(axis=0)
    y = x - mean
    d = y.mean(axis=1, keepdims=True)
    z = y - d
    values, vectors = np.linalg.eigh(z.T @ z / max(n - spec.ddof, 1))
    values, kernels = values[::-1], vectors.T[::-1]
    if spec.sign_align:
        kernels = np.array([row if max(row) >= -min(row) else -row for row in kernels])
    level = k * d.var()
    use_dc = spec.use_dc and level > 1e-20
    if use_dc:
        kernels = np.vstack([np.ones(k) / np.sqrt(k) / np.sqrt(level), kernels[:-1]])
        values = np.concatenate([[level], values[:-1]])
    energy = values / values.sum() if values.sum() > 1e-20 else 0 * values
    keep = k if spec.num_kernels == -1 else spec.num_kernels
    bias = np.sqrt((z * z).sum(axis=1)).max() / np.sqrt(k) if spec.need_bias else 0.0
    return {"mean": mean, "kernels": kernels[:keep], "energy": energy[:keep], "bias": bias, "use_dc": use_dc, "dc_energy": level}


def project(x, p, spec):
    y = x - p["mean"]
    if spec.center == "residual":
        y = y - y.mean(axis=-1, keepdims=True)
    y = y + p["bias"]
    out = y @ p["kernels"].T
    if p["use_dc"]:
        out[..., 0] -= p["bias"]
    return out, y.mean(axis=-1)


def tree(x, specs, th1, th2):
    """Fit and score all hops: one dict per hop with nodes, energies, roles, maps (n, H, W, C) and dc."""
    hops, inputs, parent = [], None, None
    for h, spec in enumerate(specs):
        if h == 0:
            inputs = [x[..., [c]] for c in range(x.shape[-1])] if spec.channelwise else [x]
            parent = [1.0] * len(inputs)
        nodes, maps, dcs, energy = [], [], [], []
        for img, e in zip(inputs, parent):
            cut = patches(pool(img, spec.pool_before, spec.pool_fn, spec.ragged), spec.window, spec.stride, spec.order)
            p = node(cut.reshape(-1, cut.shape[-1]), spec)
            out, dc = project(cut, p, spec)
            nodes.append(p)
            dcs.append(dc)
            energy.append(p["energy"] * e)
            maps.append(pool(out, spec.pool_after, spec.pool_fn, spec.ragged))
        maps, energy = np.concatenate(maps, axis=-1), np.concatenate(energy)
        last = h == len(specs) - 1
        role = np.where(energy <= 0, "discard", np.where(
            (energy >= th1) & (not last), "forward", np.where(energy >= th2, "emit", "discard")))
        hops.append({"nodes": nodes, "energy": energy, "role": role, "maps": maps, "dc": dcs})
        on = np.flatnonzero(role == "forward")
        if len(on) == 0:
            break
        inputs, parent = [maps[..., [c]] for c in on], energy[on]
    return hops
