"""The fitted hops as plain dictionaries: the form in which they travel to the tasks.

A tree is a list of hops ``{"spec", "nodes"}``. A node has its ``mean``, ``bias``, ``weights``, output shape
``out``, the number ``first`` of its first channel and the kernels it sends to the next hop in ``forward``.
"""

from __future__ import annotations

MODEL_BYTES = 256 << 20  # kernels sent along with a task; a larger tree is split into lineages


def slim(tree: list[dict], select: str | None = None) -> list[dict]:
    """A tree without its reports. ``source``: the plane a node reads; ``give``: the kernels it puts out."""
    keys = ("first", "mean", "bias", "use_dc", "out", "forward", "weights")

    def one(i, node):
        give = {None: [], "all": list(range(len(node["weights"])))}.get(select, node.get(select))
        return {**{k: node[k] for k in keys}, "id": i, "source": i, "give": give}

    return [{"spec": hop["spec"], "nodes": [one(i, n) for i, n in enumerate(hop["nodes"])]} for hop in tree]


def pruned(tree: list[dict], wanted) -> list[dict]:
    """The nodes for which ``wanted(hop, node)`` holds, and of the others only what leads to them.

    Sources are renumbered to the channels that are still forwarded. ``own`` marks the wanted nodes.
    """
    out, below = [], []
    for h in range(len(tree) - 1, -1, -1):
        reads = sorted({n["source"] for n in below})
        rank = {c: i for i, c in enumerate(reads)}
        if out:
            out[0] = {**out[0], "nodes": [{**n, "source": rank[n["source"]]} for n in below]}
        below, seen = [], 0
        for node in tree[h]["nodes"]:
            on = [q for c, q in enumerate(node["forward"], seen) if c in rank]
            seen += len(node["forward"])
            own = bool(wanted(h, node))
            if on or own:
                below.append({**node, "forward": on, "own": own, "give": node["give"] if own else []})
        out.insert(0, {**tree[h], "nodes": below})
    while out and not out[-1]["nodes"]:
        out.pop()
    return out


def leading_to(tree: list[dict], channels) -> list[dict]:
    """The part of a tree that yields some of the channels its last hop forwards, in their order."""
    end = {"nodes": [{"source": c, "forward": [], "give": []} for c in channels]}
    return pruned([*tree, end], lambda h, _: h == len(tree))[: len(tree)]


def model_bytes(tree: list[dict]) -> int:
    return sum(n["weights"].nbytes for hop in tree for n in hop["nodes"])


def lineages(tree: list[dict], wanted=lambda h, node: True) -> list[list[dict]]:
    """The wanted nodes of a tree and what they need, in parts of about MODEL_BYTES; usually one part.

    A larger tree is cut by the nodes of its last hop. Those of the other hops put out with the first part.
    """
    tree = pruned(tree, wanted)
    if not tree:
        return [tree]
    nodes, last = tree[-1]["nodes"], len(tree) - 1
    per = max(1, len(nodes) * MODEL_BYTES // max(1, model_bytes(tree)))
    if per >= len(nodes):
        return [tree]
    return [
        pruned(tree, lambda h, n, ids={n["id"] for n in nodes[lo : lo + per]}, first=lo == 0:
               n["own"] and (n["id"] in ids if h == last else first))
        for lo in range(0, len(nodes), per)
    ]


def tree_bytes(tree: list[dict], dims) -> int:
    """Bytes of one image and all its maps that a task computes."""
    sizes = [dims[0] * dims[1] * dims[2]]
    sizes += [n["out"][0] * n["out"][1] * len(set(n["forward"]) | set(n["give"])) for hop in tree for n in hop["nodes"]]
    return 8 * sum(sizes)
