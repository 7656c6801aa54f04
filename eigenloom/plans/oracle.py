"""Plain SQL for the registered queries, written for DuckDB, from the definitions.

With 2 x 2 patches of one channel a node has four features. The residual covariance then lives in the
three dimensions orthogonal to (1,1,1,1), and its eigenvectors have a closed form: so the whole fit, over
all patches of all images, can be written in SQL. The same holds for vectors of three columns.
"""

from __future__ import annotations

IMG = "img AS (SELECT vec_id AS image_id, label, CAST(embedding AS DOUBLE[]) AS p FROM embeddings)"


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def with_(*ctes: str) -> str:
    """Each step is computed once: inlined, a two-hop tree is planned (and, under a LIMIT, run) once for every reference to its steps."""
    return "WITH " + ",\n".join(c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes) + "\n"


def pixels(h: int, w: int, c: int, name: str = "px") -> str:
    """One row per pixel value; ``node`` is the channel."""
    return (
        f"{name} AS (SELECT image_id, k % {c} AS node, k // {w * c} AS r, (k // {c}) % {w} AS c, p[k + 1] AS v "
        f"FROM img, range({h * w * c}) t(k))"
    )


def patches(h: int, w: int, c: int, win: int, stride: int, order: str = "ijc", name: str = "pt") -> str:
    """One row per patch value."""
    hp, wp, k2 = (h - win) // stride + 1, (w - win) // stride + 1, win * win
    di, dj, ch = (
        (f"k // {win * c}", f"(k // {c}) % {win}", f"k % {c}")
        if order == "ijc"
        else (f"(k % {k2}) // {win}", f"k % {win}", f"k // {k2}")
    )
    return (
        f"{name} AS (SELECT image_id, r, c, k, p[((r * {stride} + {di}) * {w} + c * {stride} + {dj}) * {c} + {ch} + 1] AS x "
        f"FROM img, range({hp}) a(r), range({wp}) b(c), range({k2 * c}) d(k))"
    )


def quads(name: str, src: str, side: int, stride: int) -> str:
    """2 x 2 patches of each node's map, one row per patch."""
    cell = ", ".join(f"max(CASE WHEN di = {i} AND dj = {j} THEN v END) AS x{2 * i + j}" for i in (0, 1) for j in (0, 1))
    return (
        f"{name} AS (SELECT node, image_id, pr AS r, pc AS c, {cell} FROM ("
        f"SELECT node, image_id, di, dj, (r - di) // {stride} AS pr, (c - dj) // {stride} AS pc, v "
        f"FROM {src}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(di, dj) "
        f"WHERE r >= di AND c >= dj AND (r - di) % {stride} = 0 AND (c - dj) % {stride} = 0) q "
        f"WHERE pr < {side} AND pc < {side} GROUP BY node, image_id, pr, pc)"
    )


def fit4(pre: str, quad: str, ddof: int = 1, use_dc: bool = True) -> list[str]:
    """``{pre}_st`` (means, DC energy, bias) and ``{pre}_k`` (kernels, local energies) per node."""
    cov = "covar_samp" if ddof else "covar_pop"
    s2 = "sqrt(2.0)"
    u = (f"(x0 - x1) / {s2} AS u1, (x2 - x3) / {s2} AS u2, (x0 + x1 - x2 - x3) / 2.0 AS u3, "
         "(x0 + x1 + x2 + x3) / 4.0 AS d")
    rows = [
        f"{pre}_u AS (SELECT *, {u} FROM {quad})",
        f"{pre}_m AS (SELECT node, count(*) AS n, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, "
        f"avg(u1) AS a1, avg(u2) AS a2, avg(u3) AS a3, 4 * var_pop(d) AS l, "
        f"{cov}(u1, u1) AS a, {cov}(u2, u2) AS b, {cov}(u3, u3) AS c, "
        f"{cov}(u1, u2) AS d, {cov}(u1, u3) AS e, {cov}(u2, u3) AS f FROM {pre}_u GROUP BY node)",
        f"{pre}_st AS (SELECT m.node, n, m0, m1, m2, m3, l, g.bias FROM {pre}_m m JOIN (SELECT node, "
        f"sqrt(max((u1 - a1) ** 2 + (u2 - a2) ** 2 + (u3 - a3) ** 2)) / 2.0 AS bias "
        f"FROM {pre}_u JOIN {pre}_m USING (node) GROUP BY node) g USING (node))",
        f"{pre}_q AS (SELECT *, (a + b + c) / 3 AS q FROM {pre}_m)",
        f"{pre}_dev AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM {pre}_q)",
        f"{pre}_t AS (SELECT *, acos(greatest(-1.0, least(1.0, ((a - q) * ((b - q) * (c - q) - f * f) "
        f"- d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p ** 3)))) / 3 AS phi FROM {pre}_dev)",
        f"{pre}_l AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM {pre}_t)",
        f"{pre}_v AS (SELECT node, a, b, c, d, e, f, j, CASE j WHEN 1 THEN l1 WHEN 2 THEN 3 * q - l1 - l3 ELSE l3 END AS lam "
        f"FROM {pre}_l, range(1, 4) t(j))",
        f"{pre}_c AS (SELECT node, j, lam, "
        "[d * f - e * (b - lam), e * d - (a - lam) * f, (a - lam) * (b - lam) - d * d] AS c12, "
        "[d * (c - lam) - e * f, e * e - (a - lam) * (c - lam), (a - lam) * f - d * e] AS c13, "
        f"[(b - lam) * (c - lam) - f * f, f * e - d * (c - lam), d * f - (b - lam) * e] AS c23 FROM {pre}_v)",
        f"{pre}_e AS (SELECT node, j, lam, CASE "
        "WHEN list_inner_product(c12, c12) >= greatest(list_inner_product(c13, c13), list_inner_product(c23, c23)) THEN c12 "
        "WHEN list_inner_product(c13, c13) >= list_inner_product(c23, c23) THEN c13 ELSE c23 END AS e "
        f"FROM {pre}_c)",
        f"{pre}_w AS (SELECT node, j, lam, [e[1] / {s2} + e[3] / 2, -e[1] / {s2} + e[3] / 2, e[2] / {s2} - e[3] / 2, "
        f"-e[2] / {s2} - e[3] / 2] AS w, sqrt(list_inner_product(e, e)) AS size FROM {pre}_e)",
        f"{pre}_s AS (SELECT node, j, lam, size, w, list_max(list_transform(w, lambda x: abs(x))) AS top FROM {pre}_w)",
        f"{pre}_a AS (SELECT node, j, lam, list_transform(w, lambda x: x / size * sign(list_filter(w, "
        f"lambda y: abs(y) >= (1 - 1e-9) * top)[1])) AS w FROM {pre}_s)",
    ]
    if use_dc:
        rows.append(
            f"{pre}_k AS (SELECT node, j AS kidx, FALSE AS is_dc, w, lam / t AS local_energy FROM {pre}_a "
            f"JOIN (SELECT node, l + 3 * q AS t FROM {pre}_l) USING (node) UNION ALL "
            f"SELECT node, 0, TRUE, list_transform(range(4), lambda x: 1 / (2 * sqrt(l))), l / (l + 3 * q) FROM {pre}_l)"
        )
    else:
        rows.append(
            f"{pre}_k AS (SELECT node, j - 1 AS kidx, FALSE AS is_dc, w, lam / t AS local_energy FROM {pre}_a "
            f"JOIN (SELECT node, 3 * q AS t FROM {pre}_l) USING (node) UNION ALL "
            f"SELECT node, 3, FALSE, [0.5, 0.5, 0.5, 0.5], 0.0 FROM {pre}_l)"
        )
    return rows


def roles(pre: str, parents: str | None, th1: float, th2: float, last: bool) -> str:
    """``{pre}_r``: kernels with energy, channel number and role. ``parents (node, energy)``."""
    energy = "local_energy" if parents is None else "local_energy * pe"
    join = "" if parents is None else f" JOIN (SELECT node, energy AS pe FROM {parents}) USING (node)"
    forward = "" if last else f"WHEN energy >= {th1} THEN 'forward' "
    return (
        f"{pre}_r AS (SELECT *, row_number() OVER (ORDER BY node, kidx) - 1 AS channel, "
        f"CASE {forward}WHEN energy >= {th2} THEN 'emit' ELSE 'discard' END AS role "
        f"FROM (SELECT *, {energy} AS energy FROM {pre}_k{join}))"
    )


def children(pre: str) -> str:
    """``{pre}_f``: forwarded channels as nodes of the next hop."""
    return (
        f"{pre}_f AS (SELECT row_number() OVER (ORDER BY channel) - 1 AS node, channel, energy "
        f"FROM {pre}_r WHERE role = 'forward')"
    )


def score4(pre: str, quad: str, bias: bool = False, use_dc: bool = True) -> str:
    """``{pre}_o``: the output value of every patch and kernel."""
    b = "s.bias" if bias else "0.0"
    minus = f" - CASE WHEN k.is_dc THEN {b} ELSE 0.0 END" if bias else ""
    dot = " + ".join(f"(x{i} - m{i} + {b}) * k.w[{i + 1}]" for i in range(4))
    return (
        f"{pre}_o AS (SELECT x.image_id, k.channel, k.role, x.node, k.kidx, x.r, x.c, {dot}{minus} AS v "
        f"FROM {quad} x JOIN {pre}_st s USING (node) JOIN {pre}_r k USING (node))"
    )


def next_maps(name: str, pre: str, src: str | None = None) -> str:
    """Maps of the forwarded channels, keyed by the node of the next hop."""
    return f"{name} AS (SELECT f.node, image_id, r, c, v FROM {src or pre + '_o'} JOIN {pre}_f f USING (channel))"


def pool(name: str, src: str, side: int, block: int, how: str, ragged: str, keys: str = "image_id, channel") -> str:
    """Block pooling of square maps; padding adds zeros to the incomplete blocks."""
    out = -(-side // block) if ragged == "pad" else side // block
    full = block * block
    fold = {
        "max": f"CASE WHEN count(*) < {full} THEN greatest(max(v), 0.0) ELSE max(v) END",
        "min": f"CASE WHEN count(*) < {full} THEN least(min(v), 0.0) ELSE min(v) END",
        "sum": "sum(v)",
        "avg": f"sum(v) / {full}",
        "median": "median(v)",
    }[how]
    return (
        f"{name} AS (SELECT {keys}, r // {block} AS r, c // {block} AS c, {fold} AS v FROM {src} "
        f"WHERE r // {block} < {out} AND c // {block} < {out} GROUP BY {keys}, r // {block}, c // {block})"
    )
