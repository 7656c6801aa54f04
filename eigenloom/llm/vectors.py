"""What the vector searches share: usable vectors, bounded samples, and the best candidates of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates in one block at most, about; scores held at once.
BLOCK = 16_384
SCORES = 2_000_000


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """(id long, v array<double>): vectors with an id whose components are all there and finite, of the commonest dimension (ties: the larger)."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
    if nonzero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    found = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (found[0]["d"] if found else 0))


def sample(rows: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """At most ``n`` of the vectors, those with the smallest hashes of their ids."""
    got = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select("v").toArrow().column("v").combine_chunks()
    return matrix(got)


def matrix(lists: pa.Array) -> np.ndarray:
    n = len(lists)
    if not n:
        return np.zeros((0, 0))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64)


def as_lists(m: np.ndarray) -> pa.Array:
    n, d = m.shape if m.size else (len(m), 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(m.ravel().astype(np.float64)))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def best_of_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score): each query's k largest inner products, ties to smaller ids, its own id left out.

    ``whole``: components are whole numbers and scores are exact. Otherwise a matrix product only selects, with some slack, and scores are summed
    anew in one order for every pair, so that equal vectors get equal scores.
    """
    out = []
    if whole and len(x) and len(q):
        exact = float(np.abs(q).max()) * float(np.abs(x).max()) * x.shape[1] < 2**53
        x, q = (x, q) if exact else (x.astype(np.int64), q.astype(np.int64))
    step = max(1, SCORES // max(len(x), 1))
    reach = float(np.sqrt((x * x).sum(1).max())) if len(x) and not whole else 0.0
    for at in range(0, len(q), step):
        part = q[at : at + step]
        s = part @ x.T
        own = qids[at : at + step, None] == ids[None, :]
        low = np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf
        s[own] = low
        kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(part), low)
        if not whole:
            kth = kth - 1e-9 * reach * np.sqrt((part * part).sum(1))
        row, col = np.nonzero((s >= kth[:, None]) & ~own)
        score = s[row, col] if whole else np.einsum("ij,ij->i", part[row], x[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, np.arange(len(part)))
        keep = np.arange(len(row)) - first[row] < k
        out.append((row[keep] + at, col[keep], score[keep]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none.astype(float)
    return tuple(np.concatenate(c) for c in zip(*out))


def _block_scan(k: int, whole: bool):
    """Rows come sorted by (cell, part, side): a block's candidates first, then its queries, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, xs = None, [], []
        for batch in batches:
            cell, part, side = (batch.column(c).to_numpy() for c in ("cell", "part", "side"))
            if not len(cell):
                continue
            cut = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])])
            for b, e in zip(cut.tolist(), np.r_[cut[1:], len(cell)].tolist()):
                if block != (cell[b], part[b]):
                    block, ids, xs = (cell[b], part[b]), [], []
                own, v = batch.column("id").slice(b, e - b).to_numpy(), matrix(batch.column("v").slice(b, e - b))
                if not side[b]:
                    ids.append(own)
                    xs.append(v)
                elif ids:
                    if len(ids) > 1:
                        ids, xs = [np.concatenate(ids)], [np.concatenate(xs)]
                    row, col, score = best_of_block(ids[0], xs[0], own, v, k, whole)
                    h = batch.column("h").slice(b, e - b).to_numpy()
                    kind = pa.int64() if whole else pa.float64()
                    yield pa.record_batch([pa.array(own[row]), pa.array(h[row]), pa.array(ids[0][col]), pa.array(np.full(len(row), cell[b], np.int32)), pa.array(score.astype(np.int64 if whole else np.float64), kind)], ["query_id", "h", "vec_id", "cell", "score"])

    return run


def search(data: DataFrame, routed: DataFrame, sizes: dict[int, int], k: int, whole: bool) -> DataFrame:
    """(query_id, rank, vec_id, cell, score): the k best of the cells that each query is routed to.

    ``data`` (cell, id, v); ``routed`` (id, h, v, cells array<int>). A cell with more than ``BLOCK`` rows (``sizes``) is dealt over several parts,
    so no task holds a hot cell; its queries go to each of them.
    """
    parts = {c: -(-n // BLOCK) for c, n in sizes.items()}
    many = F.create_map(*[F.lit(x) for p in sorted(parts.items()) for x in p]) if parts else F.create_map(F.lit(0), F.lit(1))
    split = F.coalesce(many[F.col("cell")], F.lit(1))
    left = data.select("cell", F.pmod(F.xxhash64("id"), split).cast("int").alias("part"), F.lit(0).alias("side"), "id", F.lit(0).cast("long").alias("h"), "v")
    right = routed.select("id", "h", "v", F.explode("cells").alias("cell"))
    right = right.select("id", "h", "v", "cell", F.explode(F.sequence(F.lit(0), split - 1)).alias("part"))
    both = left.unionByName(right.withColumn("side", F.lit(1)))
    blocks = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "side", "id")
    found = blocks.mapInArrow(_block_scan(k, whole), f"query_id long, h long, vec_id long, cell int, score {'long' if whole else 'double'}")
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def own_counted(rows: DataFrame, condition: Column) -> DataFrame:
    """``queries_of`` with ``own``, the number of rows that have the query's id; only ids on several rows are joined."""
    repeated = rows.filter(condition).groupBy("id").agg(F.count("*").alias("own")).filter("own > 1")
    return queries_of(rows, condition).join(repeated, "id", "left").select("id", "h", "v", F.coalesce("own", F.lit(1)).alias("own"))


def queries_of(rows: DataFrame, condition: Column) -> DataFrame:
    """(id, h, v): the distinct query vectors; h tells different vectors of one id apart."""
    return rows.filter(condition).select("id", F.xxhash64("v").alias("h"), "v").dropDuplicates(["id", "h"])
