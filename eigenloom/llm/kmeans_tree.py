"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``FIT_ROWS``): every node's rows are clustered into ``BRANCH`` children until a node has ``LEAF`` sample
rows or fewer. Every row of the table is put into the leaf that it reaches by nearest centres. A query opens nodes from a priority queue, the
largest inner product with a centre first; the number of leaves it visits is calibrated: ``CALIBRATE`` rows are searched by brute force over the whole
table, their neighbours' leaves are looked up in the order in which the search opens leaves, and visits are widened until the mean recall reaches
``RECALL``; a query goes on until its leaves hold k rows besides those with its own id. Leaves with many rows are dealt over several blocks; a query's scores come from the original vectors.

Defined results: vectors null, empty, zero, with null or non-finite components, without an id, or of another than the commonest dimension take no part; ties go to the
smaller id; a candidate with the query's id is the query's own; repeated candidates are separate, repeated queries count once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, own_counted, sample, search, squares, usable

FIT_ROWS = 10_000
BRANCH = 8
LEAF = 200
CALIBRATE = 200
RECALL = 0.95


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the centre of each row; empty clusters are dropped."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        near = squares(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres = sums[count > 0] / count[count > 0, None]
    return centres, squares(x, centres).argmin(1)


@dataclass
class Tree:
    """``centres`` of all nodes but the root; ``children`` of the node at each place (the root comes last); ``leaf``: its number, or -1."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        work = [(len(self.children) - 1, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            kids = self.children[node]
            if not len(kids):
                out[rows] = self.leaf[node]
            elif len(rows):
                near = squares(x[rows], self.centres[kids]).argmin(1)
                work += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: np.ndarray | None = None) -> list[list[int]]:
        """The first ``most`` leaves that each query opens, and more until they hold its ``least`` rows by their ``sizes``."""
        out = []
        for worth, short in zip(q @ self.centres.T, [0] * len(q) if least is None else least.tolist()):
            seen: list[int] = []
            queue = [(0.0, len(self.children) - 1)]
            while queue and (len(seen) < most or short > 0):
                _, node = heapq.heappop(queue)
                while len(kids := self.children[node]):
                    ranked = kids[np.argsort(-worth[kids], kind="stable")]
                    for kid in ranked[1:].tolist():
                        heapq.heappush(queue, (-worth[kid], kid))
                    node = int(ranked[0])
                seen.append(int(self.leaf[node]))
                short -= sizes.get(seen[-1], 0) if sizes else 0
            out.append(seen)
        return out


def build(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF) -> Tree:
    centres, children, number = [], [], []

    def grow(rows: np.ndarray) -> tuple[np.ndarray, int]:
        if len(rows) <= leaf or (rows == rows[0]).all():
            return np.empty(0, int), 0
        middle, near = k_means(rows, branch)
        if len(middle) < 2:
            return np.empty(0, int), 0
        mine = []
        for i, c in enumerate(middle):
            kids, _ = grow(rows[near == i])
            mine.append(len(centres))
            centres.append(c)
            children.append(kids)
            number.append(len(kids))
        return np.array(mine), len(mine)

    kids, _ = grow(x)
    children.append(kids)
    number.append(len(kids))
    is_leaf = np.array(number) == 0
    return Tree(np.array(centres).reshape(len(centres), x.shape[1]), children, np.where(is_leaf, np.cumsum(is_leaf) - 1, -1))


def _leaves(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = tree.assign(matrix(batch.column("v")))
                yield pa.record_batch([pa.array(cell), batch.column("id"), batch.column("v")], ["cell", "id", "v"])

    return run


def _route(tree: Tree, most: int, sizes: dict[int, int] | None = None, k: int = 0):
    """With ``sizes`` the leaves of a query hold ``k`` rows besides its ``own``, if there are as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                least = k + batch.column("own").to_numpy() if sizes else None
                cells = pa.array(tree.visits(matrix(batch.column("v")), most, sizes, least), pa.list_(pa.int32()))
                yield pa.record_batch([*(batch.column(c) for c in ("id", "h", "v")), cells], ["id", "h", "v", "cells"])

    return run


_ROUTED = "id long, h long, v array<double>, cells array<int>"


def calibrate(tree: Tree, rows: DataFrame, data: DataFrame, sizes: dict[int, int], k: int, queries: int = CALIBRATE, recall: float = RECALL) -> int:
    """Leaves to visit for a mean recall of ``recall`` at k, measured on ``queries`` rows against brute force over all rows."""
    some = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(queries).select("id", F.xxhash64("v").alias("h"), "v")
    truth = search(data, some.mapInArrow(_route(tree, tree.leaves), _ROUTED), sizes, k, False).select("query_id", "h", "cell").collect()
    places = {}
    taken = some.toArrow()
    for i, h, order in zip(taken.column("id").to_pylist(), taken.column("h").to_pylist(), tree.visits(matrix(taken.column("v").combine_chunks()), tree.leaves)):
        places[i, h] = {leaf: n for n, leaf in enumerate(order)}
    depth = np.sort([places[r["query_id"], r["h"]][r["cell"]] for r in truth])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1 if len(depth) else tree.leaves


def near_neighbours(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = FIT_ROWS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every query; ``is_query`` is a condition on ``id``."""
    rows = usable(df, id_col, vec_col, nonzero=True)
    fit = sample(rows, fit_rows)
    if not len(fit):
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = build(fit)
    data = rows.mapInArrow(_leaves(tree), "cell int, id long, v array<double>")
    sizes = {r["cell"]: r["n"] for r in data.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    most = calibrate(tree, rows, data, sizes, k, recall=recall)
    routed = own_counted(rows, is_query).mapInArrow(_route(tree, most, sizes, k), _ROUTED)
    return search(data, routed, sizes, k, False).select("query_id", "rank", "vec_id", "score")
