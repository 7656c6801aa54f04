"""Exact top-k by inner product: a Voronoi kNN join.

Data and queries are grouped by their nearest of ``PIVOTS`` pivots (a bounded sample). A group is summarised by its size and radius R.
For a query q and a group with pivot p every score lies within q.p - |q| R and q.p + |q| R; so the sizes of groups with large lower
bounds give a score that k candidates reach for certain (rows with the query's own id are counted beforehand and come on top of k), and only groups whose upper bound reaches it are needed. Queries are copied to the
needed groups (they are fewer than the data), each group is solved locally in bounded blocks, and the blocks' results are merged.

Components become floor(scale * x), scores are whole numbers without rounding. Defined results: vectors null, empty, or with null or
non-finite components, without an id, or of another than the commonest dimension take no part; a candidate with the query's id counts as the query's own; ties go to
the smaller id; repeated candidate rows are separate candidates; repeated query rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, own_counted, sample, search, squares, usable

PIVOTS = 64


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squares(matrix(batch.column("v")), pivots) if batch.num_rows else np.zeros((0, 1))
            cell = d.argmin(1)
            radius = np.sqrt(d[np.arange(len(d)), cell])
            yield pa.record_batch([pa.array(cell.astype(np.int32)), batch.column("id"), batch.column("v"), pa.array(radius)], ["cell", "id", "v", "r"])

    return run


def needed(q: np.ndarray, pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
    """Which groups each query needs, from the groups' summaries; ``own`` rows more are asked for, as those with the query's id may be among them."""
    norm = np.sqrt((q * q).sum(1))[:, None]
    middle, slack = q @ pivots.T, norm * radii[None, :]
    slack = slack + 1e-9 * (norm * (np.sqrt((pivots * pivots).sum(1)) + radii)[None, :] + 1)
    low, high = middle - slack, middle + slack
    low = np.where(sizes > 0, low, -np.inf)
    order = np.argsort(-low, axis=1)
    reached = np.cumsum(sizes[order], axis=1) >= k + own[:, None]
    at = np.where(reached.any(1), reached.argmax(1), len(sizes) - 1)
    rows = np.arange(len(q))
    sure = np.where(reached.any(1), low[rows, order[rows, at]], -np.inf)
    return (high >= sure[:, None]) & (sizes > 0)


def exact_top_k(df: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query; ``is_query`` is a condition on ``id``."""
    rows = usable(df, id_col, vec_col).select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v"))
    centres = np.unique(sample(rows, pivots), axis=0)
    spark = df.sparkSession
    if not len(centres):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data = rows.mapInArrow(_assign(centres), "cell int, id long, v array<double>, r double")
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for s in summary:
        sizes[s["cell"]], radii[s["cell"]] = s["n"], s["r"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                wanted = needed(matrix(batch.column("v")), centres, sizes, radii, k, batch.column("own").to_numpy())
                row, cell = np.nonzero(wanted)
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(cut), pa.array(cell.astype(np.int32)))
                yield pa.record_batch([*(batch.column(c) for c in ("id", "h", "v")), cells], ["id", "h", "v", "cells"])

    routed = own_counted(rows, is_query).mapInArrow(route, "id long, h long, v array<double>, cells array<int>")
    found = search(data.drop("r"), routed, {int(s["cell"]): int(s["n"]) for s in summary}, k, True)
    return found.select("query_id", "rank", "vec_id", "score")
