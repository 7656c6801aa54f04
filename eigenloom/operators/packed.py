"""Gram sums that travel packed: a row ``(node, i, row)`` is a whole line of the upper triangle of one node.

``i >= 0``: ``[s_i, g_ii, g_i(i+1), ...]``; ``i = -1``: ``[n]``; ``i = -2``: the shift, if it was measured here; node -1 counts malformed rows.
Rows with the same ``(node, i)`` add up, so sums of any tasks may be merged at any place and handed on at any time: the exchange carries
``K + 1`` records for each task and node instead of ``K (K + 3) / 2 + 1`` cells.

Sums are added as a tree of two levels. ``summed`` deals the rows of all tasks over ``(node, i, task mod FAN)`` and adds each group line by line; whoever reads a node
(``nodes``) adds the ``FAN`` rows that are left of each line. So no task reads what all tasks send, whatever the node's share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 8
SENT_VALUES = 1 << 20  # numbers in one Arrow batch
HELD_VALUES = 1 << 24  # numbers that a merging task holds (128 MB); beyond it hands its sums on and starts anew
SCHEMA = "node int, i int, row array<double>"
_ARROW = pa.schema([("node", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])


def batches(rows) -> Iterator[pa.RecordBatch]:
    """``(node, i, values)`` as Arrow batches of bounded size."""
    held, values = [], 0
    for row in rows:
        held.append(row)
        values += len(row[2])
        if values > SENT_VALUES:
            yield _batch(held)
            held, values = [], 0
    if held:
        yield _batch(held)


def _batch(rows) -> pa.RecordBatch:
    node, i, values = zip(*rows)
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.asarray(v, dtype=np.float64) for v in values])))
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(i, pa.int32()), lists], schema=_ARROW)


def lines(node: int, n: float, s: np.ndarray, gram: np.ndarray):
    """The rows of one node's sums."""
    yield node, -1, [float(n)]
    for i in range(len(s)):
        yield node, i, np.concatenate([s[i : i + 1], gram[i, i:]])


def read(it: Iterator[pa.RecordBatch]):
    """Yield ``(node, i, values)``; the values are a view of the batch."""
    for batch in it:
        rows = batch["row"]
        flat, ends = rows.flatten().to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
        ends = (ends - ends[0]).tolist()
        for r, (node, i) in enumerate(zip(batch["node"].to_pylist(), batch["i"].to_pylist())):
            yield node, i, flat[ends[r] : ends[r + 1]]


def summed(partial: DataFrame) -> DataFrame:
    """The first level of the tree: one exchange of packed rows, added line by line."""

    def merge(it):
        state, values = {}, 0
        for node, i, row in read(it):
            line = state.get((node, i))
            if line is None:
                state[node, i] = row.copy()
                values += len(row)
                if values > HELD_VALUES:
                    yield from batches((*key, line) for key, line in state.items())
                    state, values = {}, 0
            else:
                line += row
        yield from batches((*key, line) for key, line in state.items())

    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    return salted.repartition("node", "i", "salt").select("node", "i", "row").mapInArrow(merge, SCHEMA)


def nodes(it: Iterator[pa.RecordBatch]):
    """The second level: yield ``(node, n, s, gram, shift)`` from rows that come sorted by node."""
    now = None
    for node, i, row in read(it):
        if now is None or now[0] != node:
            if now:
                yield _whole(now)
            now = [node, 0.0, None, None, None]
        if i == -1:
            now[1] += float(row[0])
        elif i == -2:
            now[4] = row.copy()
        else:
            if now[2] is None:
                k = len(row) + i - 1
                now[2], now[3] = np.zeros(k), np.zeros((k, k))
            now[2][i] += row[0]
            now[3][i, i:] += row[1:]
    if now:
        yield _whole(now)


def _whole(now):
    node, n, s, gram, shift = now
    if s is None:
        s, gram = np.zeros(0), np.zeros((0, 0))
    gram += np.triu(gram, 1).T
    return node, n, s, gram, np.zeros(len(s)) if shift is None else shift


def by_node(stats: DataFrame) -> DataFrame:
    """The rows of each node together, as ``nodes`` reads them; a task holds one node at a time."""
    return stats.repartition("node").sortWithinPartitions("node")


def cells(stats: DataFrame) -> DataFrame:
    """``(node, i, j, s)``: one row per sum; ``j = -1`` is the sum of feature i, ``i = -1`` the count."""
    long = stats.filter("i > -2").select("node", "i", F.posexplode("row").alias("p", "s"))
    j = F.when((F.col("p") == 0) | (F.col("i") < 0), -1).otherwise(F.col("i") + F.col("p") - 1)
    return long.groupBy("node", "i", j.cast("int").alias("j")).agg(F.sum("s").alias("s"))
