"""Best-fit packing of documents into sequences of fixed capacity: linear grouping.

Only the histogram of lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver. There

1. lengths above a share of the capacity are sorted and cut into ``GROUPS`` groups of equal cardinality, each rounded up to its largest;
2. the few rounded sizes give a cutting-stock linear program over configurations, solved by column generation (a knapsack over the
   capacity finds each new configuration) and rounded down;
3. every configuration slot takes actual lengths of its group;
4. what the rounding left over, and the small lengths, go best-fit into the free space, largest first, then into new sequences.

Which lengths count as large decides how much is left to fill the gaps: the plan is made for each share in ``LARGE`` and the one with the fewest sequences is kept.

The plan is a list of runs of equal sequences. Documents take their places by their rank among those of equal length, which
is counted in hashed buckets, so that a length that a third of all documents share is ranked by many tasks.

Defined results: a length of 0 takes no room, a null or negative length or one beyond the capacity is an error; a null text has only its end id;
a null id is kept; repeated rows are packed one by one; an empty table gives an empty result. A text of any length is cut into full pieces.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .frames import fresh, stored, without
from .tokens import encoder

CAPACITY = 4096
#: Lengths above this share of the capacity are grouped and configured; smaller ones fill the gaps.
LARGE = (1 / 8, 1 / 4, 1 / 2)
GROUPS = 32
#: Configurations that the linear program may add; the plan is whole without its optimum, and a warning says so.
ROUNDS = 2000


def _knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits, and how many of each size."""
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(capacity // min(sizes)):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for j, s in enumerate(sizes):
            value = best[: capacity + 1 - s] + worth[j]
            better = value > new[s:] + 1e-12
            new[s:][better], pick[s:][better] = value[better], j
        if (pick < 0).all():
            break
        picks.append(pick)
        best = new
    count, room = np.zeros(len(sizes), int), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            count[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), count


def configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(sizes in it, how many sequences) of a rounded-down solution of the cutting-stock program."""
    base = np.diag([capacity // s for s in sizes]).astype(float)
    amount = demand / np.diag(base)
    for _ in range(ROUNDS):
        price = np.linalg.solve(base.T, np.ones(len(sizes)))
        value, column = _knapsack(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(base, column.astype(float))
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        base[:, out] = column
    else:
        warnings.warn(f"the packing plan stopped after {ROUNDS} configurations, short of the optimum of its linear program")
    return [(base[:, i].round().astype(int), int(amount[i] + 1e-6)) for i in range(len(sizes)) if amount[i] + 1e-6 >= 1]


class _Sequences:
    """Runs of equal sequences, found by their free space."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.done: list[tuple[int, int, tuple]] = []
        self.open: list[list[tuple[int, int, tuple]]] = [[] for _ in range(capacity + 1)]
        self.there = np.zeros(capacity + 1, bool)

    def put(self, first: int, count: int, holds: tuple, free: int) -> None:
        if free:
            self.open[free].append((first, count, holds))
            self.there[free] = True
        else:
            self.done.append((first, count, holds))

    def add(self, count: int, lengths: list[int]) -> None:
        at, holds = 0, []
        for n in lengths:
            holds.append((n, at))
            at += n
        self.put(self.made, count, tuple(holds), self.capacity - at)
        self.made += count

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = int(np.argmax(self.there[length:])) + length
            if not self.there[at]:
                each = self.capacity // length
                if count >= each:
                    self.add(count // each, [length] * each)
                if count % each:
                    self.add(1, [length] * (count % each))
                return
            first, have, holds = self.open[at].pop()
            n = min(have, count)
            if n < have:
                self.open[at].append((first + n, have - n, holds))
            self.there[at] = bool(self.open[at])
            self.put(first, n, (*holds, (length, self.capacity - at)), at - length)
            count -= n

    def runs(self) -> list[tuple[int, int, tuple]]:
        return self.done + [r for x in self.open for r in x]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, tuple]]:
    """Runs (first sequence, how many, ((length, offset), ...)) that hold every length as often as the histogram says."""
    return min((grouped_plan(histogram, capacity, share) for share in LARGE), key=lambda runs: sum(c for _, c, _ in runs))


def grouped_plan(histogram: dict[int, int], capacity: int, small: float) -> list[tuple[int, int, tuple]]:
    """The plan with lengths above ``small`` of the capacity as the large ones."""
    out = _Sequences(capacity)
    left: dict[int, int] = {}
    large = sorted((n for n in histogram if n > small * capacity), reverse=True)
    total = sum(histogram[n] for n in large)
    if total:
        groups: list[list[list[int]]] = []
        each, room = -(-total // GROUPS), 0
        for n in large:
            c = histogram[n]
            while c:
                if not room:
                    groups.append([])
                    room = each
                m = min(c, room)
                groups[-1].append([n, m])
                c, room = c - m, room - m
        merged: list[list[list[int]]] = []
        for g in groups:  # groups that round up to one size are one
            if merged and merged[-1][0][0] == g[0][0]:
                merged[-1] += g
            else:
                merged.append(g)
        sizes = [g[0][0] for g in merged]
        demand = np.array([sum(m for _, m in g) for g in merged], float)
        queues = [g[::-1] for g in merged]
        for column, many in configurations(sizes, demand, capacity):
            used = np.flatnonzero(column)
            while many:
                n = many
                for j in used:
                    n = min(n, max(1, queues[j][-1][1] // int(column[j])))
                lengths = []
                for j in used:
                    for _ in range(int(column[j])):
                        head = queues[j][-1]
                        lengths.append(head[0])
                        head[1] -= n
                        if not head[1]:
                            queues[j].pop()
                out.add(n, lengths)
                many -= n
        for q in queues:
            for n, m in q:
                left[n] = left.get(n, 0) + m
    for n in histogram:
        if 0 < n <= small * capacity:
            left[n] = histogram[n]
    for n in sorted(left, reverse=True):
        out.best_fit(n, left[n])
    return out.runs()


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``, in place of columns of these names. The rows should be stored: they are read more than once."""
    pieces = without(pieces, "sequence_id", "offset")
    names = pieces.columns
    bucket, rank, before, n_col = (fresh(pieces, c) for c in ("__bucket", "__rank", "__before", "__n"))
    buckets = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    whole = [F.col(f"`{c}`") for c in names]
    rows = pieces.withColumns({bucket: F.pmod(F.xxhash64(*whole), F.lit(buckets)), n_col: F.col(f"`{length_col}`").cast("long")})
    counts = rows.groupBy(n_col, bucket).agg(F.count("*").alias("c"))
    histogram = {r[0]: r[1] for r in counts.groupBy(n_col).agg(F.sum("c")).limit(capacity + 3).collect()}
    if any(n is None or not 0 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must lie between 0 and {capacity}")
    table: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = {}
    for first, count, holds in plan(histogram, capacity):
        for n, at in holds:
            table.append((n, used.get(n, 0), first, at))
            used[n] = used.get(n, 0) + count
    if 0 in histogram:
        table.append((0, 0, 0, 0))
    table.sort()
    lengths, ranks, firsts, offsets = (np.array(x, np.int64) for x in zip(*table)) if table else [np.empty(0, np.int64)] * 4
    span = np.int64(max([1, *histogram.values()]))
    sent = pieces.sparkSession.sparkContext.broadcast((lengths * span + ranks, ranks, firsts, offsets))
    so_far = Window.partitionBy(n_col).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select(n_col, bucket, F.coalesce(F.sum("c").over(so_far), F.lit(0)).alias(before))
    order = Window.partitionBy(n_col, bucket).orderBy(*whole)
    ranked = rows.withColumn(rank, F.row_number().over(order) - 1).join(earlier, [n_col, bucket])
    ranked = ranked.select(*whole, n_col, (F.col(rank) + F.col(before)).alias(rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, first, offset = sent.value
        for batch in batches:
            n, r = batch.column(n_col).to_numpy(), batch.column(rank).to_numpy()
            at = np.searchsorted(keys, n * span + np.where(n > 0, r, 0), "right") - 1
            seq = first[at] + np.where(n > 0, r - starts[at], 0)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(seq), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{ddl}, sequence_id long, offset long")


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and end id; only longer documents are cut. ``added``: see ``Encoder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path, False, added), np.uint32(end_id).astype("<u4").tobytes()
        for part, _, _ in X.slices(batches, "t", X.FEW_BYTES):
            rows = []
            for k, ids in zip(part.column("doc_id").to_pylist(), enc.encode([t or "" for t in part.column("t").to_pylist()])):
                ids += end
                for i in range(0, len(ids), 4 * capacity):
                    one = ids[i : i + 4 * capacity]
                    rows.append((k, i // (4 * capacity), i // 4, len(one) // 4, zlib.crc32(one)))
            cols = zip(*rows)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """One row per piece with its sequence and place there."""
    return pack(stored(token_pieces(df, tokenizer_path, id_col, text_col, end_id, capacity, added)), "length", capacity)
