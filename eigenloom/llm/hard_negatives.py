"""Hard negatives by inner product: an inverted multi-index, searched by multi-sequence heaps that stop on certified windows.

Vectors become floor(scale * x), so scores are whole numbers. Each half of a vector has a codebook (k-means on a bounded sample of ``FIT_ROWS``); a pair of codes
is a cell. Every row is put into its cell; identical rows are merged with their number before any shuffle, and the index is written once to the shared folder.
Its summary, at most ``CODES`` x ``CODES`` cells with size and both radii, is all the driver holds.

For an anchor q, ``q1.c1 + |q1| R1 + q2.c2 + |q2| R2`` bounds every score of a cell from above, the same with minus from below. A heap over the two sorted lists of half
bounds yields cells by their falling sum (multi-sequence). Two waves find the best rows of an anchor:

1. a probe opens cells until they hold ``PROBE`` rows; the k-th score found is certain to be reached;
2. the heap goes on until its bound falls below that score: no other cell can hold a better row. Fewer than k found: it goes on to the end (or to the window's low end).

This is done for the positives (rows of the anchor's label), then for the windows that their scores open for the negatives; a window is certified when
it has k rows no open cell can beat, or when the bound passes its low end; cells that lie above all windows are left out. Cells of one first code form a block,
whose cells are laid out over parts of about ``BLOCK`` rows, whole cells together, a larger cell over parts of its own; an anchor is sent once to each part in which it
opens a cell, with the set of its cells, and multiplied with those only. So its copies follow the rows that its bounds leave, not the table. Nothing is capped: an anchor whose bounds exclude nothing meets every row, in blocks.

Defined results: rows with a null id or label, a null or empty vector, a null or non-finite component, or of another than the commonest dimension (ties: the larger) take no part;
scaled components beyond ``LIMIT`` in size become it; rows with the anchor's id are neither its positives nor its negatives; repeated rows are separate candidates, repeated anchors
count once; ties go to the smaller id; an anchor without positives, or a window without negatives, gives no rows; an empty table gives an empty result. Columns other than those named are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .frames import stored
from .kmeans_tree import k_means
from .vectors import matrix, sample, squares

CODES = 32
FIT_ROWS = 10_000
PROBE = 2_048
BLOCK = 65_536
SCORES = 2_000_000
ANCHORS = 512
LIMIT = 2.0**26
LOWEST = np.iinfo(np.int64).min


def integers(df: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id long, label long, v array<double> of whole numbers): the rows that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").filter(F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))))
    found = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size("v") == (found[0]["d"] if found else 0))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * F.lit(scale), F.lit(LIMIT)), F.lit(-LIMIT))).cast("double"))
    return rows.select("id", "label", whole.alias("v"))


def codebook(half: np.ndarray, codes: int) -> np.ndarray:
    """At most ``codes`` centres; a half without dimensions has one."""
    return k_means(half, codes)[0] if half.shape[1] else np.zeros((1, 0))


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(i, j, a[i] + b[j]) by falling sum; the heap holds a frontier of at most len(a) pairs."""
    first, second = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(-(a[first[0]] + b[second[0]]), 0, 0)]
    while heap:
        bound, x, y = heapq.heappop(heap)
        yield first[x], second[y], -bound
        if y + 1 < len(second):
            heapq.heappush(heap, (-(a[first[x]] + b[second[y + 1]]), x, y + 1))
        if not y and x + 1 < len(first):
            heapq.heappush(heap, (-(a[first[x + 1]] + b[second[0]]), x + 1, 0))


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest whole n with low * s <= 100 * n <= high * s, without overflow."""
    whole, rest = scores // 100, scores % 100
    return low * whole - (-low * rest) // 100, high * whole + (high * rest) // 100


def layout(size: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first part, number of parts) of each cell; parts are numbered within a first code and hold about ``block`` rows."""
    first, many = np.zeros(size.shape, int), np.ones(size.shape, int)
    for i, row in enumerate(size.tolist()):
        part, held = 0, 0
        for j, n in enumerate(row):
            if held and held + n > block:
                part, held = part + 1, 0
            first[i, j], many[i, j] = part, max(1, -(-n // block))
            if n > block:
                part, held = part + many[i, j], 0
            else:
                held += n
    return first, many


@dataclass
class Cells:
    """Codebooks of both halves and each cell's rows and radii."""

    one: np.ndarray
    two: np.ndarray
    size: np.ndarray
    radius_one: np.ndarray
    radius_two: np.ndarray

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(code, code, distance, distance) of each row."""
        h = self.one.shape[1]
        d, e = squares(x[:, :h], self.one), squares(x[:, h:], self.two)
        i, j, at = d.argmin(1), e.argmin(1), np.arange(len(x))
        return i, j, np.sqrt(d[at, i]), np.sqrt(e[at, j])

    def bounds(self, q: np.ndarray):
        """Half bounds of all codes (with the code's radius), and lower and upper bounds of all cells (with the cell's radii)."""
        h = self.one.shape[1]
        mid_one, mid_two = q[:, :h] @ self.one.T, q[:, h:] @ self.two.T
        norm_one, norm_two = np.sqrt((q[:, :h] ** 2).sum(1)), np.sqrt((q[:, h:] ** 2).sum(1))
        far = np.sqrt(max((self.one**2).sum(1).max() + (self.two**2).sum(1).max(), 1.0)) + self.radius_one.max() + self.radius_two.max()
        slack = 1e-9 * ((norm_one + norm_two) * far + 1)
        a = mid_one + norm_one[:, None] * self.radius_one.max(1)[None, :] + slack[:, None]
        b = mid_two + norm_two[:, None] * self.radius_two.max(0)[None, :] + slack[:, None]
        middle = mid_one[:, :, None] + mid_two[:, None, :]
        reach = norm_one[:, None, None] * self.radius_one + norm_two[:, None, None] * self.radius_two + 2 * slack[:, None, None]
        return a, b, middle - reach, middle + reach

    def visits(self, a, b, lower, upper, probe: int, least: float | None, top: float) -> list[tuple[int, int]]:
        """Cells that an anchor opens: its probe, or with ``least`` all cells after it until the bound falls below ``least``. None lies wholly above ``top``."""
        out, held, size = [], 0, self.size
        for i, j, bound in multi_sequence(a, b):
            if least is not None and held >= probe and bound < least:
                break
            if not size[i, j] or lower[i, j] > top:
                continue
            if held < probe:
                held += int(size[i, j])
                if least is None:
                    out.append((i, j))
            elif least is None:
                break
            elif upper[i, j] >= least:
                out.append((i, j))
        return out


def _assign(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j, r, s = cells.codes(matrix(batch.column("v")))
                codes = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))]
                yield pa.record_batch([*codes, pa.array(r), pa.array(s), *(batch.column(c) for c in ("id", "label", "copies", "v"))], ["i", "j", "r", "s", "id", "label", "copies", "v"])

    return run


ROUTED = "i int, part int, m long, id long, h long, label long, v array<double>, ps array<long>"


def _route(cells: Cells, probe: int, block: int, low: int, high: int, more: bool):
    """Anchors with the cells they open, one row for each part that holds some: ``m`` has a bit for each second code.

    ``ps``: scores of the positives, null while those are searched. ``more``: the wave after the probe; ``w`` and ``t`` are the windows in which the
    probe found k rows, and the k-th score.
    """

    first, many = (a.tolist() for a in layout(cells.size, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                given = zip(batch.column("ps").to_pylist(), batch.column("w").to_pylist(), batch.column("t").to_pylist(), *cells.bounds(matrix(batch.column("v"))))
                row, one, mask = [], [], []  # one: (first code, part)
                for n, (ps, w, t, a, b, lower, upper) in enumerate(given):
                    least, top = -np.inf, np.inf
                    if ps is not None:
                        least, top = (c.astype(np.float64) for c in windows(np.array(ps, np.int64), low, high))
                        open_ = least <= top
                        if not open_.any():
                            continue
                        top = top[open_].max()
                    if more:
                        if w:
                            least = np.array(least, ndmin=1)
                            least[w] = t
                        least = float(np.min(least if ps is None else least[open_]))
                    sets: dict[tuple[int, int], int] = {}
                    for i, j in cells.visits(a, b, lower, upper, probe, least if more else None, top):
                        for part in range(first[i][j], first[i][j] + many[i][j]):
                            sets[i, part] = sets.get((i, part), 0) | 1 << j
                    row += [n] * len(sets)
                    one += sets
                    mask += sets.values()
                taken = batch.take(pa.array(row, pa.int64()))
                places = [pa.array([p[n] for p in one], pa.int32()) for n in (0, 1)]
                yield pa.record_batch([*places, pa.array(mask, pa.int64()), *(taken.column(c) for c in ("id", "h", "label", "v", "ps"))], ["i", "part", "m", "id", "h", "label", "v", "ps"])

    return run


def _best(s: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate): the k largest scores of each row among those that fit, ties to smaller ids."""
    low = LOWEST if s.dtype == np.int64 else -np.inf
    s = np.where(fits, s, low)
    kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), low, s.dtype)
    row, col = np.nonzero(fits & (s >= kth[:, None]))
    order = np.lexsort((ids[col], -s[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(s)))[row] < k
    return row[keep], col[keep]


class _Block:
    """The rows of one part of a block, cell by cell."""

    def __init__(self):
        self.parts: list[pa.RecordBatch] = []
        self.codes = None

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def ready(self) -> None:
        if self.codes is None:
            table = pa.Table.from_batches(self.parts).combine_chunks()
            self.codes, self.ids, self.copies, self.labels = (table.column(c).to_numpy() for c in ("m", "id", "h", "label"))
            self.x = matrix(table.column("v").combine_chunks())
            self.cut = np.flatnonzero(np.r_[True, self.codes[1:] != self.codes[:-1], True])
            self.size = float(np.abs(self.x).max())
            self.parts = []

    def search(self, rows: pa.RecordBatch, k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        """The k best of this part for each anchor and window, over all the cells that it opens."""
        self.ready()
        for at in range(0, rows.num_rows, ANCHORS):
            some = rows.slice(at, ANCHORS)
            found = list(self._cells(some, k, low, high))
            if not found:
                continue
            row, w, col, score = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((self.ids[col], -score, w, row))
            row, w, col, score = row[order], w[order], col[order], score[order]
            group = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (w[1:] != w[:-1])])
            keep = np.arange(len(row)) - np.repeat(group, np.diff(np.r_[group, len(row)])) < k
            row, w, col, score = row[keep], w[keep], col[keep], score[keep]
            ids, hs = (some.column(c).to_numpy() for c in ("id", "h"))
            yield pa.record_batch([pa.array(ids[row]), pa.array(hs[row]), pa.array(w), pa.array(self.ids[col]), pa.array(score), pa.array(self.copies[col])], ["id", "h", "w", "vec_id", "score", "copies"])

    def _cells(self, rows: pa.RecordBatch, k: int, low: int, high: int):
        """(anchor, window, row, score): the k best of each cell."""
        masks, ids, labels = (rows.column(c).to_numpy() for c in ("m", "id", "label"))
        q, x = matrix(rows.column("v")), self.x
        if self.size * float(np.abs(q).max()) * q.shape[1] >= 2**53:
            q, x = q.astype(np.int64), x.astype(np.int64)
        given = rows.column("ps").to_pylist()
        width = max(len(p) for p in given if p is not None) if given[0] is not None else 0
        ps = np.array([p + [-1] * (width - len(p)) for p in given], np.int64).reshape(len(given), width) if width else None
        for b, e in zip(self.cut[:-1].tolist(), self.cut[1:].tolist()):
            wanted = np.flatnonzero(masks >> int(self.codes[b]) & 1)
            for some in np.array_split(wanted, max(1, -(-len(wanted) * (e - b) // SCORES))):
                if not len(some):
                    continue
                s = q[some] @ x[b:e].T
                same = labels[some][:, None] == self.labels[b:e][None, :]
                other = ids[some][:, None] != self.ids[b:e][None, :]
                if ps is None:
                    tries = [(0, same & other)]
                else:
                    least, most = windows(ps[some], low, high)
                    tries = [(w, ~same & other & (s >= least[:, w : w + 1]) & (s <= most[:, w : w + 1]) & (ps[some, w] >= 0)[:, None]) for w in range(width)]
                for w, fits in tries:
                    row, col = _best(s, fits, self.ids[b:e], k)
                    if len(row):
                        yield some[row], np.full(len(row), w, np.int32), col + b, s[row, col].astype(np.int64)


def _scan(k: int, low: int, high: int):
    """Rows come sorted by (i, part, side, m): a part's rows first, then its anchors, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            i, part, side = (batch.column(c).to_numpy() for c in ("i", "part", "side"))
            cut = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])])
            for b, e in zip(cut.tolist(), np.r_[cut[1:], len(i)].tolist()):
                if key != (i[b], part[b]):
                    key, block = (i[b], part[b]), _Block()
                if not side[b]:
                    block.add(batch.slice(b, e - b))
                elif block.parts or block.codes is not None:
                    yield from block.search(batch.slice(b, e - b), k, low, high)

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, ``rank`` from 1; merged rows count as often as they occur."""
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int")))).withColumn("copies", F.lit(1).cast("long"))
    order = Window.partitionBy("id", "h", "w").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "h", "w", "vec_id", "score", "copies", "rank")


@dataclass
class MultiIndex:
    """The stored rows with their cells, and the cells' summary."""

    rows: DataFrame
    cells: Cells

    def search(self, routed: DataFrame, k: int, low: int, high: int) -> DataFrame:
        """(id, h, w, vec_id, score, copies) of the cells that anchors are routed to."""
        first, many = layout(self.cells.size, BLOCK)
        cell, none = F.col("i") * F.lit(first.shape[1]) + F.col("j"), F.lit(None).cast("array<long>")
        at, split = (F.array(*[F.lit(n) for n in a.ravel().tolist()])[cell] for a in (first, many))
        part = (at + F.pmod(F.xxhash64("id", "v"), split)).cast("int")
        left = self.rows.select("i", part.alias("part"), F.lit(0).alias("side"), F.col("j").cast("long").alias("m"), "id", F.col("copies").alias("h"), "label", "v", none.alias("ps"))
        right = routed.select("i", "part", F.lit(1).alias("side"), "m", "id", "h", "label", "v", "ps")
        both = left.unionByName(right).repartition("i", "part").sortWithinPartitions("i", "part", "side", "m", "id")
        return both.mapInArrow(_scan(k, low, high), "id long, h long, w int, vec_id long, score long, copies long")

    def nearest(self, anchors: DataFrame, k: int, low: int = 0, high: int = 0, probe: int = PROBE) -> DataFrame:
        """The k best rows of each anchor (``ps`` null: of its label; else of other labels, in each window), certified in two waves; stored."""

        def wave(asked: DataFrame, more: bool) -> DataFrame:
            return self.search(asked.mapInArrow(_route(self.cells, probe, BLOCK, low, high, more), ROUTED), k, low, high)

        nothing = anchors.withColumn("w", F.lit(None).cast("array<int>")).withColumn("t", F.lit(None).cast("array<long>"))
        first = stored(best(wave(nothing, False), k))
        full = first.groupBy("id", "h", "w").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k)
        full = full.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("w", "s"))).alias("f"))
        asked = anchors.join(full, ["id", "h"], "left").select("id", "h", "label", "v", "ps", F.col("f.w").alias("w"), F.col("f.s").alias("t"))
        return stored(best(first.drop("rank").unionByName(wave(asked, True)), k))


def build(rows: DataFrame, codes: int = CODES) -> MultiIndex | None:
    """Codebooks from a sample, every row in its cell, written once; None if there are no rows."""
    spark = rows.sparkSession
    fit = sample(rows, FIT_ROWS)
    if not len(fit):
        return None
    half = fit.shape[1] // 2 or 1
    one, two = codebook(fit[:, :half], codes), codebook(fit[:, half:], codes)
    none = np.zeros((len(one), len(two)))
    cells = Cells(one, two, none.astype(np.int64), none, none)
    merged = rows.groupBy("id", "label", "v").agg(F.count("*").alias("copies"))
    path = scratch_path(spark, "multi-index")
    merged.mapInArrow(_assign(cells), "i int, j int, r double, s double, id long, label long, copies long, v array<double>").write.parquet(path)
    table = spark.read.parquet(path)
    size, radius_one, radius_two = none.astype(np.int64), none.copy(), none.copy()
    for c in table.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("s").alias("s")).collect():
        at = c["i"], c["j"]
        size[at], radius_one[at], radius_two[at] = c["n"], c["r"], c["s"]
    return MultiIndex(table.drop("r", "s"), Cells(one, two, size, radius_one, radius_two))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", codes: int = CODES, probe: int = PROBE) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of the same label: the best ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``. ``is_anchor`` is a condition on ``id``; ``codes``: at most 63."""
    index = build(integers(df, scale, id_col, vec_col, label_col), codes)
    if index is None:
        return df.sparkSession.createDataFrame([], RESULT)
    anchors = index.rows.filter(is_anchor).select("id", F.xxhash64("label", "v").alias("h"), "label", "v")
    near = index.nearest(anchors.withColumn("ps", F.lit(None).cast("array<long>")), positives, probe=probe)
    scores = near.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    far = index.nearest(anchors.join(scores, ["id", "h"]).select("id", "h", "label", "v", F.col("p.score").alias("ps")), negatives, low, high, probe)
    chosen = near.select("id", "h", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(chosen, ["id", "h", "w"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
