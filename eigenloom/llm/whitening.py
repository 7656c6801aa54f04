"""PCA whitening of integer vectors: Chebyshev-filtered subspace iteration.

Every entry c becomes x = floor(scale * c). The fit list holds each distinct x once (one partial aggregate, so a vector that a third of the rows share
costs one record a task); it is written once, packed into blocks of rows of the narrowest integer type, to the shared folder. All later work on it
are narrow scans of those blocks:

1. n and the sums S, exact.
2. Passes ``V Q = (X - S/n)' (X - S/n) Q / n``, centred inside the tasks before multiplying; a task sends d rows of ``block`` numbers, which the JVM adds up.
3. Rayleigh-Ritz on the block of ``keep + GUARD`` directions gives values, vectors and residuals. While the residuals are too large, a Chebyshev polynomial of
   degree ``DEGREE`` in V, by its three-term recurrence (a pass a degree), damps the spectrum between 0 and the smallest Ritz value and magnifies what
   lies above it; QR makes the result a basis again. A block as wide as the vectors needs no filter.
4. Certified: every kept residual ``|V u - e u|`` is at most ``TOLERANCE`` times the largest value, or has stopped falling below a thousand times that; no more
   than ``CYCLES`` rounds, then an error, never an uncertified answer.
5. One more pass gives the covariance of the whitened fit list; the source table is scored by a map-only scan.

The driver holds d x (keep + GUARD) numbers, whatever the number of rows. A lost executor costs its tasks: blocks are in the shared folder.

Defined results: vectors that are null, empty, hold null or non-finite entries, or are not of the commonest dimension (ties: the larger) take no part; a null id stays
null; repeated rows are all returned and count once in the fit list; scaled entries beyond ``LIMIT`` in size become it; directions whose variance is below
``FLAT`` of the total are no components, so fewer than ``keep`` are returned (none if all vectors are equal); a deviation above the largest long is null;
an empty table gives an empty result. Equal eigenvalues have any orthonormal basis. Columns other than the two named ones are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .vectors import matrix

KEEP = 4
GUARD = 28
DEGREE = 8
CYCLES = 100
TOLERANCE = 1e-14
FLAT = 1e-11
LIMIT = 2.0**40
BLOCK_ROWS = 4096


def integers(df: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id long, x array<long>): the rows that take part, scaled and floored."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter("size(v) > 0")
    rows = rows.filter(F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))))
    found = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size("v") == (found[0]["d"] if found else 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(F.greatest(F.least(c * F.lit(scale), F.lit(LIMIT)), F.lit(-LIMIT)))).alias("x"))


def _narrow(x: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if len(x) and np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as blocks of raw integers; ``size`` is the bytes of one."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.column("x").slice(at, BLOCK_ROWS)
            x = _narrow(part.flatten().to_numpy(zero_copy_only=False))
            yield pa.record_batch([pa.array([len(part)], pa.int32()), pa.array([x.itemsize], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["n", "size", "x"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    kinds = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}
    for batch in batches:
        for n, size, x in zip(*(batch.column(c) for c in ("n", "size", "x"))):
            yield np.frombuffer(x.as_buffer(), kinds[size.as_py()]).reshape(n.as_py(), -1)


@dataclass
class FitList:
    """The distinct vectors as stored blocks, with their number and exact sums."""

    blocks: DataFrame
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def summed(self, task, width: int) -> np.ndarray:
        """The sum over all tasks of the matrix that ``task`` makes of its blocks; ``width`` columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for x in _blocks(batches):
                part = task(x)
                total = part if total is None else total + part
            if total is not None:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(total).ravel()))
                yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), lists], ["i", "p"])

        partial = self.blocks.mapInArrow(run, "i int, p array<double>")
        rows = partial.groupBy("i").agg(F.array(*[F.sum(F.col("p")[j]) for j in range(width)]).alias("p")).collect()
        return np.array([r["p"] for r in sorted(rows, key=lambda r: r["i"])])

    def product(self, q: np.ndarray) -> np.ndarray:
        """V Q: one distributed pass."""
        mean = self.mean

        def task(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return self.summed(task, q.shape[1]) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(self.summed(lambda x: ((x - mean) ** 2).sum(0)[:, None], 1).sum()) / self.n

    def covariance_of(self, project: np.ndarray) -> np.ndarray:
        """The covariance of the centred vectors projected on the columns of ``project``; the projections are centred anew before multiplying."""
        mean, k = self.mean, project.shape[1]
        middle = self.summed(lambda x: ((x - mean) @ project).sum(0)[:, None], 1)[:, 0] / self.n

        def task(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ project - middle
            return w.T @ w

        return self.summed(task, k) / self.n


def fit_list(rows: DataFrame) -> FitList | None:
    """Each distinct ``x`` once, stored; None if there are no rows."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "whitening")
    packed = rows.select("x").distinct().mapInArrow(_pack, "n int, size int, x binary")
    packed.write.parquet(path)
    blocks = spark.read.parquet(path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches):
            s = x.sum(0, dtype=np.int64)
            yield pa.record_batch([pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s), pa.array(np.full(len(s), len(x), np.int64))], ["i", "s", "n"])

    partial = blocks.mapInArrow(sums, "i int, s long, n long")
    total = sorted(partial.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect(), key=lambda r: r["i"])
    return FitList(blocks, total[0]["n"], [int(r["s"]) for r in total]) if total else None


def chebyshev(product, q: np.ndarray, vq: np.ndarray, low: float, high: float, degree: int) -> np.ndarray:
    """p(V) q for the Chebyshev polynomial p of ``degree`` that is small on [0, ``low``], scaled by its size at ``high``."""
    half = low / 2
    first = sigma = half / (high - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * (after / half) * (product(now) - half * now) - sigma * after * before
        sigma = after
    return now


@dataclass
class Subspace:
    """Unit eigenvectors (columns), their values and residuals, and how many passes it took."""

    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    passes: int


def leading(product, d: int, keep: int = KEEP, guard: int = GUARD, degree: int = DEGREE, seed: int = 7) -> Subspace:
    """The ``keep`` leading eigenpairs of the symmetric, non-negative operator ``product`` on d dimensions."""
    width, passes = min(d, keep + guard), 0

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(q)

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    last = np.inf
    for _ in range(CYCLES):
        vq = counted(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.sqrt(((vq - q * values) ** 2).sum(0))[:keep]
        worst, top = float(residuals.max()), max(float(values[0]), 0.0)
        if width == d or worst <= TOLERANCE * top or (worst > last / 2 and worst <= 1000 * TOLERANCE * top):
            return Subspace(q[:, :keep], np.maximum(values[:keep], 0), residuals, passes)
        last = worst
        q = np.linalg.qr(chebyshev(counted, q, vq, max(float(values[-1]), 1e-8 * top), top, degree))[0]
    raise ArithmeticError(f"the eigenvectors are not certified after {passes} passes: residual {worst:.3g} at a largest value of {top:.3g}")


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, keep: int = KEEP, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each row that takes part and each of at most ``keep`` components; see the module for the columns."""
    rows = integers(df, scale, id_col, vec_col)
    fit = fit_list(rows)
    trace = fit.trace() if fit else 0.0
    if not trace > 0:
        return df.sparkSession.createDataFrame([], RESULT)
    d = len(fit.sums)
    found = leading(fit.product, d, min(keep, d))
    kept = found.values > FLAT * trace
    vectors, values = found.vectors[:, kept], found.values[kept]
    project = vectors / np.sqrt(values)
    error = float(np.abs(fit.covariance_of(project) - np.eye(len(values))).max())
    n, sums, mean, explained, k = fit.n, fit.sums, fit.mean, values / trace, len(values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(abs(s) for s in sums)
        exact = np.array(sums, dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x")).astype(np.int64)
            if (n * int(np.abs(x).max()) + most) ** 2 * d < 2**63:
                off = n * x - exact.astype(np.int64)
                deviation = (off * off).sum(1).tolist()
            else:
                deviation = [v if v < 2**63 else None for v in ((n * x.astype(object) - exact) ** 2).sum(1).tolist()]
            w = (x - mean) @ project
            rep = len(x)
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rep), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rep)),
                    pa.array(np.full(rep * k, n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rep), k))),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, rep)),
                    pa.array(np.full(rep * k, error)),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return rows.mapInArrow(score, RESULT)
