"""Hard negatives against all pairs in numpy."""

import heapq

import numpy as np
import pytest
from eigenloom.llm import hard_negatives as N
from eigenloom.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, positives=5, negatives=5, move=True):
    """All pairs, whole numbers; ``rows`` (id, vector, label)."""
    data = []
    for i, v, label in rows:
        x = [int(np.floor(256 * float(c))) for c in np.asarray(v, dtype=np.float32)]
        data.append((i, x, (label + 1) % 10 if move and i % 7 == 0 else label))
    out = []
    for a, x, label in data:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, y, other in data if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s]
            out += [(a, p, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fits[:negatives])]
    return sorted(out)


def clustered(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((12, d))
    return [(i, (middle[rng.integers(12)] + spread * rng.standard_normal(d)).astype(np.float32).tolist(), int(rng.integers(10))) for i in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_query(spark, tmp_path):
    rows = clustered(900, 12, 1)
    odd = [(2000, None, 1), (2100, rows[0][1], None), (2200, [None] * 12, 3), (2300, [float("nan")] * 12, 3), (2400, [1.0], 3), (None, rows[0][1], 3)]
    spark.createDataFrame(rows + odd, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert got(df) == plain(rows) != []


@pytest.mark.parametrize("probe,block", [(1, 16), (40, 1000)])
def test_ties_copies_and_parts(spark, probe, block, monkeypatch):
    """A third of the rows share one vector, small blocks, and a probe that finds too little."""
    monkeypatch.setattr(N, "BLOCK", block)
    rows = clustered(240, 5, 2)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, label) for i, v, label in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(N.mine(df, F.col("id") % 40 == 0, probe=probe, codes=6)) == plain(rows, 40, move=False) != []


def test_repeated_rows_and_other_columns(spark):
    rows = clustered(60, 4, 3)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + rows + rows], SCHEMA + ", score string, rank int")
    found = got(N.mine(df, F.col("id") % 20 == 0))
    once = {r[0] for r in plain(rows, 20, move=False)}
    assert {r[0] for r in found} == once
    for a in once:  # the best positive is there three times, each with the same negatives
        first = [r for r in found if r[0] == a][0]
        assert sum(r[:3] == first[:3] for r in found) in (2, 3) or len(rows) < 5


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1)], SCHEMA)
    assert got(N.mine(df, F.col("id") == 0)) == []  # no other label
    assert got(N.mine(df.limit(0), F.col("id") == 0)) == []
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [2.0], 3), (4, [-1.0], 4)], SCHEMA)
    assert got(N.mine(one, F.col("id") == 0)) == [(0, 1, 1, 2, 65536, 256 * 230)]


def test_large_components_are_limited(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0], 1), (1, [1e30, 1.0], 1), (2, [1e30, 2.0], 2)], "vec_id long, embedding array<double>, label int")
    assert got(N.mine(df, F.col("id") == 0)) == [(0, 1, 1, 2, 2**52, 2**52)]


def test_multi_sequence_yields_all_cells_by_falling_sum():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal(7), np.round(rng.standard_normal(5), 1)
    seen = list(N.multi_sequence(a, b))
    assert {(i, j) for i, j, _ in seen} == {(i, j) for i in range(7) for j in range(5)} and len(seen) == 35
    assert [s for *_, s in seen] == sorted((s for *_, s in seen), reverse=True)
    assert all(s == pytest.approx(a[i] + b[j]) for i, j, s in seen)
    assert heapq.nlargest(3, (s for *_, s in seen)) == pytest.approx(sorted((a[:, None] + b).ravel())[::-1][:3])


def test_windows():
    s = np.array([0, 1, 99, 100, 101, 12345, 2**60], np.int64)
    low, high = N.windows(s, 80, 100)
    for v, b, t in zip(s.tolist(), low.tolist(), high.tolist()):
        assert 100 * b >= 80 * v > 100 * (b - 1) and 100 * t <= 100 * v < 100 * (t + 1)


def test_layout_keeps_cells_together():
    size = np.array([[5, 5, 5, 30, 1], [0, 0, 0, 0, 0], [10, 1, 10, 0, 9]])
    first, many = N.layout(size, 10)
    assert first.tolist() == [[0, 0, 1, 2, 5], [0, 0, 0, 0, 0], [0, 1, 2, 2, 3]]
    assert many.tolist() == [[1, 1, 1, 3, 1], [1] * 5, [1] * 5]
    held: dict = {}
    for (i, j), n in np.ndenumerate(size):
        for p in range(first[i, j], first[i, j] + many[i, j]):
            held[i, p] = held.get((i, p), 0) + n / many[i, j]
    assert max(held.values()) <= 10


def test_anchors_are_sent_only_where_they_open_cells(spark, monkeypatch):
    """Far clusters in parts of their own: an anchor's copies do not grow with the clusters it never opens."""
    monkeypatch.setattr(N, "BLOCK", 20)
    rng = np.random.default_rng(2)
    copies = []
    for clusters in (6, 24):
        middle = 50 * rng.standard_normal((clusters, 8))
        rows = [(i, (middle[i % clusters] + rng.standard_normal(8)).tolist(), i // clusters % 3) for i in range(clusters * 40)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        index = N.build(N.integers(df, 256.0, "vec_id", "embedding", "label"))
        anchors = index.rows.filter("id < 6").withColumn("h", F.lit(0).cast("long")).withColumn("ps", F.lit(None).cast("array<long>"))
        asked = anchors.withColumn("w", F.lit(None).cast("array<int>")).withColumn("t", F.lit(None).cast("array<long>"))
        copies.append(asked.mapInArrow(N._route(index.cells, 60, 20, 0, 0, False), N.ROUTED).count())
    assert copies[1] < 2 * copies[0]


def test_bounds_leave_cells_out():
    """Far clusters are never opened, and what is opened holds the best rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.standard_normal((50, 6)) for c in 60 * rng.standard_normal((20, 6))])
    one, two = N.codebook(x[:, :3], 16), N.codebook(x[:, 3:], 16)
    none = np.zeros((len(one), len(two)))
    cells = N.Cells(one, two, none.astype(int), none, none)
    i, j, r, s = cells.codes(x)
    size, ro, rt = none.astype(int), none.copy(), none.copy()
    np.add.at(size, (i, j), 1)
    np.maximum.at(ro, (i, j), r)
    np.maximum.at(rt, (i, j), s)
    cells = N.Cells(one, two, size, ro, rt)
    a, b, lower, upper = cells.bounds(x[:20])
    for n in range(20):
        scores = x @ x[n]
        assert (scores <= upper[n, i, j]).all() and (scores >= lower[n, i, j]).all()
        fifth = np.sort(scores)[-5]
        opened = cells.visits(a[n], b[n], lower[n], upper[n], 20, None, np.inf) + cells.visits(a[n], b[n], lower[n], upper[n], 20, fifth, np.inf)
        assert len(set(opened)) == len(opened) < (size > 0).sum() / 2
        assert all((i[p], j[p]) in set(opened) for p in np.flatnonzero(scores >= fifth))
