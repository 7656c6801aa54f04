"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenloom.llm import kmeans_tree, vectors
from eigenloom.llm.voronoi import exact_top_k


@pytest.fixture(scope="module")
def table():
    r = np.random.default_rng(6)
    x = r.normal(size=(900, 8)).round(2)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(1000, None), (1001, []), (1100, [float("nan")] * 8), (1200, [1.0, None] * 4), (1300, [1.0] * 5), (None, [1.0] * 8)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cell string")


def best(rows, every, k, work):
    rows = [(i, work(np.array(v))) for i, v in rows[:900]]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in ids[ids % every == 0]:
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), s[i]) for i in order]
    return out


@pytest.mark.parametrize("block", [16_384, 50])
def test_exact_top_k(spark, table, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    got = exact_top_k(frame(spark, table), F.col("id") % 100 == 0, pivots=9).collect()
    want = best(table, 100, 10, lambda v: np.floor(v * 1024))
    assert sorted(tuple(r) for r in got) == sorted((q, n + 1, i, int(s)) for q, x in want.items() for n, (i, s) in enumerate(x))
    assert exact_top_k(frame(spark, table).limit(0), F.col("id") % 100 == 0).count() == 0
    assert exact_top_k(frame(spark, table[:4]), F.col("id") == 0).count() == 3


def test_tree_recall_and_scores(spark, table, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF", 40)
    got = kmeans_tree.near_neighbours(frame(spark, table), F.col("id") % 20 == 0).collect()
    want = best(table, 20, 20, lambda v: v)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    x = {i: np.array(v) for i, v in table[:900]}
    hit = 0
    for q, mine in found.items():
        mine.sort()
        assert [n for n, *_ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        assert all(abs(s - x[q] @ x[i]) < 1e-9 for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & {i for i, _ in want[q]})
    assert hit >= 0.9 * 20 * len(want)
    assert kmeans_tree.near_neighbours(frame(spark, table).limit(0), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("copies", [11, 40])
def test_exact_top_k_of_queries_with_many_rows(spark, copies):
    r = np.random.default_rng(12)
    rows = [(100, [9.0, 9.0])] * copies + [(200, [-8.0, 7.0])] * 3 + [(200, [1.0, 1.0])] * 9
    rows += [(i, v.tolist()) for i, v in enumerate(r.normal(size=(60, 2)).round(2)) if i]
    ids, x = np.array([i for i, _ in rows]), np.floor(np.array([v for _, v in rows]) * 1024)
    want = []
    for q in {(i, tuple(v)) for i, v in zip(ids.tolist(), x.tolist()) if i % 100 == 0}:
        s = x @ np.array(q[1])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q[0]][:10]
        want += [(q[0], n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]
    got = exact_top_k(frame(spark, rows), F.col("id") % 100 == 0, pivots=200).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_small_leaves_still_give_k_neighbours(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF", 3)
    monkeypatch.setattr(kmeans_tree, "calibrate", lambda *a, **b: 1)
    r = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(200, 4)))] + [(0, [50.0, 0.0, 0.0, 0.0])] * 30
    got = kmeans_tree.near_neighbours(frame(spark, rows), F.col("id") % 20 == 0).collect()
    many = {}
    for x in got:
        many.setdefault((x["query_id"], x["rank"]), []).append(x["vec_id"])
    assert {q for q, _ in many} == set(range(0, 200, 20)) and all((q, 20) in many for q in range(0, 200, 20))
    assert len(many[0, 20]) == 2 and all(q not in v for (q, _), v in many.items())
