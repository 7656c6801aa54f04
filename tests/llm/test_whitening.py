"""Whitening against numpy on whole matrices."""

import numpy as np
import pytest
from eigenloom.llm import whitening as W
from eigenloom.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(ids, vectors, keep=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)}, vectors by eigh of the covariance of the distinct rows."""
    x = np.floor(256 * np.asarray(vectors, dtype=np.float32).astype(np.float64))
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, row in zip(ids, x):
        for j in range(keep):
            out[i, j + 1] = (n, int(((n * row - s) ** 2).sum()), abs((row - s / n) @ v[:, j]) / np.sqrt(e[j]), e[j] / e.sum())
    return out


def same(rows, want):
    got = {(r.vec_id, r.component): r for r in rows}
    assert got.keys() == want.keys()
    for key, (n, deviation, size, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, abs=1e-9)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 40)) @ np.diag(np.linspace(3, 1, 40))).astype(np.float32)
    vectors[300:] = vectors[7]  # a quarter of the rows are one vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [None] + [0.0] * 39, 1), (902, [float("nan")] * 40, 1), (903, [float("inf")] * 40, 1), (904, [], 1), (905, [1.0], 1)]
    spark.createDataFrame(rows + odd, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_whitening"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    same(got.collect(), plain(range(400), vectors))


def test_null_id_repeats_and_other_columns(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((50, 3)).astype(np.float32)
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(vectors)] * 2 + [(None, vectors[0].tolist(), "b", 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n int")
    got = W.whiten(df).collect()
    assert len(got) == 101 * 3  # three dimensions, three components
    assert sum(r.vec_id is None for r in got) == 3
    same([r for r in got if r.vec_id is not None], plain(range(50), vectors, 3))


def test_no_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    assert W.whiten(one).count() == 0
    assert W.whiten(one.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 0.0, 1.0], 0) for i in range(6)], SCHEMA)
    got = W.whiten(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 6  # one direction has variance


def test_large_entries(spark):
    big = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in W.whiten(big).collect()}
    n, x = 3, [(2**40, 0), (0, 256), (1280, 1280)]
    s = [sum(c) for c in zip(*x)]
    exact = [sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x]
    assert [got[i, 1].deviation for i in (1, 2, 3)] == [v if v < 2**63 else None for v in exact]


def test_filter_damps_the_unwanted_spectrum():
    e = np.concatenate([[9.0, 7.0, 6.0, 5.0], np.linspace(1, 0, 60)])
    q = np.eye(64)
    out = W.chebyshev(lambda v: e[:, None] * v, q, e[:, None] * q, 1.0, 9.0, 8)
    gain = np.abs(np.diag(out))
    assert gain[4:].max() < 1e-3 * gain[3] and gain[0] == pytest.approx(1)
    found = W.leading(lambda v: e[:, None] * v, 64, 4, guard=4)
    assert found.values == pytest.approx(e[:4], rel=1e-12)
    assert np.abs(found.vectors[:4]) == pytest.approx(np.eye(4), abs=1e-9)


def test_uncertified_is_an_error():
    with pytest.raises(ArithmeticError):
        rng = np.random.default_rng(0)
        W.leading(lambda v: rng.standard_normal(v.shape), 64, 4)


def test_floor_of_negative_entries(spark):
    rows = W.integers(spark.createDataFrame([(1, [-0.001, 0.5])], "vec_id long, embedding array<double>"))
    assert rows.select(F.col("x")).first()[0] == [-1, 128]
