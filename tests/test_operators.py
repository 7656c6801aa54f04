"""Operators outside the fit, on small fixtures."""

import hashlib
import time

import os
from functools import partial

import numpy as np
import pyarrow as pa
import plain
import pytest
from helpers import images, maps_array, smooth

from eigenloom import HopSpec, SubspaceEstimator
from eigenloom.functions import pixels as P
from eigenloom.operators import channels as C
from eigenloom.operators import patches as PT
from eigenloom.operators import prepare as A
from eigenloom.operators import project as E
from eigenloom.operators import stats as S
from eigenloom.plans.steps import fit_channelwise, fit_joint
from eigenloom.sources import images as I
from eigenloom.sources.scratch import scratch_path
from pyspark.sql import functions as F


def digest(i, seed):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i


@pytest.mark.parametrize("n", [0, 1, 17, 499, 500, 900])
@pytest.mark.parametrize("edge", [100_000, 3])
def test_exact_subset(spark, monkeypatch, n, edge):
    """Also when the edge lies in a bucket that must be cut further."""
    monkeypatch.setattr(A, "BOUNDARY_ROWS", edge)
    monkeypatch.setattr(A, "BUCKET_DIGITS", 1)
    df = spark.range(500).withColumnRenamed("id", "k").repartition(5)
    got = sorted(r.k for r in A.subset_exact(df, "k", n=n, seed=3).collect())
    assert got == sorted(sorted(range(500), key=lambda i: digest(i, 3))[:n])


def test_exact_subset_fraction_and_duplicates(spark):
    assert A.subset_exact(spark.range(333), "id", fraction=0.25).count() == int(333 * 0.25)
    with pytest.raises(ValueError):
        A.subset_exact(spark.range(3), "id")
    twice = spark.range(10).unionAll(spark.range(10))
    with pytest.raises(ValueError, match="not unique"):
        A.subset_exact(twice, "id", n=5)


@pytest.mark.parametrize("digits", [1, 4])
def test_shuffle_is_a_seeded_permutation(spark, monkeypatch, digits):
    monkeypatch.setattr(A, "BUCKET_DIGITS", digits)
    want = {i: p for p, i in enumerate(sorted(range(200), key=lambda i: digest(i, 5)))}
    for parts in (1, 6):
        rows = A.shuffle_rows(spark.range(200).repartition(parts), "id", seed=5).collect()
        assert {r.id: r.position for r in rows} == want


@pytest.mark.parametrize("name,limit", [("BROADCAST_KEYS", 0), ("BROADCAST_KEYS", 1000), ("BROADCAST_BYTES", 6)])
def test_unmatched_rows(spark, monkeypatch, name, limit):
    """With few keys by broadcast, with many or long ones salted; one key holds a third of the rows."""
    monkeypatch.setattr(A, name, limit)
    rows = [(k, i) for i, k in enumerate([7] * 40 + [8] * 20 + list(range(100, 160)) + [None])]
    left = spark.createDataFrame(rows, "k int, v int").repartition(6)
    right = spark.createDataFrame([(8,), (8,), (101,), (None,), (999,)], "k int")
    out = A.unmatched(left, right, "k", salts=4)
    assert ("SortMergeJoin" in out._jdf.queryExecution().toString()) == (limit < 1000)
    assert sorted(r.v for r in out.collect()) == sorted(v for k, v in rows if k not in (8, 101))
    assert out.columns == ["k", "v"]


def test_audit_parity_summary(spark):
    x = images(spark, np.zeros((4, 2, 2, 1)))
    assert A.require_one_shape(x) == (2, 2, 1)
    mixed = x.unionByName(images(spark, np.zeros((2, 3, 3, 1))))
    assert {(r.height, r.n, r.broken) for r in A.shape_audit(mixed).collect()} == {(2, 4, 0), (3, 2, 0)}
    with pytest.raises(ValueError, match="one shape"):
        A.require_one_shape(mixed)
    left, right = spark.range(10), spark.range(7, 12).unionAll(spark.range(7, 8))
    r = A.parity(left, right, "id").first()
    assert (r.n_both, r.n_left_only, r.n_right_only, r.n_left_rows, r.n_right_rows) == (3, 7, 2, 10, 6)
    assert sorted(v.id for v in A.unmatched(left, right, "id").collect()) == list(range(7))
    types = {r.name: r.type for r in A.summary_types(x).collect()}
    assert types["pixels"] == "array<double>"


def test_write_and_read_splits(spark):
    path = scratch_path(spark, "test-images")
    df = images(spark, np.arange(24.0).reshape(6, 2, 2, 1)).withColumn("split", F.when(F.col("image_id") < 4, "train").otherwise("test"))
    I.write_images(df, path)
    assert I.read_images(spark, path, "train").count() == 4
    assert I.read_images(spark, path).count() == 6
    with pytest.raises(Exception):
        I.read_images(spark, path + "-none")
    rows = [(1, 0, 1, 2, 1, [1.0, 2.0])]
    assert I.images_from_rows(spark, rows).first().pixels == [1.0, 2.0]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("kind", [np.uint8, np.float32])
def test_reading_saved_arrays(spark, tmp_path, save, kind):
    x = np.random.default_rng(0).integers(0, 255, size=(23, 4, 5, 3)).astype(kind)
    y = np.arange(23) % 10
    path = str(tmp_path / "set.npz")
    save(path, x_train=x, y_train=y)
    read = partial(I.read_npz, spark, unpack=str(tmp_path / "unpacked"))
    rows = read(path, "x_train", "y_train", parts=4).orderBy("image_id").collect()
    assert [r.image_id for r in rows] == list(range(23)) and [r.label for r in rows] == list(y)
    assert {(r.height, r.width, r.channels) for r in rows} == {(4, 5, 3)}
    np.testing.assert_array_equal([r.pixels for r in rows], x.reshape(23, -1))
    assert read(path, "x_train").first().label is None
    save(path, x_train=x, y_train=y[:5], flat=x.reshape(23, -1))
    with pytest.raises(ValueError, match="one label"):
        read(path, "x_train", "y_train")
    with pytest.raises(ValueError, match="four dimensions"):
        read(path, "flat")
    with pytest.raises(FileNotFoundError):
        read(path + ".none", "x_train")


def test_maps_stack_to_images(spark):
    x = smooth(np.random.default_rng(6), 6, 4, 3, 3)
    back = C.stack_channels(C.split_channels(images(spark, x), (4, 3, 3))).orderBy("image_id").collect()
    assert {(r.height, r.width, r.channels) for r in back} == {(4, 3, 3)}
    np.testing.assert_array_equal([r.pixels for r in back], x.reshape(6, -1))


@pytest.mark.parametrize("shape", [(7, 6, 2), (5, 8, 1)])
def test_expressions_match_numpy(spark, shape):
    h, w, c = shape
    x = np.random.default_rng(0).normal(size=(5, h, w, c))
    df = images(spark, x)
    px = F.col("pixels")
    want = {
        "pad": (P.pad(px, h, w, c, 2, 1.5), np.pad(x, ((0, 0), (2, 2), (2, 2), (0, 0)), constant_values=1.5)),
        "first": (P.channel_first(px, h, w, c), x.transpose(0, 3, 1, 2)),
        "back": (P.channel_last(P.channel_first(px, h, w, c), h, w, c), x),
        "norm": (P.channel_normalise(px, [0.5] * c, [2.0] * c, 4.0), (x / 4 - 0.5) / 2),
    }
    got = df.orderBy("image_id").select(*[e.alias(k) for k, (e, _) in want.items()]).collect()
    for k, (_, v) in want.items():
        np.testing.assert_allclose([r[k] for r in got], v.reshape(5, -1))
    maps = C.split_channels(df, shape)
    for how in ("max", "min", "avg", "sum"):
        for ragged in ("pad", "drop"):
            for block in (2, 3):
                want_ = plain.pool(x, block, how, ragged)
                got_, _ = maps_array(C.pool_maps(maps, block, how, ragged), -1)
                np.testing.assert_allclose(got_, want_, atol=1e-12)
                e = maps.select("image_id", "channel", P.pool_map(F.col("v"), h, w, block, how, ragged).alias("p"))
                e = np.array([r.p for r in e.orderBy("channel", "image_id").collect()]).reshape(c, 5, *want_.shape[1:3])
                np.testing.assert_allclose(e.transpose(1, 2, 3, 0), want_, atol=1e-12)


def test_chained_expressions_do_not_multiply(spark):
    """Spark merges the projections; each step must still run once per row, not once per pixel of the next."""
    x = np.random.default_rng(1).normal(size=(4, 64, 64, 3))
    px, df = F.col("pixels"), images(spark, x, 1)
    df = df.withColumn("pixels", P.channel_normalise(px, P.COLOUR_MEAN, P.COLOUR_STD, 1.0))
    df = df.withColumn("pixels", P.pad(px, 64, 64, 3, 1)).withColumn("pixels", P.channel_first(px, 66, 66, 3))
    df = df.withColumn("pixels", P.channel_last(px, 66, 66, 3)).withColumn("pixels", P.channel_slice(px, 66 * 66, 3, F.lit(1)))
    df = df.withColumn("pixels", P.pool_map(px, 66, 66, 2)).withColumn("pixels", P.residual(P.residual(px)))
    start = time.time()
    got = np.array([r.pixels for r in df.orderBy("image_id").collect()])
    assert time.time() - start < 20
    want = np.pad((x[..., 1] - P.COLOUR_MEAN[1]) / P.COLOUR_STD[1], ((0, 0), (1, 1), (1, 1)))
    want = want.reshape(4, 33, 2, 33, 2).max(axis=(2, 4)).reshape(4, -1)
    np.testing.assert_allclose(got, want - want.mean(axis=1, keepdims=True), atol=1e-9)


@pytest.mark.parametrize("order", ["ijc", "cij"])
def test_patch_tables_agree(spark, order):
    x = np.random.default_rng(0).normal(size=(4, 7, 6, 2))
    df = images(spark, x)
    a = PT.patch_table(df, (7, 6, 2), HopSpec(3, 2, order=order))
    b = PT.patch_table_sql(df, (7, 6, 2), 3, 2, order)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 4 * 3 * 2
    got = np.array([r.f for r in a.orderBy("image_id", "r", "c").collect()]).reshape(4, 3, 2, -1)
    np.testing.assert_array_equal(got, plain.patches(x, 3, 2, order))


@pytest.mark.parametrize("k", [4, 20])
def test_statistics_tables(spark, k):
    x = smooth(np.random.default_rng(1), 50, 1, 1, k)
    rows = images(spark, x).select(F.col("pixels").alias("f"))
    v, shift = x.reshape(50, k), x[0].ravel()
    stats = S.row_stats(rows, k, shift).cache()
    z = v - v.mean(axis=1, keepdims=True)
    got = np.array([r.value for r in S.residual_covariance(stats).orderBy("i", "j").collect()]).reshape(k, k)
    np.testing.assert_allclose(got, np.cov(z.T), atol=1e-10)
    mean = [r.value for r in S.feature_means(stats).orderBy("k").collect()]
    np.testing.assert_allclose(np.array(mean) + shift, v.mean(axis=0))
    assert S.dc_variance(stats).first().value == pytest.approx(k * v.mean(axis=1).var())
    assert S.counts(stats).first().n == 50
    y = z - z.mean(axis=0)
    assert S.bias(rows, v.mean(axis=0)).first().value == pytest.approx(np.sqrt((y * y).sum(axis=1)).max() / np.sqrt(k))


def test_an_archive_is_read_front_to_back(tmp_path, monkeypatch):
    """Each array is opened once by a task and its bytes are read once, in order."""
    import builtins

    path, x = str(tmp_path / "a.npz"), np.arange(500 * 12, dtype=np.float32).reshape(500, 2, 3, 2)
    np.savez(path, other=np.zeros(77), x=x, y=np.arange(500))
    array, labels = I.stored_array(path, "x"), I.stored_array(path, "y")
    opened, seeks, read = [], [], []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def tell(self):
            return self.f.tell()

        def seek(self, at):
            seeks.append(at)
            return self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    plain_open = builtins.open
    monkeypatch.setattr(builtins, "open", lambda p, *a: opened.append(p) or Counted(plain_open(p, *a)))
    monkeypatch.setattr(I, "STEP_BYTES", 10 * 12 * 8)
    batches = [pa.record_batch({"id": np.arange(lo, lo + 100)}) for lo in (100, 200, 300)]
    got = pa.Table.from_batches(I.archive_batches(iter(batches), array, labels))
    monkeypatch.undo()
    assert opened == [path, path] and len(seeks) == 2  # one stream for pixels, one for labels, each moved to its range once
    assert sum(read) == 300 * (12 * 4 + 8)
    np.testing.assert_array_equal(np.array(got["pixels"].to_pylist()), x[100:400].reshape(300, -1))
    assert got["label"].to_pylist() == got["image_id"].to_pylist() == list(range(100, 400))


def test_a_compressed_archive_is_unpacked_once(spark, tmp_path):
    path, folder, x = str(tmp_path / "c.npz"), str(tmp_path / "unpacked"), np.arange(60.0).reshape(10, 2, 3, 1)
    np.savez_compressed(path, x=x, y=np.arange(10))
    with pytest.raises(ValueError, match="compressed"):
        I.read_npz(spark, path, "x", "y")
    rows = I.read_npz(spark, path, "x", "y", parts=3, unpack=folder).orderBy("image_id").collect()
    np.testing.assert_array_equal([r.pixels for r in rows], x.reshape(10, 6))
    assert [r.label for r in rows] == list(range(10))
    assert sorted(os.listdir(folder)) == ["x.npy", "y.npy"]


@pytest.mark.parametrize("use_dc", [True, False])
@pytest.mark.parametrize("need_bias", [True, False])
def test_inverse_restores_the_patches(spark, use_dc, need_bias):
    x = smooth(np.random.default_rng(2), 20, 8, 8, 1)
    df = images(spark, x)
    model = SubspaceEstimator([HopSpec(2, 1, use_dc=use_dc, need_bias=need_bias)]).fit(df)
    node, spec = model.tree[0]["nodes"][0], model.tree[0]["spec"]
    coefs = E.coefficients(df, model.tree, model.dims)
    patches = PT.patch_table(df, (8, 8, 1), HopSpec(2, 1))
    r = E.reconstruction_error(patches, E.invert(coefs, node, spec)).first()
    assert r.mae < 1e-9 and r.n == 20 * 49
    plain_ = E.reconstruction_error(patches, E.invert(coefs, node, spec, exact=False)).first().mae
    assert (plain_ < 1e-9) == (not use_dc)


def test_projection_on_a_large_kernel_table(spark, monkeypatch):
    x = smooth(np.random.default_rng(5), 10, 6, 6, 1)
    df = images(spark, x)
    model = SubspaceEstimator([HopSpec(2, 1)]).fit(df)
    patches = S.remove_mean(PT.patch_table(df, (6, 6, 1), HopSpec(2, 1)), model.tree[0]["nodes"][0]["mean"])
    patches = patches.withColumn("node", F.lit(0))
    kernels = model.kernels(spark).unionByName(model.kernels(spark).withColumn("node", F.lit(7)))  # one node has no patches
    odd = patches.limit(3).select("image_id", "r", "c", F.lit(9).alias("node"), "f")  # and one has no kernels
    small = E.project_on_kernels(patches.unionByName(odd.select(patches.columns)), kernels)
    monkeypatch.setattr(E, "BROADCAST_VALUES", 8)
    monkeypatch.setattr(E, "OUTPUT_VALUES", 8)
    large = E.project_on_kernels(patches, kernels, salts=5)
    text = large._jdf.queryExecution().toString()
    assert "Join" not in text and "hashpartitioning(bucket" in text  # products come before there is a row per kernel
    want = {tuple(r[:5]): r.value for r in small.collect()}
    got = {tuple(r[:5]): r.value for r in large.collect()}
    assert got.keys() == want.keys() and len(got) == 10 * 25 * 4
    assert max(abs(got[k] - want[k]) for k in got) < 1e-12
    values = model.tree[0]["nodes"][0]["weights"] @ np.array([r.f for r in patches.orderBy("image_id", "r", "c").collect()]).T
    assert max(abs(got[i, r, c, 0, q] - values[q, 25 * i + 5 * r + c]) for i, r, c, _, q in got) < 1e-9
    with pytest.raises(Exception, match="does not have the 4 values"):
        E.project_on_kernels(patches.withColumn("f", F.slice("f", 1, 3)), kernels).count()


def test_inverse_of_the_second_hop(spark):
    x = smooth(np.random.default_rng(2), 15, 8, 8, 1)
    df = images(spark, x)
    model = SubspaceEstimator([HopSpec(2, 1, need_bias=True)] * 2, th1=0.1, th2=0.01).fit(df)
    hop1 = model.tree[1]["nodes"][0]
    back = E.invert(E.coefficients(df, model.tree, model.dims, 1, 0), hop1, model.tree[1]["spec"])
    maps, channels = maps_array(model.transform_maps(df, "all"), 0)
    want = plain.patches(maps[..., [hop1["parent"]]], 2, 1)
    got = np.array([r.f for r in back.orderBy("image_id", "r", "c").collect()]).reshape(want.shape)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_steps_match_the_two_pass_model(spark):
    x = smooth(np.random.default_rng(3), 20, 16, 16, 3)
    df = images(spark, x)
    spec = HopSpec(5, 1, ddof=0)
    kernels, maps, _ = fit_joint(df, spec=spec)
    forward, fk, emit, ek, report = C.filter_channels(maps, kernels, 0.02, 0.001)
    want = plain.tree(x, [HopSpec(5, 1, ddof=0, pool_after=2, channelwise=False), HopSpec(2, 1, ddof=0, need_bias=True, channelwise=True)], 0.02, 0.001)
    on = np.flatnonzero(want[0]["role"] == "forward")
    got, channels = maps_array(forward, 0)
    assert channels == list(on)
    np.testing.assert_allclose(got, want[0]["maps"][..., on], atol=1e-8)
    got, channels = maps_array(emit, 0)
    assert channels == list(np.flatnonzero(want[0]["role"] == "emit"))
    assert {r.role: r.n for r in report.collect()} == {k: int((want[0]["role"] == k).sum()) for k in set(want[0]["role"])}
    energy = {r.channel: r.energy for r in fk.collect()}
    k2, m2, fitted = fit_channelwise(forward, energy, HopSpec(2, 1, ddof=0, need_bias=True))
    np.testing.assert_allclose([r.energy for r in k2.orderBy("channel").collect()], want[1]["energy"], atol=1e-9)
    np.testing.assert_allclose(maps_array(m2, 1)[0], want[1]["maps"], atol=1e-6)
    again = maps_array(fitted.transform(forward.filter("image_id < 5")), 1)[0]
    np.testing.assert_allclose(again, want[1]["maps"][:5], atol=1e-6)
    wide = C.wide_features(m2).orderBy("image_id").collect()
    np.testing.assert_allclose([r.features for r in wide], want[1]["maps"].transpose(0, 3, 1, 2).reshape(20, -1), atol=1e-6)


def test_steps_report_bad_maps(spark):
    schema = "image_id bigint, hop int, channel int, height int, width int, v array<double>"
    good = [(i, 0, 0, 2, 2, [1.0 * i, 2.0, 3.0, 4.0]) for i in range(4)]
    for bad in [(9, 0, 0, 2, 2, [1.0]), (9, 0, 1, 1, 1, [1.0]), (9, 0, 0, 2, 2, [None, 1.0, 1.0, 1.0]), (9, 0, 0, 2, 2, None)]:
        with pytest.raises(ValueError, match="1 maps"):
            fit_channelwise(spark.createDataFrame(good + [bad], schema), spec=HopSpec(2, 1))
        fitted = fit_channelwise(spark.createDataFrame(good, schema), spec=HopSpec(2, 1))[2]
        with pytest.raises(Exception, match="1 maps"):
            fitted.transform(spark.createDataFrame(good + [bad], schema)).collect()
    with pytest.raises(ValueError, match="no maps"):
        fit_channelwise(spark.createDataFrame([], schema), spec=HopSpec(2, 1))


def test_full_state_is_handed_on(spark, monkeypatch):
    from eigenloom.operators import hops as H

    x = smooth(np.random.default_rng(4), 20, 6, 6, 3)
    maps = C.split_channels(images(spark, x), (6, 6, 3))
    spec = HopSpec(2, 1)
    want = fit_channelwise(maps, spec=spec)[0].orderBy("channel").collect()
    monkeypatch.setattr(H, "STATE_BYTES", 1)
    got = fit_channelwise(maps, spec=spec)[0].orderBy("channel").collect()
    for a, b in zip(want, got):
        np.testing.assert_allclose(a.weights, b.weights, atol=1e-9)


def test_step_on_maps_far_from_zero(spark):
    x = smooth(np.random.default_rng(4), 30, 6, 6, 2)
    x[..., 1] += 1e7
    maps = C.split_channels(images(spark, x), (6, 6, 2)).withColumn("channel", F.col("channel") * 3 + 2)
    kernels, out, fitted = fit_channelwise(maps, {2: 0.5}, HopSpec(2, 1, need_bias=True))
    want = plain.tree(x, [HopSpec(2, 1, need_bias=True, channelwise=True)], 0, 0)[0]
    rows = kernels.orderBy("channel").collect()
    assert [r.channel for r in rows] == list(range(8)) and {(r.hop, r.node) for r in rows} == {(0, 0), (0, 1)}
    np.testing.assert_allclose([r.energy for r in rows], want["energy"] * np.repeat([0.5, 1.0], 4), atol=1e-6)
    np.testing.assert_allclose(maps_array(out, 0)[0], want["maps"], atol=1e-4)
