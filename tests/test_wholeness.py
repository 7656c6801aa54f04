"""No silently dropped, merged or shifted rows; one scan where one is enough."""

import os
import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eigenloom import HopSpec, SubspaceEstimator
from eigenloom.operators import channels as C
from eigenloom.operators import hops as H
from eigenloom.operators import patches as PT
from eigenloom.operators import prepare as A
from eigenloom.operators import project as E
from eigenloom.operators import stats as S
from eigenloom.operators import trees as T
from eigenloom.plans import queries as Q
from eigenloom.plans.steps import channel_batches, fit_channelwise
from tests.helpers import images, smooth
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
TWO = [HopSpec(2, 1, channelwise=True), HopSpec(2, 1)]


def test_features_do_not_depend_on_the_size_of_the_model(spark, monkeypatch):
    x = smooth(np.random.default_rng(1), 12, 6, 6, 2)
    df = images(spark, x)
    model = SubspaceEstimator(TWO, th1=0.03, th2=0.001, emit="all").fit(df)
    odd = df.withColumn("tag", F.col("image_id")).withColumn("image_id", F.when(df.image_id < 6, df.image_id % 2))
    out = {}
    for limit in (T.MODEL_BYTES, 64):
        monkeypatch.setattr(T, "MODEL_BYTES", limit)
        wide = model.features(odd, keep=("tag", "height"))
        assert "hashpartitioning" not in plan(wide) and "Join" not in plan(wide) and "Aggregate" not in plan(wide)
        assert wide.columns == ["image_id", "tag", "height", "features"]
        out[limit] = wide.orderBy("tag").collect()
    assert len(T.lineages(T.slim(model.tree))) > 1
    one, many = out.values()
    assert [r[:3] for r in one] == [r[:3] for r in many] and len(one) == 12 and sum(r.image_id is None for r in one) == 6
    np.testing.assert_allclose([r.features for r in one], [r.features for r in many], atol=1e-9)


def test_unmatched_rows_are_counted(spark):
    schema = "image_id long, r int, c int, f array<double>"
    a = spark.createDataFrame([(1, 0, 0, [1.0, 2.0]), (2, 0, 0, [1.0]), (3, 0, 0, [1.0]), (None, 0, 0, [1.0]), (5, 0, 0, [None])], schema)
    b = spark.createDataFrame([(1, 0, 0, [1.5, 2.0]), (2, 0, 0, [1.0, 9.0]), (4, 0, 0, [1.0]), (None, 0, 0, [1.0]), (5, 0, 0, [1.0])], schema)
    assert tuple(E.reconstruction_error(a, b).first()) == (0.25, 1, 2, 2, 2)
    assert tuple(E.reconstruction_error(a.limit(0), b.limit(0)).first()) == (None, 0, 0, 0, 0)


def test_patch_tables_meet_image_by_image(spark, monkeypatch):
    """One exchange of a row per image, band and task; many bands, repeated keys and rows of one side only give the counts of a plain match."""
    rng = np.random.default_rng(6)
    keys = [(i, r, c) for i in range(6) for r in range(9) for c in range(4)]
    a = [(*k, rng.standard_normal(3).round(2).tolist()) for k in keys if sum(k) % 7]
    b = [(*k, rng.standard_normal(3).round(2).tolist()) for k in keys if sum(k) % 5]
    a += [(*a[0][:3], [9.0, 9.0, 9.0]), (*a[1][:3], a[1][3])]
    b += [(*a[1][:3], [0.0, 0.0])]
    schema = "image_id long, r int, c int, f array<double>"
    left, right = (spark.createDataFrame(x, schema).repartition(4) for x in (a, b))
    gaps, only, unlike = [], [0, 0], 0
    for k in keys:
        x, y = sorted(v for *q, v in a if tuple(q) == k), sorted(v for *q, v in b if tuple(q) == k)
        for p, q in zip(x, y):
            gaps += [abs(s - t) for s, t in zip(p, q)] if len(p) == len(q) else []
            unlike += len(p) != len(q)
        only = [only[0] + max(0, len(x) - len(y)), only[1] + max(0, len(y) - len(x))]
    for band in (64, 2):
        monkeypatch.setattr(E, "BAND", band)
        r = E.reconstruction_error(left, right)
        text = plan(r)
        assert "Join" not in text and text.count("hashpartitioning") == 1
        r = r.first()
        assert r.mae == pytest.approx(np.mean(gaps)) and (r.n, r.n_left_only, r.n_right_only, r.n_unlike) == (len(gaps) // 3, *only, unlike)
    packed = E._banded(left, 0)
    assert packed.count() <= 4 * 6 * 5 < left.count()  # a row per task, image and band, not per patch


def test_the_way_back_is_measured_in_one_pass(spark):
    x = smooth(np.random.default_rng(2), 10, 6, 6, 2)
    df = images(spark, x)
    model = SubspaceEstimator([HopSpec(2, 1, channelwise=True, need_bias=True), HopSpec(2, 1, need_bias=True)], th1=0.05, th2=0.001).fit(df)
    error = E.round_trip_error(df, model.tree, model.dims, 1, 1)
    assert plan(error).count("MapInArrow") == 1 and "Join" not in plan(error)
    r = error.first()
    assert r.mae < 1e-9 and r.n == 10 * 4 * 4
    spec, node = HopSpec(3, 1, need_bias=True), None
    one = SubspaceEstimator([spec]).fit(df)
    node, coefs, patches = one.tree[0]["nodes"][0], E.coefficients(df, one.tree, one.dims), PT.patch_table(df, one.dims, spec)
    for exact in (True, False):
        joined = E.reconstruction_error(patches, E.invert(coefs, node, spec, exact, one.dc(df))).first()
        r = E.round_trip_error(df, one.tree, one.dims, exact=exact).first()
        assert r.mae == pytest.approx(joined.mae, abs=1e-9) and r.n == joined.n and joined.n_left_only == joined.n_right_only == 0
    with pytest.raises(ValueError, match="do not go with"):
        E.invert(coefs, node, spec, dc=one.dc(df.filter("image_id > 0")))
    assert tuple(E.round_trip_error(df.limit(0), one.tree, one.dims).first()) == (None, 0)


def test_wide_vectors_from_maps_ask_for_an_identity(spark):
    x = smooth(np.random.default_rng(1), 8, 5, 5, 2)
    df = images(spark, x)
    model = SubspaceEstimator([HopSpec(2, 1)], th1=2.0, th2=0.0).fit(df)
    maps = model.transform(df)
    wide = C.wide_features(maps)
    assert plan(wide).count("hashpartitioning") == 1
    want = {r.image_id: r.features for r in model.features(df).collect()}
    assert {r.image_id: r.features for r in wide.collect()} == want
    with pytest.raises(Exception, match="more than once"):
        C.wide_features(maps.unionByName(maps.filter("image_id = 3"))).collect()
    with pytest.raises(Exception, match="no image_id"):
        C.wide_features(maps.withColumn("image_id", F.when(F.col("image_id") != 3, F.col("image_id")))).collect()
    with pytest.raises(Exception, match="more than once"):
        C.stack_channels(maps.unionByName(maps)).collect()


def test_a_large_joint_node_fits_into_a_worker(spark):
    """2,000 features: the Gram matrix reaches its solver as packed lines, and no Python worker passes 1 GB."""
    k, n = 2000, 60
    x = np.random.default_rng(3).standard_normal((n, 1, 1, k))
    model = SubspaceEstimator([HopSpec(window=1, num_kernels=20)]).fit(images(spark, x, parts=4))
    flat = x.reshape(n, k)
    z = flat - flat.mean(axis=0)
    z -= z.mean(axis=1, keepdims=True)
    values = np.linalg.svd(z, compute_uv=False)[:19] ** 2 / (n - 1)
    dc = k * (flat - flat.mean(axis=0)).mean(axis=1).var()
    energy = np.array([r["energy"] for r in model.tree[0]["nodes"][0]["rows"]])
    np.testing.assert_allclose(energy[1:] / energy[0], values / dc, rtol=1e-7)

    def peak(it):
        for batch in it:
            mb = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            yield pa.RecordBatch.from_pydict({"mb": [mb]})

    workers = spark.range(0, 64, 1, 16).mapInArrow(peak, "mb double").collect()  # workers are used again
    assert max(r.mb for r in workers) < 1024


def test_missing_cells_are_an_error(spark):
    cells = [(1, 0, r, c, 10.0 * r + c) for r in range(2) for c in range(3)]
    schema = "image_id long, channel int, r int, c int, value double"
    good = PT.maps_from_values(spark.createDataFrame(cells, schema), 0, 2, 3).first()
    assert good.v == [0.0, 1.0, 2.0, 10.0, 11.0, 12.0]
    for bad in (cells[:1] + cells[2:], [*cells, cells[0]], cells[:-1] + [(1, 0, 0, 5, 1.0)], cells[:-1] + [(1, 0, None, 2, 1.0)]):
        with pytest.raises(Exception, match="exactly once"):
            PT.maps_from_values(spark.createDataFrame(bad, schema), 0, 2, 3).collect()
    two = spark.createDataFrame([(h, *x) for h in (0, 1) for x in cells], "hop int, " + schema)
    assert sorted(r.hop for r in PT.maps_from_values(two, None, 2, 3).collect()) == [0, 1]
    with pytest.raises(Exception, match="exactly once"):
        PT.maps_from_values(two, 0, 2, 3).collect()


@pytest.mark.parametrize("k", [4, 20])
def test_offsets_cost_no_digits(spark, k):
    x = smooth(np.random.default_rng(3), 500, 1, 1, k).reshape(500, k)
    rows = images(spark, (x + 1e8).reshape(500, 1, 1, k)).select(F.col("pixels").alias("f"))
    stats = S.row_stats(rows, k)
    got = np.array([r.value for r in S.covariance(stats).orderBy("i", "j").collect()]).reshape(k, k)
    np.testing.assert_allclose(got, np.cov(x.T, ddof=0), atol=1e-6)
    mean = [r.value for r in S.feature_means(stats).orderBy("k").collect()]
    np.testing.assert_allclose(mean, (x + 1e8).mean(axis=0), rtol=1e-14)
    assert S.dc_variance(stats).first().value == pytest.approx(k * x.mean(axis=1).var(), abs=1e-6)
    assert S.covariance(S.row_stats(rows.limit(0), k)).count() == 0


@tables
def test_statistics_need_one_scan(spark):
    colour = Q.colour(spark, SF)
    for spec in (HopSpec(window=3), HopSpec(channelwise=True)):
        stats = S.patch_stats(colour, Q.COLOUR, spec)
        for df in (S.residual_covariance(stats), S.covariance(stats), S.dc_variance(stats), S.feature_means(stats)):
            assert plan(df).count("FileScan") == 1
    maps = Q.SubspaceEstimator([Q.STEP]).fit(Q.grey(spark, SF))
    kernels = C.part_kernels(maps.kernels(spark), 0.249, 0.24853)
    text = plan(C.pooled_roles(maps.transform_maps(Q.grey(spark, SF), "all"), kernels))
    assert text.count("FileScan") == 1 and text.count("MapInArrow") == 2 and text.count("hashpartitioning") == text.count("hashpartitioning(hop")  # kernels only


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf"), None])
@pytest.mark.parametrize("shape", [(4, 4, 2), (1, 1, 3), (1, 1, 20)])
def test_pixels_that_are_no_numbers_are_reported(spark, bad, shape):
    df = images(spark, smooth(np.random.default_rng(4), 9, *shape), 1)
    holes = df.withColumn("pixels", F.when(df.image_id == 5, F.transform("pixels", lambda p, i: F.when(i == 1, F.lit(bad)).otherwise(p))).otherwise(df.pixels))
    audit = A.shape_audit(holes).collect()
    assert [(r.n, r.broken) for r in audit] == [(9, 1)]
    spec = HopSpec(window=min(shape[0], 2))
    with pytest.raises(ValueError, match="1 images"):
        SubspaceEstimator([spec]).fit(holes)
    model = SubspaceEstimator([spec]).fit(df)
    with pytest.raises(Exception, match="images do not have|is not a vector"):
        model.features(holes).collect()


def test_batches_of_maps_are_cut_by_bytes(spark, monkeypatch):
    x = smooth(np.random.default_rng(5), 30, 8, 8, 3)
    maps = C.split_channels(images(spark, x, 1), (8, 8, 3), 0)
    want = fit_channelwise(maps, spec=HopSpec(2, 1))[1].orderBy("channel", "image_id").collect()
    monkeypatch.setattr(H, "BATCH_BYTES", 8 * 64 * 10)
    batch = maps.toArrow().combine_chunks().to_batches()[0]
    sizes = [p.shape[1] for _, _, p, _ in channel_batches([batch], (8, 8), 1)]
    assert sum(sizes) == 90 and max(sizes) <= 5
    got = fit_channelwise(maps, spec=HopSpec(2, 1))[1].orderBy("channel", "image_id").collect()
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r.v for r in got], [r.v for r in want], atol=1e-9)
