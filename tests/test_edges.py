"""Edge cases: thresholds, degenerate data, malformed input, saved models."""

import warnings

import numpy as np
import pytest
from helpers import images, maps_array, smooth

from eigenloom import HopSpec, SubspaceEstimator, load_model, save_model
from eigenloom.operators import kernels as K
from eigenloom.operators.kernels import node_kernels
from eigenloom.plans.queries import tiles
from eigenloom.sources.scratch import scratch_path
from eigenloom.spec import check_hops

SLIDE = [HopSpec(2, 1), HopSpec(2, 1, need_bias=True)]


def test_settings_are_checked():
    for wrong in (dict(window=0), dict(pool_fn="mode"), dict(ragged="x"), dict(num_kernels=0), dict(ddof=2),
                  dict(center="x"), dict(order="x"), dict(patch_fn=3), dict(stride=0), dict(pool_after=-1)):
        with pytest.raises(ValueError):
            HopSpec(**wrong)
    with pytest.raises(ValueError, match="positive"):
        check_hops(SLIDE, 0)
    with pytest.raises(ValueError, match="at least one"):
        check_hops([], 1)
    with pytest.raises(ValueError, match="always channel-wise"):
        check_hops([HopSpec(), HopSpec(channelwise=False)], None)
    with pytest.warns(UserWarning, match="depth is 2"):
        assert len(check_hops(SLIDE, 5)) == 2
    assert [h.channelwise for h in check_hops(SLIDE, None)] == [False, True]


def test_threshold_edges(spark):
    rows = spark.createDataFrame([(h, 0, c, e) for h in (0, 1) for c, e in enumerate([0.5, 0.2, 0.1, 0.05, 0.0])]
                                 + [(h, 1, 5, 0.0) for h in (0, 1)], "hop int, node int, channel int, energy double")
    got = K.assign_roles(rows, 0.2, 0.1, 2).filter("node = 0").orderBy("hop", "channel").collect()
    assert [r.role for r in got[:5]] == ["forward", "forward", "emit", "discard", "discard"]
    assert [r.role for r in got[5:]] == ["emit", "emit", "emit", "discard", "discard"]
    zero = {(r.hop, r.node): r.role for r in K.assign_roles(rows, 0.3, 0.0, 2).filter("energy = 0").collect()}
    assert zero == {(0, 0): "emit", (1, 0): "emit", (0, 1): "discard", (1, 1): "discard"}  # a node without energy has no features
    assert {r.role for r in K.assign_roles(rows, 0.0, 0.0, 2).filter("node = 0 and hop = 0").collect()} == {"forward"}


def test_constant_channel_is_discarded(spark):
    x = smooth(np.random.default_rng(0), 20, 6, 6, 2)
    x[..., 1] = 5.0
    model = SubspaceEstimator([HopSpec(2, 1, channelwise=True, need_bias=True), HopSpec(2, 1)], th1=0.05, th2=0.0).fit(images(spark, x))
    flat = model.tree[0]["nodes"][1]
    assert [r["energy"] for r in flat["rows"]] == [0.0] * 4
    assert {r["role"] for r in flat["rows"]} == {"discard"}
    assert not flat["use_dc"] and np.isfinite(flat["weights"]).all() and flat["bias"] == pytest.approx(0, abs=1e-12)
    values, _ = maps_array(model.transform_maps(images(spark, x), "all"), 0)
    assert np.isfinite(values).all()


def test_all_constant_images_stop_early(spark):
    df = images(spark, np.full((5, 4, 4, 1), 3.25))
    with pytest.warns(UserWarning, match="depth is 1"):
        model = SubspaceEstimator(SLIDE, th1=0.0, th2=0.0).fit(df)
    assert model.depth == 1 and model.transform(df).count() == 0
    assert model.features(df).count() == 5


def test_one_image_one_patch(spark):
    model = SubspaceEstimator([HopSpec(2, 1)]).fit(images(spark, np.arange(4.0).reshape(1, 2, 2, 1)))
    assert all(np.isfinite(n["weights"]).all() for n in model.tree[0]["nodes"])


def test_patch_without_variation_but_with_level(spark):
    """Every patch is flat: only the mean part has energy."""
    level = np.random.default_rng(1).normal(size=(30, 1, 1, 1))
    model = SubspaceEstimator([HopSpec(2, 2)]).fit(images(spark, np.broadcast_to(level, (30, 4, 4, 1)).copy()))
    energy = [r["energy"] for r in model.tree[0]["nodes"][0]["rows"]]
    np.testing.assert_allclose(energy, [1, 0, 0, 0], atol=1e-12)


def test_no_dc_variance_falls_back():
    """Patches with equal means: L = 0, kernels as without the mean kernel."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4))
    x -= x.mean(axis=1, keepdims=True)
    got = node_kernels(50, x.sum(axis=0), x.T @ x, np.zeros(4), HopSpec())
    assert not got["use_dc"] and len(got["weights"]) == 4
    np.testing.assert_allclose(got["weights"] @ got["weights"].T, np.eye(4), atol=1e-9)
    assert got["energy"].sum() == pytest.approx(1)


def test_large_offset_does_not_cancel(spark):
    x = smooth(np.random.default_rng(3), 40, 6, 6, 1)
    a = SubspaceEstimator([HopSpec(2, 1)]).fit(images(spark, x))
    b = SubspaceEstimator([HopSpec(2, 1)]).fit(images(spark, x + 1e8))
    np.testing.assert_allclose(b.tree[0]["nodes"][0]["weights"], a.tree[0]["nodes"][0]["weights"], atol=1e-5)
    v = smooth(np.random.default_rng(3), 80, 1, 1, 4)
    a, b = (SubspaceEstimator([HopSpec(1, 1)]).fit(images(spark, y)) for y in (v, v + 1e8))
    np.testing.assert_allclose(b.tree[0]["nodes"][0]["weights"], a.tree[0]["nodes"][0]["weights"], atol=1e-5)


@pytest.mark.parametrize("shape", [(6, 6, 1), (1, 1, 4)])
def test_a_first_image_far_off_is_noticed(spark, monkeypatch, shape):
    from plain import node as plain_node
    from plain import patches as plain_patches

    x = smooth(np.random.default_rng(3), 400, *shape)
    x[0] += 1e6
    spec = HopSpec(min(2, shape[0]), 1)
    want = plain_node(plain_patches(x, spec.window, 1).reshape(-1, 4), spec)
    shifts = []
    solve = K.solve
    monkeypatch.setattr(K, "solve", lambda stats, spec, shift, floor: shifts.append(shift) or solve(stats, spec, shift, floor))
    for limit, scans in ((1e6, 1), (1e2, 2)):
        monkeypatch.setattr(K, "POOR_SHIFT", limit)
        shifts.clear()
        model = SubspaceEstimator([spec]).fit(images(spark, x, 1).orderBy("image_id"))
        got = model.tree[0]["nodes"][0]
        assert len(shifts) == scans
        np.testing.assert_allclose(got["mean"], want["mean"], rtol=1e-9)
        np.testing.assert_allclose([r["energy"] for r in got["rows"]], want["energy"], atol=1e-9)
    np.testing.assert_allclose(shifts[1][0], want["mean"], rtol=1e-9)


@pytest.mark.parametrize("scale", [1e-14, 1e12])
def test_energies_do_not_depend_on_the_scale(spark, scale):
    x = smooth(np.random.default_rng(11), 30, 8, 8, 1)
    a, b = (SubspaceEstimator(SLIDE, th1=0.05, th2=0.01).fit(images(spark, y)) for y in (x, x * scale))
    for h, k in zip(a.tree, b.tree):
        assert len(h["nodes"]) == len(k["nodes"])
        for p, q in zip(h["nodes"], k["nodes"]):
            np.testing.assert_allclose([r["energy"] for r in p["rows"]], [r["energy"] for r in q["rows"]], atol=1e-9)


def test_sign_tie_takes_the_first_entry():
    x = np.array([[1.0, -1.0], [-1.0, 1.0], [2.0, -2.0], [0.5, 0.5]])
    got = node_kernels(4, x.sum(axis=0), x.T @ x, np.zeros(2), HopSpec(use_dc=False))
    assert got["weights"][0][0] > 0 and got["weights"][0][1] < 0


def test_residual_option_gives_a_zero_mean_channel(spark):
    x = smooth(np.random.default_rng(4), 30, 8, 8, 1)
    df = images(spark, x)
    spec = [HopSpec(2, 1, center="residual"), HopSpec(2, 1)]
    model = SubspaceEstimator(spec, th1=0.05, th2=0.001).fit(df)
    values, _ = maps_array(model.transform_maps(df, "all"), 0)
    assert np.abs(values[..., 0]).max() < 1e-12
    silent = [n for n in model.tree[1]["nodes"] if n["parent"] == 0]
    assert silent and all(r["energy"] == 0 for n in silent for r in n["rows"])


@pytest.mark.parametrize("vector", [False, True])
def test_malformed_images_are_reported(spark, vector):
    shape = (1, 1, 3) if vector else (2, 2, 1)
    size = int(np.prod(shape))
    schema = "image_id bigint, height int, width int, channels int, pixels array<double>"
    good = [(i, *shape, [float(i + j * j % 3) for j in range(size)]) for i in range(6)]
    spec = [HopSpec(1, 1)] if vector else [HopSpec(2, 1)]
    for bad in [(9, *shape, [1.0] * (size - 1)), (9, *shape, [None] + [1.0] * (size - 1)), (9, *shape, None),
                (9, shape[0] + 1, *shape[1:], [1.0] * size), (9, None, *shape[1:], [1.0] * size)]:
        df = spark.createDataFrame(good + [bad], schema).coalesce(1)
        with pytest.raises(ValueError, match="1 images"):
            SubspaceEstimator(spec).fit(df)
        model = SubspaceEstimator(spec).fit(spark.createDataFrame(good, schema))
        with pytest.raises(Exception, match="fitted shape|not a vector"):
            model.transform_maps(df, "all").collect()
        with pytest.raises(ValueError):
            SubspaceEstimator(spec).fit(spark.createDataFrame([bad] + good, schema).coalesce(1))
    with pytest.raises(ValueError, match="no images"):
        SubspaceEstimator(spec).fit(spark.createDataFrame([], schema))


def test_window_larger_than_the_map(spark):
    with pytest.raises(ValueError, match="smaller than the window"):
        SubspaceEstimator([HopSpec(5, 1)]).fit(images(spark, np.zeros((2, 4, 4, 1))))


def test_saved_model_is_the_same_in_every_table(spark):
    x = smooth(np.random.default_rng(5), 30, 8, 8, 2)
    df = images(spark, x)
    specs = [HopSpec(patch_fn=tiles, need_bias=True), HopSpec(2, 1, pool_after=2, pool_fn=np.median, need_bias=True)]
    model = SubspaceEstimator(specs, th1=0.05, th2=0.001, emit="all").fit(df)
    path = scratch_path(spark, "test-model")
    save_model(model, spark, path)
    with pytest.raises(ValueError, match="hooks"):
        load_model(spark, path)
    again = load_model(spark, path, {"tiles": tiles, "median": np.median})
    assert (again.depth, again.th1, again.th2, again.emit, again.dims) == (model.depth, 0.05, 0.001, "all", model.dims)
    for get in (lambda m: m.kernels(spark), lambda m: m.nodes(spark), lambda m: m.dc(df),
                lambda m: m.transform(df), lambda m: m.features(df)):
        a, b = get(model), get(again)
        assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    with pytest.raises(Exception):
        save_model(model, spark, path)
    save_model(model, spark, path, mode="overwrite")


def test_scoring_a_stream(spark):
    x = smooth(np.random.default_rng(6), 20, 6, 6, 1)
    path = scratch_path(spark, "test-stream")
    images(spark, x).write.parquet(path)
    batch = spark.read.parquet(path)
    model = SubspaceEstimator([HopSpec(2, 1)]).fit(batch)
    stream = spark.readStream.schema(batch.schema).parquet(path)
    run = model.transform(stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got, want = spark.table("scored"), model.transform(batch)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_fit_counts_scans_not_channels(spark):
    """The number of Spark jobs of a fit does not grow with the number of channels."""
    def jobs(channels, tag):
        df = images(spark, smooth(np.random.default_rng(7), 12, 6, 6, channels), 2).cache()
        df.count()
        spark.sparkContext.setJobGroup(tag, tag)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            SubspaceEstimator([HopSpec(2, 1, channelwise=True), HopSpec(2, 1)], th1=1e-6, th2=0).fit(df)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
        spark.sparkContext.setJobGroup("", "")
        return found

    assert jobs(1, "few") == jobs(6, "many")


def test_output_types(spark):
    for shape in ((8, 8, 1), (1, 1, 5)):
        df = images(spark, smooth(np.random.default_rng(8), 30, *shape))
        model = SubspaceEstimator([HopSpec(min(2, shape[0]), 1)]).fit(df)
        for get, column in ((model.transform_maps, "v"), (model.features, "features")):
            a, b = get(df, "all"), get(df, "all", dtype="float")
            assert (a.schema[column].dataType.simpleString(), b.schema[column].dataType.simpleString()) == ("array<double>", "array<float>")
            keys = [c for c in ("image_id", "channel") if c in a.columns]
            x, y = ([r[column] for r in f.orderBy(*keys).collect()] for f in (a, b))
            np.testing.assert_allclose(x, y, rtol=1e-6, atol=1e-6)
        with pytest.raises(ValueError, match="select"):
            model.features(df, "some")


def test_features_feed_an_ml_estimator(spark):
    from pyspark.ml.classification import LogisticRegression

    from eigenloom.operators.channels import as_vector

    rng = np.random.default_rng(9)
    x = smooth(rng, 60, 6, 6, 1)
    x[:30, :, :3] += 3.0
    df = images(spark, x).selectExpr("*", "int(image_id >= 30) AS label")
    model = SubspaceEstimator([HopSpec(2, 2)], th2=0.0).fit(df)
    data = as_vector(model.features(df, "all", keep=("label",)))
    fitted = LogisticRegression(maxIter=20).fit(data)
    assert fitted.transform(data).filter("prediction = label").count() >= 55


def test_empty_selection(spark):
    for shape in ((4, 4, 1), (1, 1, 3)):
        df = images(spark, smooth(np.random.default_rng(10), 12, *shape))
        model = SubspaceEstimator([HopSpec(min(2, shape[0]), 1)], th2=2.0).fit(df)
        assert model.transform(df).count() == 0
        assert [r.features for r in model.features(df).collect()] == [[]] * 12
