"""Fits and scores against the two-pass model."""

import numpy as np
import pytest
from helpers import images, maps_array, smooth
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from plain import node as plain_node
from plain import patches as plain_patches
from plain import tree as plain_tree

from eigenloom import HopSpec, SubspaceEstimator
from eigenloom.functions import blocks as B
from eigenloom.operators.kernels import node_kernels

DEMO_SLIDE = [HopSpec(2, 1), HopSpec(2, 1, need_bias=True)]
DEMO_TILE = [HopSpec(2, 2), HopSpec(2, 2, need_bias=True)]
CASES = {
    "slide": ((30, 8, 8, 1), DEMO_SLIDE, 0.05, 0.01),
    "tile": ((40, 8, 8, 1), DEMO_TILE, 0.005, 0.001),
    "both biased": ((30, 8, 8, 1), [HopSpec(2, 1, need_bias=True)] * 2, 0.1, 0.01),
    "colour 5x5 pooled": ((25, 16, 16, 3), [HopSpec(5, 1, pool_after=2, ddof=0)] * 2, 0.02, 0.0005),
    "three hops": ((20, 10, 10, 1), [HopSpec(2, 1, need_bias=True)] * 3, 0.1, 0.01),
    "channel-wise": ((25, 8, 8, 3), [HopSpec(2, 1, channelwise=True, need_bias=True), HopSpec(2, 1)], 0.2, 0.01),
    "no dc": ((25, 7, 7, 2), [HopSpec(2, 1, use_dc=False, need_bias=True), HopSpec(2, 1, use_dc=False)], 0.1, 0.01),
    "ragged max": ((25, 8, 8, 1), [HopSpec(2, 1, pool_after=2, need_bias=True)] * 2, 0.1, 0.01),
    "ragged drop": ((25, 8, 8, 1), [HopSpec(2, 1, pool_after=2, ragged="drop", need_bias=True)] * 2, 0.1, 0.01),
    "sum before": ((25, 9, 9, 1), [HopSpec(2, 1, need_bias=True),
                                   HopSpec(2, 1, pool_before=2, pool_fn="sum", need_bias=True)], 0.1, 0.01),
    "avg, min": ((25, 9, 9, 1), [HopSpec(2, 1, pool_after=2, pool_fn="avg", need_bias=True),
                                 HopSpec(2, 1, pool_before=2, pool_fn="min")], 0.1, 0.01),
    "own reducer": ((25, 9, 9, 1), [HopSpec(2, 1, pool_after=2, pool_fn=np.median, need_bias=True), HopSpec(2, 1)], 0.1, 0.01),
    "few kernels": ((25, 8, 8, 2), [HopSpec(3, 2, num_kernels=4), HopSpec(2, 1, num_kernels=2)], 0.02, 0.0),
    "cij": ((25, 8, 8, 3), [HopSpec(2, 2, order="cij"), HopSpec(2, 2, need_bias=True)], 0.05, 0.01),
}


@pytest.mark.parametrize("name", CASES)
def test_tree_matches_two_pass_model(spark, name):
    shape, specs, th1, th2 = CASES[name]
    x = smooth(np.random.default_rng(1), *shape)
    df = images(spark, x)
    model = SubspaceEstimator(specs, th1=th1, th2=th2).fit(df)
    want = plain_tree(x, [h["spec"] for h in model.tree], th1, th2)
    assert model.depth == len(want)
    every, dc = model.transform_maps(df, "all").cache(), model.dc(df).cache()
    emitted = model.transform(df).groupBy("hop", "channel").count().collect()
    assert {r["count"] for r in emitted} <= {len(x)}
    for h, hop in enumerate(want):
        got = model.tree[h]["nodes"]
        np.testing.assert_allclose([r["energy"] for n in got for r in n["rows"]], hop["energy"], atol=1e-10)
        assert [r["role"] for n in got for r in n["rows"]] == list(hop["role"])
        for g, w in zip(got, hop["nodes"]):
            np.testing.assert_allclose(g["mean"], w["mean"], atol=1e-9)
            np.testing.assert_allclose(g["weights"], w["kernels"], atol=1e-7)
            np.testing.assert_allclose(g["bias"], w["bias"], atol=1e-9)
            np.testing.assert_allclose(g["dc_energy"], w["dc_energy"], rtol=1e-9)
        values, channels = maps_array(every, h)
        assert channels == list(range(values.shape[-1]))
        np.testing.assert_allclose(values, hop["maps"], atol=1e-6)
        assert sorted(r.channel for r in emitted if r.hop == h) == list(np.flatnonzero(hop["role"] == "emit"))
        for i, d in enumerate(hop["dc"]):
            rows = dc.filter(f"hop = {h} and node = {i}").orderBy("image_id").collect()
            np.testing.assert_allclose([r.v for r in rows], d.reshape(len(x), -1), atol=1e-8)
    wide = np.array([r.features for r in model.features(df).orderBy("image_id").collect()])
    flat = [maps_array(every, h)[0][..., hop["role"] == "emit"].transpose(0, 3, 1, 2).reshape(len(x), -1)
            for h, hop in enumerate(want) if (hop["role"] == "emit").any()]
    np.testing.assert_allclose(wide, np.concatenate(flat, axis=1), atol=1e-9)


def random_tree(rng):
    """Random settings; with K = 2 the sign of the second kernel is arbitrary, so that is left out."""
    h, w, c = rng.integers(6, 12), rng.integers(6, 12), int(rng.choice([1, 3]))
    specs = [
        HopSpec(
            window=int(rng.integers(1, 4)), stride=int(rng.integers(1, 3)), pool_before=int(rng.choice([0, 0, 2])),
            pool_after=int(rng.choice([0, 0, 2, 3])), pool_fn=str(rng.choice(["max", "min", "avg", "sum"])),
            ragged=str(rng.choice(["pad", "drop"])), channelwise=i > 0 or bool(rng.integers(2)),
            use_dc=bool(rng.integers(2)), need_bias=bool(rng.integers(2)), num_kernels=int(rng.choice([-1, -1, 3])),
            ddof=int(rng.integers(2)), order=str(rng.choice(["ijc", "cij"])),
        )
        for i in range(rng.integers(1, 4))
    ]
    return smooth(rng, int(rng.integers(20, 40)), h, w, c), specs, float(rng.choice([0.02, 0.1, 0.2]))


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("seed", range(24))
def test_random_trees_match_two_pass_model(spark, seed):
    rng = np.random.default_rng(seed)
    x, specs, th1 = random_tree(rng)
    df = images(spark, x, int(rng.integers(1, 5)))
    try:
        want = plain_tree(x, specs, th1, 0.001)
        assert min(min(hop["maps"].shape) for hop in want) > 0
    except (AssertionError, ValueError):
        with pytest.raises(ValueError, match="smaller than the"):
            SubspaceEstimator(specs, th1=th1).fit(df)
        return
    model = SubspaceEstimator(specs, th1=th1, th2=0.001).fit(df)
    assert model.depth == len(want)
    every = model.transform_maps(df, "all").cache()
    for h, hop in enumerate(want):
        values, first = maps_array(every, h)[0], 0
        for g, w in zip(model.tree[h]["nodes"], hop["nodes"]):
            np.testing.assert_allclose(g["mean"], w["mean"], atol=1e-7)
            np.testing.assert_allclose(g["bias"], w["bias"], atol=1e-7)
            for q, e in enumerate(w["energy"]):
                alone = np.abs(np.delete(w["energy"], q) - e).min(initial=1.0) > 1e-6
                if alone and e > 1e-8:  # where eigenvalues meet, the kernels are not unique
                    np.testing.assert_allclose(values[..., first + q], hop["maps"][..., first + q], atol=1e-5)
            first += len(w["energy"])
        np.testing.assert_allclose([r["energy"] for g in model.tree[h]["nodes"] for r in g["rows"]], hop["energy"], atol=1e-9)
    every.unpersist()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_result_does_not_depend_on_partitions(spark, parts):
    x = smooth(np.random.default_rng(2), 50, 8, 8, 1)
    base = SubspaceEstimator(DEMO_SLIDE, th1=0.1, th2=0.01).fit(images(spark, x, 3))
    model = SubspaceEstimator(DEMO_SLIDE, th1=0.1, th2=0.01).fit(images(spark, x, parts))
    for a, b in zip(base.tree, model.tree):
        for p, q in zip(a["nodes"], b["nodes"]):
            np.testing.assert_allclose(p["weights"], q["weights"], atol=1e-9)
            np.testing.assert_allclose(p["mean"], q["mean"], atol=1e-9)
            assert p["bias"] == pytest.approx(q["bias"], abs=1e-9)


def test_short_vectors_agree_with_the_arrow_pass(spark, monkeypatch):
    from eigenloom.operators import vectors as V

    x = smooth(np.random.default_rng(3), 60, 1, 1, 5)
    df, est = images(spark, x), SubspaceEstimator([HopSpec(1, 1, need_bias=True)])
    fast = est.fit(df)
    assert fast.vectors
    monkeypatch.setattr(V, "MAX_K", 0)
    slow = est.fit(df)
    assert not slow.vectors
    for name in ("weights", "mean", "bias"):
        np.testing.assert_allclose(fast.tree[0]["nodes"][0][name], slow.tree[0]["nodes"][0][name], atol=1e-10)
    for get in (lambda m: m.features(df, "all"), lambda m: m.dc(df).select("image_id", "v")):
        a, b = (np.array([r[1] for r in get(m).orderBy("image_id").collect()]) for m in (fast, slow))
        np.testing.assert_allclose(a, b, atol=1e-9)
    a, b = (maps_array(m.transform_maps(df, "all"), 0)[0] for m in (fast, slow))
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_branches_without_output_are_not_computed(spark):
    from eigenloom.operators import hops as H
    from eigenloom.operators import trees as T

    x = smooth(np.random.default_rng(7), 20, 9, 9, 2)
    df = images(spark, x)
    model = SubspaceEstimator([HopSpec(2, 1, channelwise=True)] + [HopSpec(2, 1)] * 2, th1=0.08, th2=0.06).fit(df)
    full = T.slim(model.tree, "emit")
    part = T.lineages(full, H.gives)[0]
    count = lambda tree: sum(len(n["forward"]) for hop in tree for n in hop["nodes"])
    assert count(part) < count(full)
    every = {(r.image_id, r.hop, r.channel): r.v for r in model.transform_maps(df, "all").collect()}
    some = model.transform(df).collect()
    want = {(h, n["first"] + q) for h, hop in enumerate(model.tree) for n in hop["nodes"] for q in n["emit"]}
    assert {(r.hop, r.channel) for r in some} == want and len(some) == 20 * len(want)
    for r in some:
        np.testing.assert_allclose(r.v, every[r.image_id, r.hop, r.channel], atol=1e-9)


def test_all_pixel_types_and_a_pipeline(spark):
    from pyspark.ml import Pipeline

    rng = np.random.default_rng(4)
    x = rng.integers(0, 17, size=(40, 8, 8, 1))
    est = SubspaceEstimator(DEMO_TILE)
    results = []
    for kind in (np.float64, np.float32, np.int32, np.uint8):
        df = images(spark, x.astype(kind).astype(np.int16) if kind is np.uint8 else x.astype(kind))
        fitted = Pipeline(stages=[est]).fit(df)
        results.append(maps_array(fitted.transform(df), 1)[0])
    for other in results[1:]:
        np.testing.assert_allclose(results[0], other, atol=1e-9)


def test_small_chunks_change_nothing(spark, monkeypatch):
    """One image row per chunk, one image per batch, one node per frame."""
    from eigenloom.operators import hops as H
    from eigenloom.operators import packed as PK

    x = smooth(np.random.default_rng(5), 12, 9, 9, 2)
    df, est = images(spark, x), SubspaceEstimator([HopSpec(3, 1, need_bias=True), HopSpec(2, 1)], th1=0.05, th2=0.001)
    whole = est.fit(df)
    want = maps_array(whole.transform_maps(df, "all"), 1)[0]
    monkeypatch.setattr(B, "CHUNK_BYTES", 1)
    monkeypatch.setattr(H, "BATCH_BYTES", 1)
    monkeypatch.setattr(H, "STATE_BYTES", 1)
    monkeypatch.setattr(PK, "SENT_VALUES", 3)
    monkeypatch.setattr(PK, "HELD_VALUES", 3)
    model = est.fit(df)
    np.testing.assert_allclose(maps_array(model.transform_maps(df, "all"), 1)[0], want, atol=1e-8)


@pytest.mark.parametrize("channelwise", [False, True])
def test_a_tree_in_parts_changes_nothing(spark, monkeypatch, channelwise):
    """Kernels too large for one task travel as several lineages."""
    from eigenloom.operators import hops as H
    from eigenloom.operators import trees as T
    from eigenloom.operators import project as E

    x = smooth(np.random.default_rng(6), 15, 9, 9, 2)
    specs = [HopSpec(2, 1, channelwise=channelwise, need_bias=True), HopSpec(2, 1, need_bias=True), HopSpec(2, 1, need_bias=True)]
    df, est = images(spark, x), SubspaceEstimator(specs, th1=0.03, th2=0.001, emit="all")
    whole = est.fit(df)
    assert len(whole.tree) == 3 and len(whole.tree[2]["nodes"]) > 2 and len(T.lineages(T.slim(whole.tree))) == 1

    def outputs(model):
        maps = {s: sorted(map(tuple, model.transform_maps(df, s).select("image_id", "hop", "channel", "v").collect()))
                for s in ("emit", "forward", "all")}
        dc = sorted(map(tuple, model.dc(df).collect()))
        wide = model.features(df.withColumn("tag", df.image_id * 2), keep=("tag",))
        coef = E.coefficients(df, model.tree, model.dims, 2, 1).collect()
        return [*maps.values(), dc, sorted(map(tuple, wide.collect())), sorted(map(tuple, coef))]

    want = outputs(whole)
    monkeypatch.setattr(T, "MODEL_BYTES", 1)
    parts = est.fit(df)
    assert len(T.lineages(T.slim(parts.tree))) == len(parts.tree[2]["nodes"])
    for a, b in zip(whole.tree, parts.tree):
        for p, q in zip(a["nodes"], b["nodes"]):
            np.testing.assert_allclose(p["weights"], q["weights"], atol=1e-9)
            assert p["bias"] == pytest.approx(q["bias"], abs=1e-9)
    parts.tree = whole.tree
    for a, b in zip(want, outputs(parts)):
        assert [r[:-1] for r in a] == [r[:-1] for r in b]
        for r, t in zip(a, b):
            np.testing.assert_allclose(r[-1], t[-1], atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(
    x=hnp.arrays(np.float64, hnp.array_shapes(min_dims=2, max_dims=2, min_side=1, max_side=9),
                 elements=st.floats(-100, 100, width=32)),
    use_dc=st.booleans(), ddof=st.sampled_from([0, 1]), keep=st.sampled_from([-1, 1, 2]),
)
def test_one_pass_sums_give_the_two_pass_node(x, use_dc, ddof, keep):
    spec = HopSpec(use_dc=use_dc, ddof=ddof, num_kernels=keep)
    shift = x[0]
    y = x - shift
    got = node_kernels(len(x), y.sum(axis=0), y.T @ y, shift, spec)
    want = plain_node(x, spec)
    scale = 1 + np.abs(x).max() ** 2
    assert np.isfinite(got["weights"]).all() and np.isfinite(got["energy"]).all()
    np.testing.assert_allclose(got["mean"], want["mean"], atol=1e-9 * scale)
    np.testing.assert_allclose(got["dc_energy"], want["dc_energy"], atol=1e-9 * scale)
    if want["energy"].sum() > 0 and want["dc_energy"] > 1e-6 and np.var(x) > 1e-3:
        np.testing.assert_allclose(got["energy"], want["energy"], atol=1e-6)
    assert (np.diff(got["energy"][1 if got["use_dc"] else 0 :]) <= 1e-12).all()


@settings(max_examples=60, deadline=None)
@given(
    n=st.integers(1, 3), h=st.integers(1, 9), w=st.integers(1, 9), c=st.integers(1, 3), win=st.integers(1, 4),
    stride=st.integers(1, 3), order=st.sampled_from(["ijc", "cij"]), chunk=st.sampled_from([1, 400, 1 << 20]),
)
def test_patch_chunks_cover_every_patch_once(n, h, w, c, win, stride, order, chunk):
    if win > min(h, w):
        return
    x = np.random.default_rng(0).normal(size=(n, h, w, c))
    want = plain_patches(x, win, stride, order)
    got = np.full(want.shape, np.nan)
    old, B.CHUNK_BYTES = B.CHUNK_BYTES, chunk
    try:
        for im, rows, cols in B.patch_chunks(np.ascontiguousarray(x.transpose(3, 0, 1, 2)), HopSpec(win, stride, order=order)):
            got[im, rows] = cols.T.reshape(im.stop - im.start, rows.stop - rows.start, *want.shape[2:])
    finally:
        B.CHUNK_BYTES = old
    np.testing.assert_array_equal(got, want)
