"""Stored maps between hops: the same model, fewer hop passes, and a fit that goes on where it was interrupted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenloom import HopSpec, SubspaceEstimator
from eigenloom.operators import channels as C
from eigenloom.operators import hops as H
from eigenloom.plans import stages as ST
from eigenloom.plans.queries import tiles
from eigenloom.plans.steps import fit_channelwise, fit_joint
from eigenloom.sources.complete import complete_table, mark, marker
from tests.helpers import images, smooth

DEEP = [HopSpec(2, 1, need_bias=True), HopSpec(2, 1), HopSpec(2, 1, pool_after=2, need_bias=True), HopSpec(2, 1, need_bias=True)]


def data(spark, n=25):
    return images(spark, smooth(np.random.default_rng(8), n, 9, 9, 2))


def estimator(**kw):
    return SubspaceEstimator(DEEP, th1=0.02, th2=0.001, **kw)


def same_model(a, b):
    assert [len(h["nodes"]) for h in a.tree] == [len(h["nodes"]) for h in b.tree]
    for one, two in zip(a.tree, b.tree):
        for m, n in zip(one["nodes"], two["nodes"]):
            np.testing.assert_allclose(m["weights"], n["weights"], atol=1e-7)
            np.testing.assert_allclose(m["mean"], n["mean"], atol=1e-8)
            assert m["bias"] == pytest.approx(n["bias"], abs=1e-8)
            assert [r["role"] for r in m["rows"]] == [r["role"] for r in n["rows"]]


def test_four_hops_both_ways(spark, tmp_path):
    df = data(spark)
    again = estimator(maps="recompute").fit(df)
    kept = estimator(maps="stored", store=f"{tmp_path}/fit").fit(df)
    assert kept.depth == again.depth == 4
    same_model(again, kept)
    assert again.passes == [("sums", 1), ("sums", 2), ("sums", 3), ("sums", 4), ("bias", 4)]
    assert all(hops == 1 for _, hops in kept.passes)
    assert [what for what, _ in kept.passes] == ["sums", "bias", "write", "sums", "write", "sums", "bias", "write", "sums", "bias"]
    a, b = ({(r.image_id, r.hop, r.channel): r.v for r in m.transform(df).collect()} for m in (again, kept))
    assert a.keys() == b.keys()
    assert max(np.abs(np.array(a[k]) - b[k]).max() for k in a) < 1e-6


def test_an_interrupted_fit_goes_on(spark, tmp_path, monkeypatch):
    df, path = data(spark), f"{tmp_path}/fit"
    whole = estimator(maps="recompute").fit(df)
    calls, sums = [], H.image_stats

    def breaks(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the driver is lost")
        return sums(*args)

    monkeypatch.setattr(H, "image_stats", breaks)
    with pytest.raises(RuntimeError):
        estimator(maps="stored", store=path).fit(df)
    monkeypatch.setattr(H, "image_stats", sums)
    resumed = estimator(maps="stored", store=path).fit(df)
    same_model(whole, resumed)
    assert [what for what, _ in resumed.passes] == ["sums", "bias", "write", "sums", "bias"]  # hops 0 and 1 were there
    done = estimator(maps="stored", store=path).fit(df)
    same_model(whole, done)
    assert [what for what, _ in done.passes] == ["sums", "bias"]  # the last hop is never stored


def test_a_half_written_hop_or_other_settings_are_not_used(spark, tmp_path):
    df, path = data(spark), f"{tmp_path}/fit"
    first = estimator(maps="stored", store=path).fit(df)
    mark(spark, f"{path}/hop2", "")
    again = estimator(maps="stored", store=path).fit(df)
    assert [what for what, _ in again.passes] == ["sums", "bias", "write", "sums", "bias"]
    same_model(first, again)
    other = SubspaceEstimator(DEEP, th1=0.03, th2=0.001, maps="stored", store=path).fit(df)
    same_model(SubspaceEstimator(DEEP, th1=0.03, th2=0.001).fit(df), other)


def test_own_functions_are_taken_up_again(spark, tmp_path):
    df, path = data(spark), f"{tmp_path}/fit"
    est = SubspaceEstimator([HopSpec(patch_fn=tiles), HopSpec(2, 1)], th1=0.02, th2=0.001, maps="stored", store=path)
    same_model(est.fit(df), est.fit(df))
    assert est.fit(df).passes == [("sums", 1)]


def test_the_choice_weighs_depth_and_bytes(spark, tmp_path):
    model = estimator(maps="recompute").fit(data(spark))
    tree = ST.T.slim(model.tree[:1])
    assert not ST.worth_storing(tree, (9, 9, 2), (8, 8, 3), 1, False, False)  # one hop left: nothing to save
    heavy = [{**tree[0], "nodes": [{**n, "weights": np.ones((64, 4096)), "out": (8, 8), "forward": list(range(3))} for n in tree[0]["nodes"]]}]
    assert ST.worth_storing(heavy, (9, 9, 2), (8, 8, 3), 3, True, True)
    assert not ST.worth_storing(heavy, (9, 9, 2), (800, 800, 30), 3, True, True)  # the maps are too large
    auto = estimator(store=f"{tmp_path}/auto").fit(data(spark))
    same_model(model, auto)
    with pytest.raises(ValueError):
        estimator(maps="stored")


def test_malformed_images_are_reported_before_anything_is_stored(spark, tmp_path):
    df = data(spark).unionByName(data(spark, 1).withColumn("height", F.lit(5)))
    with pytest.raises(ValueError):
        estimator(maps="stored", store=f"{tmp_path}/fit").fit(df)
    assert marker(spark, f"{tmp_path}/fit/hop0") is None


def test_complete_tables(spark, tmp_path):
    path, seen = f"{tmp_path}/t", spark.sparkContext.accumulator(0)

    def count(it):
        for batch in it:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(10).mapInArrow(count, "id long")
    assert complete_table(df, path, "a").count() == 10 and seen.value == 10
    assert complete_table(df, path, "a").count() == 10 and seen.value == 10  # found complete
    assert complete_table(df.filter("id < 4"), path, "b").count() == 4
    assert marker(spark, path) == "b" and marker(spark, f"{tmp_path}/nowhere") is None


@pytest.mark.parametrize("stored,passes", [(False, 4), (True, 2)])
def test_step_interface_computes_hop_0_once(spark, tmp_path, stored, passes):
    """Images that went through hop 0: by its own fit, then once to store its maps, or else by every later pass."""
    df, n, seen = data(spark, 12), 12, spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(len(x))
        return tiles(x)

    kernels, maps, _ = fit_joint(df, spec=HopSpec(patch_fn=counted, ddof=0))
    forward, fk, *_ = C.filter_channels(maps, kernels, 0.05, 0.001)
    energy = {r.channel: r.energy for r in fk.collect()}
    new, out, _ = fit_channelwise(forward, energy, HopSpec(2, 1, ddof=0, need_bias=True), store=f"{tmp_path}/maps" if stored else None)
    assert out.count() == n * new.count() > 0
    driver = 3  # the look at the first image and its shape, and what head(1) reads ahead
    assert passes * n <= seen.value <= (passes + driver) * n
