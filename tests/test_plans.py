"""The plans that matter at scale: what is read, what is shuffled, what stays in generated code."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenloom import HopSpec, SubspaceEstimator
from eigenloom.operators import channels as C
from eigenloom.operators import hops as H
from eigenloom.operators import patches as PT
from eigenloom.operators import prepare as A
from eigenloom.operators import stats as S
from eigenloom.operators import vectors as V
from eigenloom.plans.queries import GREY, SLIDE, grey, items, two_hops

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def read_columns(text: str) -> list[set[str]]:
    return [{f.split(":")[0] for f in line.split("ReadSchema: struct<")[1].rstrip(">").split(",") if ":" in f}
            for line in text.splitlines() if "ReadSchema: struct<" in line]


def test_scoring_is_one_narrow_stage(spark):
    images, model = two_hops(spark, SF)
    for df in (model.transform(images), model.features(images), model.dc(images), PT.patch_table(images, GREY, SLIDE),
               C.pool_maps(model.transform(images), 2), C.split_channels(images, GREY)):
        text = plan(df)
        assert "Exchange" not in text and "BatchEvalPython" not in text
        assert read_columns(text) == [{"vec_id", "embedding"}]
    assert read_columns(plan(model.features(images, keep=("label",)))) == [{"vec_id", "embedding", "label"}]


def test_filters_reach_the_files(spark):
    images, model = two_hops(spark, SF)
    text = plan(model.transform(images.filter("label = 3 and image_id > 10")))
    assert "EqualTo(label,3)" in text and "GreaterThan(vec_id,10)" in text


def test_channel_choice_is_a_broadcast(spark):
    images, model = two_hops(spark, SF)
    text = plan(C.select_channels(model.transform_maps(images, "all"), model.kernels(spark), "emit"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_sums_travel_packed(spark):
    """One exchange of whole lines, added without exploding them; a task sends K + 1 records for each node."""
    images = grey(spark, SF)
    text = plan(H.image_stats(images, [], SLIDE, np.zeros((1, 4)), GREY))
    assert text.count("Exchange") == 1 and "hashpartitioning(node" in text and "Generate" not in text and "partial_sum" not in text
    for spec, nodes, k in ((SLIDE, 1, 4), (HopSpec(window=5), 1, 25)):
        partial = H._partial_sums(H.image_columns(images.repartition(6)), [], spec, np.zeros((nodes, k)), GREY, range(nodes))
        assert partial.count() == 6 * nodes * (k + 1)


def test_short_vectors_never_leave_the_jvm(spark):
    vectors = items(spark, SF)
    model = SubspaceEstimator([HopSpec(1, 1)]).fit(vectors)
    for df in (V.vector_stats(vectors, np.zeros(3)), model.features(vectors), model.transform(vectors), model.dc(vectors)):
        text = plan(df)
        assert "InArrow" not in text and "InPandas" not in text
    assert read_columns(plan(V.vector_stats(vectors, np.zeros(3)))) == [{"l_quantity", "l_discount", "l_tax"}]
    assert "Exchange" not in plan(model.features(vectors))


def test_subset_is_a_filter(spark):
    text = plan(A.subset_exact(grey(spark, SF), "image_id", n=100))
    assert "Exchange" not in text and "Sort" not in text


def test_shuffle_moves_the_rows_once_by_bucket(spark):
    text = plan(A.shuffle_rows(grey(spark, SF), "image_id"))
    above_pixels = text[: text.index("ReadSchema: struct<vec_id:bigint,embedding")]
    assert above_pixels.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in text
    assert {"vec_id"} in read_columns(text)  # bucket sizes come from the ids alone


def test_parity_counts_per_key_first(spark):
    ids = grey(spark, SF).select("image_id")
    text = plan(A.parity(ids, ids, "image_id"))
    assert "Join" not in text and "partial_sum" in text[text.index("Exchange hashpartitioning"):]


def test_row_statistics_need_no_patch_shuffle(spark):
    patches = PT.patch_table(grey(spark, SF), GREY, HopSpec(3, 1))
    text = plan(S.row_stats(patches, 9))
    assert text.count("Exchange") == 1 and "Exchange SinglePartition" in text and "partial_sum" in text


def test_nothing_caches_or_checkpoints():
    """Every pass starts from the source, so there is nothing to lose with an executor."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "eigenloom")
    for folder, _, files in os.walk(root):
        for name in files:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                assert not any(w in text for w in (".cache()", ".persist(", "localCheckpoint", ".rdd", "crossJoin", ".toPandas()"))


def test_columns_are_typed_as_documented(spark):
    images, model = two_hops(spark, SF)
    assert model.transform(images).schema.simpleString() == (
        "struct<image_id:bigint,hop:int,channel:int,height:int,width:int,v:array<double>>")
    assert model.kernels(spark).schema.simpleString() == (
        "struct<hop:int,node:int,kidx:int,channel:int,is_dc:boolean,weights:array<double>,"
        "local_energy:double,energy:double,role:string>")
    assert model.kernels(spark).filter(F.col("energy").isNull()).count() == 0
