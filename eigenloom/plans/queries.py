"""The registered queries: every operator on whole tables, with long, rounded results."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import channels as C
from ..operators import hops as H
from ..operators import kernels as K
from ..operators import patches as PT
from ..operators import prepare as A
from ..operators import project as E
from ..operators import stats as S
from ..sources import images as I
from ..sources.models import load_model, save_model
from ..sources.scratch import scratch_path
from ..spec import HopSpec
from . import oracle as Q
from .estimator import SubspaceEstimator
from .steps import fit_channelwise, fit_joint

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

GREY, COLOUR = (8, 8, 1), (4, 4, 4)  # the 64 values of an embedding read as an image
TILE, SLIDE = HopSpec(window=2, stride=2), HopSpec(window=2, stride=1)
TH1, TH2 = 0.2515, 0.0495  # gives all three roles on the sliding two-hop tree
MEAN, STD = (*P.COLOUR_MEAN, 0.5), (*P.COLOUR_STD, 0.25)  # the views have four channels


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def num(value: str | Column, digits: int = 6) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grey(spark, sf) -> DataFrame:
    return I.as_images(table(spark, sf, "embeddings"), "vec_id", F.col("embedding"), GREY, "label")


def colour(spark, sf) -> DataFrame:
    return I.as_images(table(spark, sf, "embeddings"), "vec_id", F.col("embedding"), COLOUR, "label")


def items(spark, sf) -> DataFrame:
    """Three numeric columns of every line item as vectors."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return I.vectors_from_columns(table(spark, sf, "lineitem"), key, ["l_quantity", "l_discount", "l_tax"])


def flat(df: DataFrame, column: str = "pixels", digits: int = 6) -> DataFrame:
    long = df.select("image_id", F.posexplode(column).alias("pos", "v"))
    return long.select("image_id", "pos", num("v", digits).alias("value"))


def cells(maps: DataFrame, *keys: str, digits: int = 5) -> DataFrame:
    """Maps in long form: ``image_id, keys, r, c, value``."""
    long = maps.select("image_id", *keys, "width", F.posexplode("v").alias("p", "x"))
    row, col = F.floor(F.col("p") / F.col("width")).cast("int"), (F.col("p") % F.col("width")).cast("int")
    return long.select("image_id", *keys, row.alias("r"), col.alias("c"), num("x", digits).alias("value"))


def weights(kernels: DataFrame, *keys: str) -> DataFrame:
    long = kernels.select(*keys, F.posexplode("weights").alias("i", "w"))
    return long.select(*keys, "i", num("w").alias("value"))


def pixel_sql(h, w, c) -> str:
    return Q.with_(Q.IMG, Q.pixels(h, w, c))


FLAT64 = f"SELECT image_id, CAST(k AS INT) AS pos, {{}} AS value FROM img, range(64) t(k)"

# ---- sources and preparation ----


@query(Q.with_(Q.IMG) + "SELECT image_id, label, 8 AS height, 8 AS width, 1 AS channels, CAST(k AS INT) AS pos, "
       f"{Q.r('p[k + 1]')} AS value FROM img, range(64) t(k)")
def image_scan(spark, sf):
    df = grey(spark, sf).select("image_id", "label", "height", "width", "channels", F.posexplode("pixels").alias("pos", "v"))
    return df.withColumn("value", num("v")).drop("v")


@query(Q.with_(Q.IMG) + "SELECT CASE WHEN label < 8 THEN 'train' ELSE 'test' END AS split, image_id, "
       f"{Q.r('list_sum(p)')} AS total FROM img")
def image_sink(spark, sf):
    path = scratch_path(spark, "images")
    split = F.when(F.col("label") < 8, "train").otherwise("test")
    I.write_images(grey(spark, sf).withColumn("split", split), path)
    parts = [I.read_images(spark, path, s).withColumn("split", F.lit(s)) for s in ("train", "test")]
    return C.concat_hops(parts).select("split", "image_id", num(P.total(F.col("pixels"))).alias("total"))


@query(Q.with_(Q.IMG) + f"SELECT image_id, {Q.r('list_sum(p)')} AS total FROM img")
def image_distribute(spark, sf):
    return I.distribute(grey(spark, sf), 16).select("image_id", num(P.total(F.col("pixels"))).alias("total"))


@query(Q.with_(Q.IMG) + FLAT64.format(
    Q.r(f"(p[k + 1] / 255.0 - ([{', '.join(map(str, MEAN))}])[k % 4 + 1]) / ([{', '.join(map(str, STD))}])[k % 4 + 1]")))
def channel_normalise(spark, sf):
    return flat(colour(spark, sf).withColumn("pixels", P.channel_normalise(F.col("pixels"), MEAN, STD)))


@query(pixel_sql(*GREY) + "SELECT g.image_id, CAST(g.y * 12 + g.x AS INT) AS pos, "
       f"{Q.r('coalesce(px.v, 0)')} AS value FROM (SELECT image_id, y, x FROM img, range(12) a(y), range(12) b(x)) g "
       "LEFT JOIN px ON px.image_id = g.image_id AND px.r = g.y - 2 AND px.c = g.x - 2")
def pad_border(spark, sf):
    return flat(grey(spark, sf).withColumn("pixels", P.pad(F.col("pixels"), *GREY, 2)))


@query(Q.with_(Q.IMG) + FLAT64.format(Q.r("p[(k % 4) * 16 + k // 4 + 1]")))
def channel_last(spark, sf):
    return flat(colour(spark, sf).withColumn("pixels", P.channel_last(F.col("pixels"), *COLOUR)))


@query(Q.with_(Q.IMG) + FLAT64.format(Q.r("p[(k % 16) * 4 + k // 16 + 1]")))
def channel_first(spark, sf):
    return flat(colour(spark, sf).withColumn("pixels", P.channel_first(F.col("pixels"), *COLOUR)))


@query("SELECT 8 AS height, 8 AS width, 1 AS channels, count(*) AS n, "
       "count(*) FILTER (WHERE len(embedding) <> 64 OR embedding IS NULL) AS broken FROM embeddings")
def shape_audit(spark, sf):
    return A.shape_audit(grey(spark, sf))


@query("SELECT count(d.k) FILTER (WHERE l.k IS NOT NULL) AS n_both, count(*) FILTER (WHERE l.k IS NULL) AS n_left_only, "
       "count(*) FILTER (WHERE d.k IS NULL) AS n_right_only, coalesce(sum(d.n), 0)::BIGINT AS n_left_rows, "
       "coalesce(sum(l.n), 0)::BIGINT AS n_right_rows FROM (SELECT doc_id AS k, count(*) AS n FROM documents GROUP BY 1) d "
       "FULL JOIN (SELECT doc_id AS k, count(*) AS n FROM labels GROUP BY 1) l ON d.k = l.k")
def label_parity(spark, sf):
    return A.parity(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT 4 AS height, 4 AS width, 4 AS channels, count(*) AS n FROM embeddings")
def one_shape(spark, sf):
    """The shape that all images share; mixed shapes are an error."""
    images = colour(spark, sf)
    shape = zip(("height", "width", "channels"), A.require_one_shape(images))
    return images.agg(F.count(F.lit(1)).alias("n")).select(*[F.lit(v).alias(name) for name, v in shape], "n")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_missing(spark, sf):
    return A.unmatched(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "n_chars")


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':7'), o_orderkey "
       "LIMIT (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) FROM orders)")
def subset_exact(spark, sf):
    return A.subset_exact(table(spark, sf, "orders"), "o_orderkey", fraction=0.3, seed=7).select("o_orderkey")


@query("SELECT vec_id AS image_id, row_number() OVER (ORDER BY md5(vec_id || ':11'), vec_id) - 1 AS position FROM embeddings")
def shuffle_rows(spark, sf):
    return A.shuffle_rows(grey(spark, sf), "image_id", seed=11).select("image_id", F.col("position").cast("bigint"))


@query("SELECT CASE WHEN label < 8 THEN 'train' ELSE 'test' END AS split, count(*) AS n, 8 AS min_height, 8 AS max_height, "
       "8 AS min_width, 8 AS max_width, 1 AS min_channels, 1 AS max_channels FROM embeddings GROUP BY 1")
def dataset_summary(spark, sf):
    return A.summary(grey(spark, sf).withColumn("split", F.when(F.col("label") < 8, "train").otherwise("test")))


ITEMS = ("it AS (SELECT l_orderkey * 10 + l_linenumber AS image_id, l_quantity AS x0, l_discount AS x1, l_tax AS x2 "
         "FROM lineitem)")


@query(Q.with_(ITEMS) + f"SELECT image_id, {Q.r('x0')} AS x0, {Q.r('x1')} AS x1, {Q.r('x2')} AS x2 FROM it")
def vector_source(spark, sf):
    return items(spark, sf).select("image_id", *[num(F.get("pixels", F.lit(i))).alias(f"x{i}") for i in range(3)])


# ---- patches ----


def patch_sql(shape, win, stride, order="ijc", value="x", frm="pt"):
    return (Q.with_(Q.IMG, Q.patches(*shape, win, stride, order)) + "SELECT image_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, "
            f"CAST(k AS INT) AS k, {Q.r(value)} AS value FROM {frm}")


def patch_long(patches: DataFrame) -> DataFrame:
    long = PT.explode_values(patches, "image_id", "r", "c")
    return long.withColumn("value", num("value"))


@query(patch_sql(COLOUR, 3, 1))
def patches_sliding(spark, sf):
    return patch_long(PT.patch_table(colour(spark, sf), COLOUR, HopSpec(window=3, stride=1)))


@query(patch_sql(GREY, 5, 1))
def patches_sliding_5x5(spark, sf):
    return patch_long(PT.patch_table(grey(spark, sf), GREY, HopSpec(window=5, stride=1)))


@query(patch_sql(GREY, 3, 2))
def patches_stride(spark, sf):
    return patch_long(PT.patch_table(grey(spark, sf), GREY, HopSpec(window=3, stride=2)))


@query(patch_sql(COLOUR, 2, 2, "cij"))
def patches_tiled(spark, sf):
    return patch_long(PT.patch_table(colour(spark, sf), COLOUR, HopSpec(window=2, stride=2, order="cij")))


@query(patch_sql(GREY, 2, 1))
def patches_expression(spark, sf):
    return patch_long(PT.patch_table_sql(grey(spark, sf), GREY, 2, 1))


@query(pixel_sql(*COLOUR) + "SELECT image_id, CAST(node AS INT) AS channel, CAST(r * 4 + c AS INT) AS pos, "
       f"{Q.r('v')} AS value FROM px")
def map_rebuild(spark, sf):
    """Pixels to single values and back to maps."""
    long = C.split_channels(colour(spark, sf), COLOUR).select("image_id", "channel", F.posexplode("v").alias("p", "value"))
    values = long.select("image_id", "channel", F.floor(F.col("p") / 4).alias("r"), (F.col("p") % 4).alias("c"), "value")
    maps = PT.maps_from_values(values, 0, 4, 4).select("image_id", "channel", F.posexplode("v").alias("pos", "x"))
    return maps.select("image_id", "channel", "pos", num("x").alias("value"))


# ---- centring and statistics ----


def sliding(spark, sf) -> DataFrame:
    return PT.patch_table(grey(spark, sf), GREY, SLIDE)


@query(Q.with_(Q.IMG, Q.patches(*GREY, 2, 1)) + "SELECT image_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, "
       f"{Q.r('avg(x)')} AS value FROM pt GROUP BY image_id, r, c")
def patch_dc(spark, sf):
    return S.add_dc(sliding(spark, sf)).select("image_id", "r", "c", num("dc").alias("value"))


@query(patch_sql(GREY, 2, 1, value="x - avg(x) OVER (PARTITION BY image_id, r, c)"))
def patch_residual(spark, sf):
    return patch_long(S.remove_dc(sliding(spark, sf)))


@query(Q.with_(Q.IMG, Q.patches(*GREY, 3, 1)) + f"SELECT CAST(k AS INT) AS k, {Q.r('avg(x)', 9)} AS value FROM pt GROUP BY k")
def feature_mean(spark, sf):
    stats = S.row_stats(PT.patch_table(grey(spark, sf), GREY, HopSpec(window=3)), 9)
    return S.feature_means(stats).select("k", num("value", 9).alias("value"))


@query(patch_sql(GREY, 2, 1, value="x - avg(x) OVER (PARTITION BY k)"))
def mean_removed(spark, sf):
    mean = [r.value for r in S.feature_means(S.row_stats(sliding(spark, sf), 4)).orderBy("k").collect()]
    return patch_long(S.remove_mean(sliding(spark, sf), mean))


def covariance_sql(shape, win, digits):
    z = "z AS (SELECT image_id, r, c, k, x - avg(x) OVER (PARTITION BY image_id, r, c) AS z FROM pt)"
    return (Q.with_(Q.IMG, Q.patches(*shape, win, 1), z) + "SELECT CAST(a.k AS INT) AS i, CAST(b.k AS INT) AS j, "
            f"{Q.r('covar_samp(a.z, b.z)', digits)} AS value FROM z a JOIN z b USING (image_id, r, c) GROUP BY a.k, b.k")


@query(covariance_sql(GREY, 3, 9))
def patch_covariance(spark, sf):
    """Nine features: summed by generated code."""
    stats = S.row_stats(PT.patch_table(grey(spark, sf), GREY, HopSpec(window=3)), 9)
    return S.residual_covariance(stats).select("i", "j", num("value", 9).alias("value"))


@query(covariance_sql(COLOUR, 3, 9))
def patch_covariance_wide(spark, sf):
    """36 features: summed by matrix products on Arrow batches."""
    stats = S.patch_stats(colour(spark, sf), COLOUR, HopSpec(window=3))
    return S.residual_covariance(stats).select("i", "j", num("value", 9).alias("value"))


@query(covariance_sql(COLOUR, 3, 6))
def patch_covariance_offset(spark, sf):
    """The same covariance with 1e8 added to every pixel: a constant must not cost digits."""
    moved = colour(spark, sf).withColumn("pixels", F.transform("pixels", lambda x: x.cast("double") + 1e8))
    stats = S.patch_stats(moved, COLOUR, HopSpec(window=3))
    return S.residual_covariance(stats).select("i", "j", num("value", 6).alias("value"))


@query(Q.with_(Q.IMG, Q.patches(*GREY, 3, 1)) + f"SELECT {Q.r('9 * var_pop(d)', 9)} AS value "
       "FROM (SELECT avg(x) AS d FROM pt GROUP BY image_id, r, c)")
def dc_variance(spark, sf):
    stats = S.row_stats(PT.patch_table(grey(spark, sf), GREY, HopSpec(window=3)), 9)
    return S.dc_variance(stats).select(num("value", 9).alias("value"))


@query("SELECT count(*) * 49 AS n FROM embeddings")
def sample_count(spark, sf):
    return S.counts(S.row_stats(sliding(spark, sf), 4)).select("n")


@query(Q.with_(Q.IMG, Q.patches(*GREY, 3, 1), "y AS (SELECT *, x - avg(x) OVER (PARTITION BY k) AS y FROM pt)",
               "z AS (SELECT image_id, r, c, y - avg(y) OVER (PARTITION BY image_id, r, c) AS z FROM y)")
       + f"SELECT {Q.r('max(n)')} AS value FROM (SELECT sqrt(sum(z * z)) / 3 AS n FROM z GROUP BY image_id, r, c)")
def bias(spark, sf):
    patches = PT.patch_table(grey(spark, sf), GREY, HopSpec(window=3))
    mean = [r.value for r in S.feature_means(S.row_stats(patches, 9)).orderBy("k").collect()]
    return S.bias(patches, mean).select(num("value").alias("value"))


QUAD4 = [Q.IMG, Q.pixels(*COLOUR), Q.quads("qd", "px", 3, 1)]
WIDE = " UNION ALL ".join(f"SELECT node, image_id, r, c, {i} AS k, x{i} AS x FROM qd" for i in range(4))


@query(Q.with_(*QUAD4, f"lg AS ({WIDE})", "z AS (SELECT *, x - avg(x) OVER (PARTITION BY node, image_id, r, c) AS z FROM lg)")
       + "SELECT CAST(node AS INT) AS node, CAST(a.k AS INT) AS i, CAST(b.k AS INT) AS j, "
       f"{Q.r('covar_samp(a.z, b.z)', 9)} AS value FROM z a JOIN z b USING (node, image_id, r, c) GROUP BY node, a.k, b.k")
def channel_covariance(spark, sf):
    """Every channel on its own, all in one job."""
    stats = S.patch_stats(colour(spark, sf), COLOUR, HopSpec(channelwise=True))
    return S.residual_covariance(stats).select("node", "i", "j", num("value", 9).alias("value"))


# ---- kernels ----

GREY_QUADS = [Q.IMG, Q.pixels(*GREY), Q.quads("qd", "px", 7, 1)]


def one_hop(spark, sf, spec=SLIDE, images=grey, **kw):
    df = images(spark, sf)
    return df, SubspaceEstimator([spec], **kw).fit(df)


def kernel_sql(pre="h", digits=6, keys="CAST(kidx AS INT) AS kidx"):
    return f"SELECT {keys}, CAST(i AS INT) AS i, {Q.r('w[i + 1]', digits)} AS value FROM {pre}_k, range(4) t(i)"


@query(Q.with_(*GREY_QUADS, *Q.fit4("h", "qd")) + kernel_sql())
def kernels_joint(spark, sf):
    return weights(one_hop(spark, sf)[1].kernels(spark), "kidx")


@query(Q.with_(*GREY_QUADS, *Q.fit4("h", "qd"))
       + f"SELECT CAST(kidx AS INT) AS kidx, is_dc, {Q.r('local_energy', 9)} AS energy FROM h_k")
def kernel_energy(spark, sf):
    return one_hop(spark, sf)[1].kernels(spark).select("kidx", "is_dc", num("energy", 9).alias("energy"))


@query(Q.with_(*GREY_QUADS, *Q.fit4("h", "qd", use_dc=False)) + kernel_sql())
def kernels_without_dc(spark, sf):
    return weights(one_hop(spark, sf, HopSpec(use_dc=False))[1].kernels(spark), "kidx")


@query(Q.with_(*GREY_QUADS, *Q.fit4("h", "qd"))
       + f"SELECT CAST(kidx AS INT) AS kidx, CAST(i AS INT) AS i, {Q.r('abs(w[i + 1])')} AS value FROM h_k, range(4) t(i)")
def kernels_unaligned(spark, sf):
    """Without sign alignment only the magnitudes are determined."""
    kernels = one_hop(spark, sf, HopSpec(sign_align=False))[1].kernels(spark)
    return weights(kernels, "kidx").withColumn("value", F.abs("value"))


@query(Q.with_(*GREY_QUADS, *Q.fit4("h", "qd")) + kernel_sql() + " WHERE kidx < 2")
def kernel_limit(spark, sf):
    return weights(one_hop(spark, sf, HopSpec(num_kernels=2))[1].kernels(spark), "kidx")


@query(Q.with_(Q.IMG, Q.patches(*GREY, 3, 1)) + f"SELECT CAST(i AS INT) AS i, {Q.r('1 / (3 * sqrt(9 * var_pop(d)))')} AS value "
       "FROM (SELECT avg(x) AS d FROM pt GROUP BY image_id, r, c), range(9) t(i) GROUP BY i")
def dc_kernel(spark, sf):
    kernels = one_hop(spark, sf, HopSpec(window=3))[1].kernels(spark)
    return weights(kernels.filter("is_dc"), "kidx").drop("kidx")


@query("SELECT name, TRUE AS ok FROM (VALUES ('residual'), ('orthonormal'), ('sign'), ('trace'), ('order')) t(name)")
def kernel_invariants(spark, sf):
    """Checks the 36 kernels of 3 x 3 x 4 patches against their covariance, all as joins."""
    images = colour(spark, sf)
    spec = HopSpec(window=3, use_dc=False)
    kernels = SubspaceEstimator([spec]).fit(images).kernels(spark)
    cov = S.residual_covariance(S.patch_stats(images, COLOUR, spec))
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("value"))).over(Window.partitionBy("node"))
    w = kernels.select("kidx", "energy", F.posexplode("weights").alias("i", "w"))
    turned = (
        cov.withColumn("t", trace).join(w.withColumnRenamed("i", "j"), "j")
        .groupBy("kidx", "i").agg(F.sum(F.col("value") * F.col("w")).alias("cw"), F.first("t").alias("t"))
    )
    gap = F.max(F.abs(F.col("cw") - F.col("energy") * F.col("t") * F.col("w")))
    same = F.when(F.col("kidx") == F.col("q"), 1.0).otherwise(0.0)
    dots = w.join(w.select(F.col("kidx").alias("q"), "i", F.col("w").alias("v")), "i").groupBy("kidx", "q").agg(
        F.sum(F.col("w") * F.col("v")).alias("dot"))
    down = F.transform(F.sort_array(F.array_agg(F.struct("kidx", "energy"))), lambda x: -x["energy"])
    leads = w.groupBy("kidx").agg((F.max("w") * (1 + 1e-9) + F.min("w")).alias("lead"))
    checks = [
        turned.join(w, ["kidx", "i"]).agg((gap < 1e-9).alias("ok")).withColumn("name", F.lit("residual")),
        dots.agg((F.max(F.abs(F.col("dot") - same)) < 1e-9).alias("ok")).withColumn("name", F.lit("orthonormal")),
        leads.agg(((F.min("lead") >= 0) & (F.count("lead") == 36)).alias("ok")).withColumn("name", F.lit("sign")),
        kernels.agg((F.abs(F.sum("energy") - 1) < 1e-9).alias("ok")).withColumn("name", F.lit("trace")),
        kernels.agg((F.array_sort(down) == down).alias("ok")).withColumn("name", F.lit("order")),
    ]
    return C.concat_hops(checks).select("name", "ok")


# ---- projection and inverse ----


def value_sql(pre="h", digits=5, where="", cols="CAST(channel AS INT) AS channel"):
    return (f"SELECT image_id, {cols}, CAST(r AS INT) AS r, CAST(c AS INT) AS c, {Q.r('v', digits)} AS value "
            f"FROM {pre}_o{where}")


ONE_HOP = [*GREY_QUADS, *Q.fit4("h", "qd"), Q.roles("h", None, 0.005, 0.001, True)]


@query(Q.with_(*ONE_HOP, Q.score4("h", "qd")) + value_sql())
def transform_joint(spark, sf):
    images, model = one_hop(spark, sf)
    return cells(model.transform_maps(images, "all"), "channel")


@query(Q.with_(*ONE_HOP, Q.score4("h", "qd", bias=True)) + value_sql())
def transform_bias(spark, sf):
    images, model = one_hop(spark, sf, HopSpec(need_bias=True))
    return cells(model.transform_maps(images, "all"), "channel")


@query(Q.with_(*ONE_HOP, "ctr AS (SELECT image_id, node, r, c, [x0 - m0 - z, x1 - m1 - z, x2 - m2 - z, x3 - m3 - z] AS z FROM "
               "(SELECT q.*, m0, m1, m2, m3, (x0 + x1 + x2 + x3 - m0 - m1 - m2 - m3) / 4 AS z FROM qd q JOIN h_st USING (node)))")
       + "SELECT image_id, CAST(channel AS INT) AS channel, CAST(r AS INT) AS r, CAST(c AS INT) AS c, "
       f"{Q.r('list_inner_product(z, w)', 5)} AS value FROM ctr JOIN h_r USING (node)")
def transform_residual(spark, sf):
    """The variant that projects the residual: its mean channel is zero."""
    images, model = one_hop(spark, sf, HopSpec(center="residual"))
    return cells(model.transform_maps(images, "all"), "channel")


@query(Q.with_(*ONE_HOP, Q.score4("h", "qd")) + value_sql(cols="CAST(kidx AS INT) AS kidx"))
def transform_given(spark, sf):
    """Projection on a table of kernels."""
    images, model = one_hop(spark, sf)
    patches = S.remove_mean(sliding(spark, sf), model.tree[0]["nodes"][0]["mean"]).withColumn("node", F.lit(0))
    out = E.project_on_kernels(patches, model.kernels(spark))
    return out.select("image_id", "kidx", "r", "c", num("value", 5).alias("value"))


@query(Q.with_(*ONE_HOP) + "SELECT image_id, CAST(r * 7 + c AS INT) AS pos, "
       f"{Q.r('(x0 - m0 + x1 - m1 + x2 - m2 + x3 - m3) / 4 + bias')} AS value FROM qd JOIN h_st USING (node)")
def dc_output(spark, sf):
    images, model = one_hop(spark, sf, HopSpec(need_bias=True))
    return flat(model.dc(images), "v")


def inverse_sql(exact: bool) -> str:
    """Channel 0 is the projection on a kernel of norm 1/sqrt(L); going back scales it by 1/L unless undone."""
    scale = "1.0" if exact else "1 / l"
    # with a bias b the mean part d + b comes back as (d + b) * scale, then b is taken off
    cte = ("ctr AS (SELECT image_id, r, c, l, bias, [m0, m1, m2, m3] AS m, [x0 - m0, x1 - m1, x2 - m2, x3 - m3] AS y, "
           "(x0 - m0 + x1 - m1 + x2 - m2 + x3 - m3) / 4 AS d FROM qd JOIN h_st USING (node))")
    return (Q.with_(*ONE_HOP, cte) + "SELECT image_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(k AS INT) AS k, "
            f"{Q.r(f'y[k + 1] - d + (d + bias) * {scale} - bias + m[k + 1]', 5)} AS value FROM ctr, range(4) t(k)")


def inverse(spark, sf, exact):
    images, model = one_hop(spark, sf, HopSpec(need_bias=True))
    coefs = E.coefficients(images, model.tree, model.dims)
    node, spec = model.tree[0]["nodes"][0], model.tree[0]["spec"]
    long = PT.explode_values(E.invert(coefs, node, spec, exact), "image_id", "r", "c")
    return long.withColumn("value", num("value", 5))


@query(inverse_sql(True))
def inverse_exact(spark, sf):
    return inverse(spark, sf, True)


@query(inverse_sql(False))
def inverse_plain(spark, sf):
    return inverse(spark, sf, False)


@query("SELECT use_dc, need_bias, 0.0::DOUBLE AS mae, count(*) AS n FROM embeddings, (VALUES (TRUE), (FALSE)) a(use_dc), "
       "(VALUES (TRUE), (FALSE)) b(need_bias) GROUP BY use_dc, need_bias")
def inverse_error(spark, sf):
    """Mean absolute error of the way there and back, on vectors of 64 values, for all flag settings."""
    vectors = I.vectors_from_array(table(spark, sf, "embeddings"), "vec_id", "embedding", 64)
    out = []
    for use_dc in (True, False):
        for need_bias in (False, True):
            model = SubspaceEstimator([HopSpec(window=1, use_dc=use_dc, need_bias=need_bias)]).fit(vectors)
            error = E.round_trip_error(vectors, model.tree, model.dims)
            out.append(error.select(F.lit(use_dc).alias("use_dc"), F.lit(need_bias).alias("need_bias"), num("mae", 9).alias("mae"), "n"))
    return C.concat_hops(out)


@query("SELECT 0.0::DOUBLE AS mae, count(*) FILTER (vec_id % 4 <> 1 AND vec_id % 7 <> 2) AS n, "
       "count(*) FILTER (vec_id % 4 <> 1 AND vec_id % 7 = 2) AS n_left_only, "
       "count(*) FILTER (vec_id % 4 = 1 AND vec_id % 7 <> 2) AS n_right_only, 0::BIGINT AS n_unlike FROM embeddings")
def inverse_error_unmatched(spark, sf):
    """Patches and their reconstruction as two tables, each short of other rows: what has no partner is counted."""
    vectors = I.vectors_from_array(table(spark, sf, "embeddings"), "vec_id", "embedding", 64)
    model = SubspaceEstimator([HopSpec(window=1)]).fit(vectors)
    coefs = E.coefficients(vectors, model.tree, model.dims)
    back = E.invert(coefs, model.tree[0]["nodes"][0], model.tree[0]["spec"], dc=model.dc(vectors))
    patches = PT.patch_table(vectors, (1, 1, 64), HopSpec(window=1))
    error = E.reconstruction_error(patches.filter("image_id % 4 <> 1"), back.filter("image_id % 7 <> 2"))
    return error.withColumn("mae", num("mae", 9))


def fit3(source: str) -> list[str]:
    """Kernels ``kn`` of the three columns of ``it``."""
    return [
        source,
        "pq AS (SELECT *, (x0 - x1) / sqrt(2.0) AS p, (x0 + x1 - 2 * x2) / sqrt(6.0) AS q, (x0 + x1 + x2) / 3 AS d FROM it)",
        "st AS (SELECT avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, avg(p) AS mp, avg(q) AS mq, 3 * var_pop(d) AS l, "
        "var_samp(p) AS vp, var_samp(q) AS vq, covar_samp(p, q) AS pq FROM pq)",
        "ev AS (SELECT *, (vp + vq) / 2 + sqrt(((vp - vq) / 2) ** 2 + pq * pq) AS l1, "
        "(vp + vq) / 2 - sqrt(((vp - vq) / 2) ** 2 + pq * pq) AS l2 FROM st)",
        # in the (p, q) plane the first axis is at half the angle of (vp - vq, 2 pq); the second is at right angles
        "ax AS (SELECT *, atan2(2 * pq, vp - vq) / 2 AS t FROM ev)",
        "ke AS (SELECT 0 AS kidx, l / (l + l1 + l2) AS energy, list_transform(range(3), lambda i: 1 / sqrt(3 * l)) AS w FROM ax "
        "UNION ALL SELECT 1, l1 / (l + l1 + l2), [cos(t) / sqrt(2.0) + sin(t) / sqrt(6.0), -cos(t) / sqrt(2.0) + sin(t) / sqrt(6.0), "
        "-2 * sin(t) / sqrt(6.0)] FROM ax UNION ALL SELECT 2, l2 / (l + l1 + l2), [-sin(t) / sqrt(2.0) + cos(t) / sqrt(6.0), "
        "sin(t) / sqrt(2.0) + cos(t) / sqrt(6.0), -2 * cos(t) / sqrt(6.0)] FROM ax)",
        "kn AS (SELECT kidx, energy, list_transform(w, lambda x: x * sign(list_filter(w, lambda y: abs(y) >= (1 - 1e-9) * "
        "list_max(list_transform(w, lambda z: abs(z))))[1])) AS w FROM ke)",
    ]


K3 = fit3(ITEMS)
VECTOR = HopSpec(window=1)


@query(Q.with_(*K3) + f"SELECT kidx, {Q.r('energy', 9)} AS energy FROM kn")
def vector_energy_k3(spark, sf):
    return SubspaceEstimator([VECTOR]).fit(items(spark, sf)).kernels(spark).select("kidx", num("energy", 9).alias("energy"))


@query(Q.with_(*K3) + f"SELECT kidx, CAST(i AS INT) AS i, {Q.r('w[i + 1]')} AS value FROM kn, range(3) t(i)")
def vector_kernels_k3(spark, sf):
    return weights(SubspaceEstimator([VECTOR]).fit(items(spark, sf)).kernels(spark), "kidx")


@query(Q.with_(*K3) + "SELECT image_id, "
       + ", ".join(f"{Q.r(f'list_inner_product([x0 - m0, x1 - m1, x2 - m2], w{i})', 5)} AS y{i}" for i in range(3))
       + " FROM it, st, (SELECT " + ", ".join(f"max(w) FILTER (WHERE kidx = {i}) AS w{i}" for i in range(3)) + " FROM kn)")
def vector_transform_k3(spark, sf):
    vectors = items(spark, sf)
    wide = SubspaceEstimator([VECTOR]).fit(vectors).features(vectors, "all")
    return wide.select("image_id", *[num(F.get("features", F.lit(i)), 5).alias(f"y{i}") for i in range(3)])


@query(Q.with_(*K3) + "SELECT image_id, "
       f"{Q.r('sqrt(max((p - mp) ** 2 + (q - mq) ** 2) OVER ()) / sqrt(3.0) + (x0 + x1 + x2 - m0 - m1 - m2) / 3', 5)} AS value FROM pq, st")
def vector_dc_k3(spark, sf):
    vectors = items(spark, sf)
    dc = SubspaceEstimator([HopSpec(window=1, need_bias=True)]).fit(vectors).dc(vectors)
    return dc.select("image_id", num(F.get("v", F.lit(0)), 5).alias("value"))


def kernels3_sql(source: str) -> str:
    return (Q.with_(*fit3(source)) + f"SELECT kidx, CAST(i AS INT) AS i, {Q.r('energy', 9)} AS energy, {Q.r('w[i + 1]')} AS value "
            "FROM kn, range(3) t(i)")


def kernels3(vectors: DataFrame) -> DataFrame:
    kernels = SubspaceEstimator([VECTOR]).fit(vectors).kernels(vectors.sparkSession)
    return weights(kernels.withColumn("energy", num("energy", 9)), "kidx", "energy").select("kidx", "i", "energy", "value")


@query(kernels3_sql("it AS (SELECT p_size::DOUBLE AS x0, p_retailprice AS x1, p_partkey::DOUBLE AS x2 FROM part)"))
def vector_scales_k3(spark, sf):
    """Columns of very different scale."""
    return kernels3(I.vectors_from_columns(table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice", "p_partkey"]))


@query(kernels3_sql("it AS (SELECT o_totalprice AS x0, o_custkey::DOUBLE AS x1, o_orderkey::DOUBLE AS x2 FROM orders)"))
def vector_offset_k3(spark, sf):
    """The same after adding a hundred million to every column: covariance and kernels must not notice."""
    orders = table(spark, sf, "orders")
    far = [(F.col(c) + 1e8).alias(c) for c in ("o_totalprice", "o_custkey", "o_orderkey")]
    return kernels3(I.vectors_from_columns(orders.select(*far), "o_orderkey", ["o_totalprice", "o_custkey", "o_orderkey"]))


# ---- channels and pooling ----


@query(pixel_sql(*COLOUR) + "SELECT image_id, CAST(node AS INT) AS channel, CAST(r * 4 + c AS INT) AS pos, "
       f"{Q.r('v')} AS value FROM px")
def channel_split(spark, sf):
    long = C.split_channels(colour(spark, sf), COLOUR).select("image_id", "channel", F.posexplode("v").alias("pos", "x"))
    return long.select("image_id", "channel", "pos", num("x").alias("value"))


@query(ORACLE["channel_split"])
def channel_slice(spark, sf):
    """The maps of each channel as column expressions."""
    one = [F.struct(F.lit(c).alias("channel"), P.channel_slice(F.col("pixels"), 16, 4, F.lit(c)).alias("v")) for c in range(4)]
    maps = colour(spark, sf).select("image_id", F.explode(F.array(*one)).alias("m"))
    return maps.select("image_id", "m.channel", F.posexplode("m.v").alias("pos", "x")).select("image_id", "channel", "pos", num("x").alias("value"))


@query(Q.with_(Q.IMG) + "SELECT image_id, 4 AS channels, CAST(k AS INT) AS pos, " + f"{Q.r('p[k + 1]')} AS value FROM img, range(64) t(k)")
def channel_stack(spark, sf):
    """Split into maps and put together again."""
    images = C.stack_channels(C.split_channels(colour(spark, sf), COLOUR))
    long = images.select("image_id", "channels", F.posexplode("pixels").alias("pos", "v"))
    return long.select("image_id", "channels", "pos", num("v").alias("value"))


@query(pixel_sql(*COLOUR) + "SELECT image_id, CAST(node + 4 * s AS INT) AS channel, CAST(r AS INT) AS r, CAST(c AS INT) AS c, "
       f"{Q.r('v * (1 + s)', 5)} AS value FROM px, range(2) t(s)")
def channel_concat(spark, sf):
    maps = C.split_channels(colour(spark, sf), COLOUR)
    twice = maps.withColumn("v", F.transform("v", lambda x: x * 2))
    return cells(C.concat_channels([(maps, 4), (twice, 4)], 0), "channel")


def pool_sql(shape, block, how, ragged):
    src = "ch AS (SELECT image_id, node AS channel, r, c, v FROM px)"
    return (Q.with_(Q.IMG, Q.pixels(*shape), src, Q.pool("h_o", "ch", shape[0], block, how, ragged)) + value_sql(digits=6))


def pooled(images, shape, block, how, ragged="pad"):
    return cells(C.pool_maps(C.split_channels(images, shape), block, how, ragged), "channel", digits=6)


@query(pool_sql(COLOUR, 2, "max", "pad"))
def max_pool(spark, sf):
    return pooled(colour(spark, sf), COLOUR, 2, "max")


@query(pool_sql(GREY, 2, "min", "pad"))
def min_pool(spark, sf):
    return pooled(grey(spark, sf), GREY, 2, "min")


@query(pool_sql(GREY, 2, "avg", "pad"))
def avg_pool(spark, sf):
    return pooled(grey(spark, sf), GREY, 2, "avg")


@query(pool_sql(COLOUR, 2, "sum", "pad"))
def sum_pool(spark, sf):
    return pooled(colour(spark, sf), COLOUR, 2, "sum")


@query(pool_sql(GREY, 3, "max", "pad"))
def max_pool_ragged(spark, sf):
    return pooled(grey(spark, sf), GREY, 3, "max")


@query(pool_sql(GREY, 3, "max", "drop"))
def max_pool_dropped(spark, sf):
    return pooled(grey(spark, sf), GREY, 3, "max", "drop")


@query(pool_sql(GREY, 2, "median", "pad"))
def median_pool(spark, sf):
    """A numpy reducer of the caller's own."""
    return pooled(grey(spark, sf), GREY, 2, np.median)


@query(pool_sql(GREY, 2, "max", "pad"))
def max_pool_expression(spark, sf):
    maps = C.split_channels(grey(spark, sf), GREY)
    v = P.pool_map(F.col("v"), 8, 8, 2, "max")
    small = maps.withColumn("v", v).withColumn("height", F.lit(4)).withColumn("width", F.lit(4))
    return cells(small, "channel", digits=6)


SELECTED = [*GREY_QUADS, *Q.fit4("h", "qd"), Q.roles("h", None, TH1, 0.24852, False), Q.score4("h", "qd")]


def selected(spark, sf, role):
    images, model = one_hop(spark, sf)
    kernels = K.assign_roles(model.kernels(spark), TH1, 0.24852, 2)
    return C.select_channels(model.transform_maps(images, "all"), kernels, role), kernels.filter(F.col("role") == role)


@query(Q.with_(*SELECTED) + value_sql(where=" WHERE role = 'emit'"))
def channel_select(spark, sf):
    return cells(selected(spark, sf, "emit")[0], "channel")


@query(Q.with_(*SELECTED) + f"SELECT CAST(channel AS INT) AS channel, CAST(i AS INT) AS i, {Q.r('energy', 9)} AS energy, "
       f"{Q.r('w[i + 1]')} AS value FROM h_r, range(4) t(i) WHERE role = 'emit'")
def kernel_select(spark, sf):
    return weights(selected(spark, sf, "emit")[1].withColumn("energy", num("energy", 9)), "channel", "energy")


# ---- thresholds, trees and features ----


def two_hops(spark, sf, specs=(SLIDE, HopSpec(need_bias=True)), th1=TH1, th2=TH2, **kw):
    images = grey(spark, sf)
    return images, SubspaceEstimator(list(specs), th1=th1, th2=th2, **kw).fit(images)


def tree_sql(th1=TH1, th2=TH2, stride=1, sides=(7, 6), bias=(False, True)) -> list[str]:
    """Both hops of the sliding or tiled tree, down to the output values ``h_o`` and ``g_o``."""
    return [
        Q.IMG, Q.pixels(*GREY), Q.quads("qd", "px", sides[0], stride),
        *Q.fit4("h", "qd"), Q.roles("h", None, th1, th2, False), Q.children("h"), Q.score4("h", "qd", bias[0]),
        Q.next_maps("m1", "h"), Q.quads("qe", "m1", sides[1], stride),
        *Q.fit4("g", "qe"), Q.roles("g", "h_f", th1, th2, True), Q.score4("g", "qe", bias[1]),
        "all_k AS (SELECT 0 AS hop, node, kidx, channel, energy, role FROM h_r UNION ALL SELECT 1, node, kidx, channel, energy, role FROM g_r)",
        "all_o AS (SELECT 0 AS hop, * FROM h_o UNION ALL SELECT 1, * FROM g_o)",
    ]


HOP_VALUES = ("SELECT image_id, CAST(hop AS INT) AS hop, CAST(channel AS INT) AS channel, CAST(r AS INT) AS r, "
              f"CAST(c AS INT) AS c, {Q.r('v', 5)} AS value FROM all_o")
KERNEL_ROLES = ("SELECT CAST(hop AS INT) AS hop, CAST(node AS INT) AS node, CAST(kidx AS INT) AS kidx, "
                f"CAST(channel AS INT) AS channel, {Q.r('energy', 9)} AS energy, role FROM all_k")


@query(Q.with_(*tree_sql()) + KERNEL_ROLES)
def kernel_roles(spark, sf):
    kernels = two_hops(spark, sf)[1].kernels(spark)
    return kernels.select("hop", "node", "kidx", "channel", num("energy", 9).alias("energy"), "role")


@query(Q.with_(*tree_sql()) + "SELECT CAST(hop AS INT) AS hop, role, count(*) AS n FROM all_k GROUP BY hop, role")
def role_counts(spark, sf):
    return K.filter_report(two_hops(spark, sf)[1].kernels(spark))


@query(Q.with_(*tree_sql()) + "SELECT CAST(hop AS INT) AS hop, "
       f"{Q.r('sum(energy)', 9)} AS energy FROM all_k GROUP BY hop")
def energy_sum(spark, sf):
    return two_hops(spark, sf)[1].kernels(spark).groupBy("hop").agg(num(F.sum("energy"), 9).alias("energy"))


@query(Q.with_(*tree_sql(0.2488, TH2)) + "SELECT 1 AS hop, CAST(node AS INT) AS node, "
       f"CAST(channel AS INT) AS parent_channel, {Q.r('energy', 9)} AS parent_energy FROM h_f")
def child_numbering(spark, sf):
    """Two channels go on, with a gap before them."""
    kernels = two_hops(spark, sf, th1=0.2488)[1].kernels(spark)
    children = K.number_children(kernels)
    return children.select("hop", "node", "parent_channel", num("parent_energy", 9).alias("parent_energy"))


@query(Q.with_(*ONE_HOP[:-1], Q.roles("h", None, 1.1, 0.001, True))
       + "SELECT 1 AS depth, CAST(channel AS INT) AS channel, role FROM h_r")
def early_stop(spark, sf):
    model = two_hops(spark, sf, th1=1.1, th2=0.001)[1]
    return model.kernels(spark).select(F.lit(model.depth).alias("depth"), "channel", "role")


@query(Q.with_(*tree_sql()) + HOP_VALUES + " WHERE role = 'emit'")
def hop_features(spark, sf):
    """The flagship: two sliding hops, channel by channel, with a bias, thresholds and early pruning."""
    images, model = two_hops(spark, sf)
    return cells(model.transform(images), "hop", "channel")


@query(Q.with_(*tree_sql()) + HOP_VALUES)
def hop_outputs(spark, sf):
    """All channels of both hops."""
    images, model = two_hops(spark, sf)
    return cells(model.transform_maps(images, "all"), "hop", "channel")


@query(Q.with_(*tree_sql(th2=0.05)) + HOP_VALUES
       + " WHERE (hop, channel) IN (SELECT (hop, channel) FROM all_k WHERE energy >= 0.05)")
def hop_features_all(spark, sf):
    """Every channel from th2 on, forwarded ones included."""
    images, model = two_hops(spark, sf, th2=0.05, emit="all")
    return cells(model.transform(images), "hop", "channel")


@query(Q.with_(*tree_sql(0.005, 0.001, 2, (4, 2))) + HOP_VALUES + " WHERE role = 'emit'")
def tiled_features(spark, sf):
    """Two tiling hops at the usual thresholds: every channel of hop 0 goes on."""
    images, model = two_hops(spark, sf, (TILE, HopSpec(window=2, stride=2, need_bias=True)), 0.005, 0.001)
    return cells(model.transform(images), "hop", "channel")


@query(Q.with_(*tree_sql(0.005, 0.001, 2, (4, 2), (True, True))) + HOP_VALUES)
def tiled_outputs_biased(spark, sf):
    """A bias in both hops: found in one scan after the fit."""
    specs = [HopSpec(window=2, stride=2, need_bias=True)] * 2
    images, model = two_hops(spark, sf, specs, 0.005, 0.001)
    return cells(model.transform_maps(images, "all"), "hop", "channel")


@query(Q.with_(*tree_sql()) + "SELECT image_id, CAST(node AS INT) AS node, CAST(r * 6 + c AS INT) AS pos, "
       f"{Q.r('(x0 - m0 + x1 - m1 + x2 - m2 + x3 - m3) / 4 + bias', 5)} AS value FROM qe JOIN g_st USING (node)")
def hop_dc(spark, sf):
    """The patch means of the second hop."""
    images, model = two_hops(spark, sf)
    dc = model.dc(images).filter("hop = 1").select("image_id", "node", F.posexplode("v").alias("pos", "x"))
    return dc.select("image_id", "node", "pos", num("x", 5).alias("value"))


@query(Q.with_(*tree_sql()) + "SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY hop, channel, r, c) - 1 "
       f"AS INT) AS pos, {Q.r('v', 5)} AS value FROM all_o JOIN img USING (image_id) WHERE role = 'emit'")
def wide_features(spark, sf):
    """One vector per image with its label, from the images without a shuffle."""
    images, model = two_hops(spark, sf)
    wide = model.features(images, keep=("label",))
    return wide.select("image_id", "label", F.posexplode("features").alias("pos", "x")).select(
        "image_id", "label", "pos", num("x", 5).alias("value"))


@query(ORACLE["wide_features"].replace(" label,", "", 1).replace("image_id, label, CAST(row", "image_id, CAST(row"))
def wide_features_from_maps(spark, sf):
    """The same from a table of maps."""
    images, model = two_hops(spark, sf)
    return flat(C.wide_features(model.transform(images)), "features", 5)


@query(ORACLE["wide_features"])
def wide_vectors(spark, sf):
    """The same as vectors of ``pyspark.ml``, taken apart again."""
    images, model = two_hops(spark, sf)
    vectors = C.as_vector(model.features(images, keep=("label",)))
    wide = vectors.select("image_id", "label", F.posexplode(vector_to_array("features")).alias("pos", "x"))
    return wide.select("image_id", "label", "pos", num("x", 5).alias("value"))


DEEP = [
    *GREY_QUADS, *Q.fit4("h", "qd"), Q.roles("h", None, 0.12, 0.001, False), Q.children("h"), Q.score4("h", "qd"), Q.next_maps("m1", "h"),
    Q.quads("qe", "m1", 6, 1), *Q.fit4("g", "qe"), Q.roles("g", "h_f", 0.12, 0.001, False), Q.children("g"), Q.score4("g", "qe", True),
    Q.next_maps("m2", "g"), Q.quads("qf", "m2", 5, 1), *Q.fit4("f", "qf"), Q.roles("f", "g_f", 0.12, 0.001, True), Q.score4("f", "qf", True),
]


@query(Q.with_(*DEEP) + value_sql("f"))
def deep_outputs(spark, sf):
    """The third of three hops, each fitted on the stored maps of the one before."""
    images, specs = grey(spark, sf), [SLIDE, HopSpec(need_bias=True), HopSpec(need_bias=True)]
    model = SubspaceEstimator(specs, th1=0.12, th2=0.001, maps="stored", store=scratch_path(spark, "fit")).fit(images)
    return cells(model.transform_maps(images, "all").filter("hop = 2"), "channel")


POOLED = [
    *GREY_QUADS, *Q.fit4("h", "qd"), Q.roles("h", None, 0.249, 0.001, False), Q.children("h"), Q.score4("h", "qd", True),
    Q.pool("h_p", "h_o", 7, 2, "max", "pad", "image_id, channel, role"), Q.next_maps("m1", "h", "h_p"),
    Q.quads("qe", "m1", 3, 1), *Q.fit4("g", "qe"), Q.roles("g", "h_f", 0.249, 0.001, True), Q.score4("g", "qe", True),
    Q.pool("g_p", "g_o", 3, 2, "max", "pad", "image_id, channel, role"),
    "all_o AS (SELECT 0 AS hop, * FROM h_p UNION ALL SELECT 1, * FROM g_p)",
]


@query(Q.with_(*POOLED) + HOP_VALUES + " WHERE role = 'emit'")
def pooled_features(spark, sf):
    """Max-pooling with ragged edges after each hop."""
    specs = [HopSpec(pool_after=2, need_bias=True)] * 2
    images, model = two_hops(spark, sf, specs, 0.249, 0.001)
    return cells(model.transform(images), "hop", "channel")


PRE = [
    *GREY_QUADS, *Q.fit4("h", "qd"), Q.roles("h", None, 0.249, 0.001, False), Q.children("h"), Q.score4("h", "qd", True),
    Q.next_maps("m0", "h"), Q.pool("m1", "m0", 7, 2, "sum", "drop", "image_id, node"), Q.quads("qe", "m1", 2, 1),
    *Q.fit4("g", "qe"), Q.roles("g", "h_f", 0.249, 0.001, True), Q.score4("g", "qe", True),
    "all_o AS (SELECT 0 AS hop, * FROM h_o UNION ALL SELECT 1, * FROM g_o)",
]


@query(Q.with_(*PRE) + HOP_VALUES)
def prepooled_outputs(spark, sf):
    """Sum-pooling before the second hop: the bias constant grows by the block size."""
    specs = [HopSpec(need_bias=True), HopSpec(pool_before=2, pool_fn="sum", ragged="drop", need_bias=True)]
    images, model = two_hops(spark, sf, specs, 0.249, 0.001)
    return cells(model.transform_maps(images, "all"), "hop", "channel")


CW0 = [Q.IMG, Q.pixels(*COLOUR), Q.quads("qd", "px", 3, 1), *Q.fit4("h", "qd"), Q.roles("h", None, 0.005, 0.001, True),
       Q.score4("h", "qd", True)]


@query(Q.with_(*CW0) + value_sql())
def channelwise_outputs(spark, sf):
    """The first hop channel by channel: four nodes at once."""
    images, model = one_hop(spark, sf, HopSpec(channelwise=True, need_bias=True), colour)
    return cells(model.transform_maps(images, "all"), "channel")


@query(Q.with_(*CW0) + kernel_sql(keys="CAST(node AS INT) AS node, CAST(kidx AS INT) AS kidx"))
def channelwise_kernels(spark, sf):
    return weights(one_hop(spark, sf, HopSpec(channelwise=True), colour)[1].kernels(spark), "node", "kidx")


PIXELS = [
    Q.IMG, "qd AS (SELECT 0 AS node, image_id, r, c, " + ", ".join(f"p[(r * 4 + c) * 4 + {i} + 1] AS x{i}" for i in range(4))
    + " FROM img, range(4) a(r), range(4) b(c))",
    *Q.fit4("h", "qd"), Q.roles("h", None, 0.24, 0.05, False), Q.children("h"), Q.score4("h", "qd", True),
    Q.next_maps("m1", "h"), Q.quads("qe", "m1", 3, 1), *Q.fit4("g", "qe"), Q.roles("g", "h_f", 0.24, 0.05, True),
    Q.score4("g", "qe", True), "all_o AS (SELECT 0 AS hop, * FROM h_o UNION ALL SELECT 1, * FROM g_o)",
]


@query(Q.with_(*PIXELS) + HOP_VALUES + " WHERE role <> 'discard'")
def colour_features(spark, sf):
    """A joint first hop over the four channels of each pixel, then sliding patches per channel."""
    images = colour(spark, sf)
    specs = [HopSpec(window=1, need_bias=True), HopSpec(window=2, need_bias=True)]
    model = SubspaceEstimator(specs, th1=0.24, th2=0.05).fit(images)
    both = C.concat_hops([model.transform_maps(images, s) for s in ("emit", "forward")])
    return cells(both, "hop", "channel")


# ---- the step-by-step interface ----

STEP = HopSpec(window=2, stride=1, ddof=0)
STEP_SQL = [*GREY_QUADS, *Q.fit4("h", "qd", 0), Q.roles("h", None, 0.249, 0.24853, False), Q.score4("h", "qd")]


@query(Q.with_(*STEP_SQL) + value_sql())
def step_joint(spark, sf):
    return cells(fit_joint(grey(spark, sf), spec=STEP)[1], "channel")


@query(Q.with_(*STEP_SQL) + f"SELECT CAST(kidx AS INT) AS kidx, {Q.r('0.5 * energy', 9)} AS energy FROM h_r")
def step_joint_energy(spark, sf):
    return fit_joint(grey(spark, sf), 0.5, STEP)[0].select("kidx", num("energy", 9).alias("energy"))


@query(Q.with_(*STEP_SQL, Q.pool("h_p", "h_o", 7, 2, "max", "pad", "image_id, channel, role"))
       + "SELECT image_id, role, CAST(channel AS INT) AS channel, CAST(r AS INT) AS r, CAST(c AS INT) AS c, "
       f"{Q.r('v', 5)} AS value FROM h_p WHERE role <> 'discard'")
def step_filter(spark, sf):
    kernels, maps, _ = fit_joint(grey(spark, sf), spec=STEP)
    return cells(C.pooled_roles(maps, C.part_kernels(kernels, 0.249, 0.24853)), "role", "channel")


STEP2_SQL = [*STEP_SQL, Q.pool("h_p", "h_o", 7, 2, "max", "pad", "image_id, channel, role"), Q.children("h"),
             Q.next_maps("m1", "h", "h_p"), Q.quads("qe", "m1", 3, 1), *Q.fit4("g", "qe", 0),
             Q.roles("g", "h_f", 0.249, 0.001, True), Q.score4("g", "qe", True)]


def step_two(spark, sf):
    kernels, maps, _ = fit_joint(grey(spark, sf), spec=STEP)
    forward, fk, *_ = C.filter_channels(maps, kernels, 0.249, 0.24853)
    energy = {r.channel: r.energy for r in fk.select("channel", "energy").collect()}
    return fit_channelwise(forward, energy, HopSpec(window=2, stride=1, ddof=0, need_bias=True), store=scratch_path(spark, "maps"))


@query(Q.with_(*STEP2_SQL) + value_sql("g"))
def step_channelwise(spark, sf):
    return cells(step_two(spark, sf)[1], "channel")


@query(Q.with_(*STEP2_SQL) + "SELECT CAST(node AS INT) AS node, CAST(kidx AS INT) AS kidx, CAST(i AS INT) AS i, "
       f"{Q.r('energy', 9)} AS energy, {Q.r('w[i + 1]')} AS value FROM g_r, range(4) t(i)")
def step_channelwise_kernels(spark, sf):
    kernels = step_two(spark, sf)[0].withColumn("energy", num("energy", 9))
    return weights(kernels, "node", "kidx", "energy").select("node", "kidx", "i", "energy", "value")


# ---- hooks and persistence ----


def tiles(x: np.ndarray) -> np.ndarray:
    """A neighbourhood function of the caller's own: 2 x 2 tiles."""
    n, h, w, c = x.shape
    cut = x[:, : h // 2 * 2, : w // 2 * 2].reshape(n, h // 2, 2, w // 2, 2, c)
    return cut.transpose(0, 1, 3, 2, 4, 5).reshape(n, h // 2, w // 2, 4 * c)


@query(Q.with_(*tree_sql(0.005, 0.001, 2, (4, 2))) + HOP_VALUES + " WHERE role = 'emit'")
def custom_patches(spark, sf):
    specs = [HopSpec(patch_fn=tiles), HopSpec(patch_fn=tiles, need_bias=True)]
    images, model = two_hops(spark, sf, specs, 0.005, 0.001)
    return cells(model.transform(images), "hop", "channel")


@query(Q.with_(*tree_sql()) + "SELECT CAST(hop AS INT) AS hop, CAST(channel AS INT) AS channel, "
       f"{Q.r('avg(v)')} AS value FROM all_o WHERE role = 'emit' GROUP BY hop, channel")
def custom_concat(spark, sf):
    """The features handed to a function of the caller's own."""

    def levels(maps: DataFrame) -> DataFrame:
        value = F.sum(P.total(F.col("v"))) / F.sum(F.size("v"))
        return maps.groupBy("hop", "channel").agg(num(value).alias("value"))

    images, model = two_hops(spark, sf)
    return model.transform(images).transform(levels)


@query("SELECT t AS tbl, 0::BIGINT AS n FROM (VALUES ('dc'), ('kernels'), ('maps'), ('nodes')) v(t)")
def save_load_difference(spark, sf):
    """Groups that differ between a model and its reloaded copy, in every table: by number of rows and sum of their hashes."""
    images, model = two_hops(spark, sf)
    path = scratch_path(spark, "model")
    save_model(model, spark, path)
    again = load_model(spark, path)
    pairs = {
        "dc": (model.dc(images), again.dc(images)),
        "kernels": (model.kernels(spark), again.kernels(spark)),
        "maps": (model.transform_maps(images, "all"), again.transform_maps(images, "all")),
        "nodes": (model.nodes(spark), again.nodes(spark)),
    }
    return C.concat_hops([differing_groups(a, b).select(F.lit(t).alias("tbl"), "n") for t, (a, b) in pairs.items()])


def differing_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``n``: hops and channels (or nodes) whose rows differ. Only a count and a hash sum per group leave a task."""
    keys = ["hop", "channel" if "channel" in a.columns else "node"]
    value = F.xxhash64(*a.columns).cast("decimal(38,0)")
    sides = [df.select(*keys, value.alias("x"), F.lit(sign).alias("one")) for df, sign in ((a, 1), (b, -1))]
    sums = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.sum("one").alias("rows"), F.sum(F.col("x") * F.col("one")).alias("x"))
    return sums.agg(F.count(F.when((F.col("rows") != 0) | (F.col("x") != 0), 1)).alias("n"))


# ---- settings ----


@query("SELECT 2 AS depth, hop, CAST(n AS BIGINT) AS n_kernels FROM (SELECT 0 AS hop, 4 AS n UNION ALL SELECT 1, 16) t "
       "WHERE EXISTS (SELECT 1 FROM embeddings)")
def depth_clamp(spark, sf):
    """Depth 5 with two specs gives two hops; with threshold 0 all four kernels go on, each to four kernels."""
    images = grey(spark, sf)
    model = SubspaceEstimator([SLIDE, SLIDE], depth=5, th1=0.0, th2=0.0).fit(images)
    return model.kernels(spark).groupBy("hop").agg(F.count(F.lit(1)).alias("n_kernels")).select(F.lit(model.depth).alias("depth"), "hop", "n_kernels")


@query("SELECT column_name AS name, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' "
       "ELSE lower(data_type) END AS type, n FROM information_schema.columns JOIN (" + " UNION ALL ".join(
           f"SELECT '{c}' AS column_name, count({c}) AS n FROM embeddings" for c in ("vec_id", "embedding", "label"))
       + ") USING (column_name) WHERE table_name = 'embeddings'")
def column_types(spark, sf):
    """Names and types from the schema, with the number of values that are not null."""
    data = table(spark, sf, "embeddings")
    filled = data.agg(*[F.count(c).alias(c) for c in data.columns])
    long = filled.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in data.columns])))
    return A.summary_types(data).join(F.broadcast(long), "name")
