"""Two levels with pooling, once as an estimator and once step by step: ``two_levels.py [sf_dir]``."""

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from eigenloom import HopSpec, SubspaceEstimator  # noqa: E402
from eigenloom.operators.channels import filter_channels  # noqa: E402
from eigenloom.operators.kernels import filter_report  # noqa: E402
from eigenloom.plans.steps import fit_channelwise, fit_joint  # noqa: E402
from eigenloom.sources.images import as_images  # noqa: E402


def main(sf: str) -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    images = as_images(table, "vec_id", F.col("embedding"), (8, 8, 1), "label")

    level = HopSpec(window=2, stride=1, ddof=0, pool_after=2)
    model = SubspaceEstimator([level, level], th1=0.249, th2=0.05).fit(images)
    filter_report(model.kernels(spark)).orderBy("hop", "role").show()
    model.features(images, keep=("label",)).show(3)

    step = HopSpec(window=2, stride=1, ddof=0)
    kernels, maps, _ = fit_joint(images, spec=step)
    forward, forward_kernels, emitted, _, report = filter_channels(maps, kernels, th1=0.249, th2=0.05)
    report.show()
    energy = {r.channel: r.energy for r in forward_kernels.select("channel", "energy").collect()}
    kernels, maps, _ = fit_channelwise(forward, energy, step)
    kernels.select("node", "kidx", "channel", "energy").show()
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
