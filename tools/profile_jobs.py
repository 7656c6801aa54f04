"""Seconds, jobs, bytes read and bytes shuffled of fits and scores, from Spark's event log.

``profile_jobs.py [sf_dir] [copies]``: every image is read ``copies`` times over, to see what grows with the data.
"""

import glob
import json
import os
import sys
import tempfile
import time
from collections import defaultdict

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from eigenloom import HopSpec, SubspaceEstimator  # noqa: E402
from eigenloom.operators.channels import concat_hops  # noqa: E402
from eigenloom.plans.queries import TH1, TH2, colour, grey, table  # noqa: E402
from eigenloom.sources.images import vectors_from_array  # noqa: E402

TREES = {
    "depth1": (grey, [HopSpec(2, 1)], TH1, TH2),
    "depth1 bias": (grey, [HopSpec(2, 1, need_bias=True)], TH1, TH2),
    "depth2 bias": (grey, [HopSpec(2, 1, need_bias=True)] * 2, TH1, TH2),
    "depth3 bias": (grey, [HopSpec(2, 1, need_bias=True)] * 3, 0.03, 0.001),
    "36 features": (colour, [HopSpec(3, 1)], TH1, 0.0),
    "64 features": (lambda spark, sf: vectors_from_array(table(spark, sf, "embeddings"), "vec_id", "embedding", 64), [HopSpec(1, 1)], TH1, 0.0),
}


def main(sf: str, copies: int) -> None:
    log = tempfile.mkdtemp(prefix="eigenloom-events-")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.dir", f"file:{log}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, (frame, specs, th1, th2) in TREES.items():
        images = concat_hops([frame(spark, sf)] * copies)
        est = SubspaceEstimator(specs, th1=th1, th2=th2)
        model = est.fit(images)
        for step, work in (("fit", lambda: est.fit(images)),
                           ("score", lambda: model.transform(images).write.format("noop").mode("overwrite").save())):
            spark.sparkContext.setJobGroup(f"{name} {step}", "")
            start = time.perf_counter()
            work()
            seconds[f"{name} {step}"] = time.perf_counter() - start
            spark.sparkContext.setJobGroup("", "")
    spark.stop()
    group, total = {}, defaultdict(lambda: defaultdict(int))
    for path in glob.glob(f"{log}/**/*", recursive=True):
        for line in open(path) if os.path.isfile(path) and not path.endswith(".crc") else ():
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                g = e["Properties"].get("spark.jobGroup.id", "")
                total[g]["jobs"] += 1
                group.update({s: g for s in e["Stage IDs"] if s not in group})
            elif e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                t, m = total[group.get(e["Stage ID"], "")], e["Task Metrics"]
                t["tasks"] += 1
                t["read"] += m["Input Metrics"]["Records Read"]
                t["shuffled"] += m["Shuffle Write Metrics"]["Shuffle Bytes Written"]
                t["records"] += m["Shuffle Write Metrics"]["Shuffle Records Written"]
    for name, s in seconds.items():
        t = total[name]
        print(f"{name:20s} {s:6.2f} s  {t['jobs']:3d} jobs  {t['tasks']:4d} tasks  {t['read']:9d} rows read  {t['shuffled']:8d} bytes and {t['records']:6d} records shuffled")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1", int(sys.argv[2]) if len(sys.argv) > 2 else 1)
