"""What a Python worker of the pipeline takes while a task runs, and what it still holds afterwards, in a process of its own."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORKER = """
import numpy as np
import pyarrow as pa
from eigenloom.llm import quality, simhash, toxicity

def mb(name):
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(name)) / 1024

r = np.random.default_rng(5)
words = np.array(["w%d" % i for i in range(5000)])
texts = [" ".join(r.choice(words, 400)) for _ in range(1200)]
col = lambda x: pa.array(x, pa.int64())
batch = pa.record_batch([col(range(1200)), col(range(1200)), pa.array(texts), col([i % 2 for i in range(1200)])], ["k", "th", "t", "y"])
run = {"quality": quality._count, "toxicity": toxicity._tally, "simhash": simhash._fingerprints(3)}[NAME]
before = mb("VmRSS")
for out in run(iter([batch])):
    pass
print(mb("VmHWM") - before, mb("VmRSS") - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads Linux's figures of a process")
@pytest.mark.parametrize("name, peak, rest", [("quality", 30, 20), ("toxicity", 130, 60), ("simhash", 28, 12)])
def test_a_worker_takes_little_and_gives_it_back(name, peak, rest):
    env = os.environ | {"PYTHONPATH": REPO, "OMP_NUM_THREADS": "1"}
    out = subprocess.run([sys.executable, "-c", f"NAME = {name!r}\n" + WORKER], cwd=REPO, env=env, capture_output=True, text=True, check=True).stdout
    most, left = map(float, out.split())
    assert most < peak and left < rest, (most, left)
