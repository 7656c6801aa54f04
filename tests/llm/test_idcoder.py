"""What the coder of token ids needs: steps, bits, memory; and ids that its contexts and lanes make difficult."""

import os
import subprocess
import sys

import numpy as np
import pytest

from eigenloom.llm import idcoder

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORKER = """
import numpy as np
from eigenloom.llm import idcoder

def mb(name):
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(name)) / 1024

docs = [np.random.default_rng(3).integers(0, 2000, 1 << 22, dtype=np.uint32).tobytes()]
before = mb("VmRSS")
idcoder.decode_segment(idcoder.encode_segment([1], docs))
print(mb("VmHWM") - before)
"""


def skewed(r, n, top=4000):
    p = 1 / (np.arange(top) + 10.0)
    p /= p.sum()
    return (r.choice(top, n, p=p) * 12).astype("<u4"), float(-(p * np.log2(p)).sum())


def back(ids):
    data = idcoder.encode_segment([7], [ids.tobytes()])
    _, _, out = idcoder.decode_segment(data)
    assert (out == ids).all()
    return 8 * len(data) / len(ids)


def test_many_lanes_are_coded_in_few_steps(monkeypatch):
    steps, run = [], idcoder._run

    def counted(coder, sizes, ids, wide):
        steps.append(int(sizes[0]))
        return run(coder, sizes, ids, wide)

    monkeypatch.setattr(idcoder, "_run", counted)
    back(skewed(np.random.default_rng(4), 1_100_000)[0])
    assert sum(steps) <= 2 * 512  # to encode and to decode


@pytest.mark.parametrize("n, above", [(60_000, 1), (300_000, 0.5)])
def test_lanes_of_a_block_learn_from_each_other(n, above):
    ids, entropy = skewed(np.random.default_rng(5), n)
    assert back(ids) < entropy + above


def test_contexts_predict_what_repeats():
    passage = np.random.default_rng(6).integers(0, 50_000, 3000).astype("<u4")
    assert back(np.tile(passage, 100)) < 2
    assert back(np.zeros(100_000, "<u4")) < 0.5


@pytest.mark.parametrize("lanes", [1, 3, 100])
def test_odd_ids_in_blocks_of_any_size(monkeypatch, lanes):
    monkeypatch.setattr(idcoder, "LANES", lanes)
    r = np.random.default_rng(8)
    edge = np.array([0, 1, 65535, 65536, 65537, 2**31, 2**32 - 1])
    for ids in (edge, r.choice(edge, 3000), r.choice(edge[:3], 3000), np.tile(r.integers(0, 2**32, 40), 50), np.arange(70_000)[::7]):
        back(ids.astype("<u4"))


def test_every_kind_of_damage_is_an_error():
    data = bytearray(idcoder.encode_segment([7], [skewed(np.random.default_rng(9), 20_000)[0].tobytes()]))
    for at in np.random.default_rng(10).integers(40, len(data) - 80, 12).tolist():
        hurt = bytearray(data)
        hurt[at] ^= 0x55
        with pytest.raises(ValueError):
            idcoder.decode_segment(bytes(hurt))
    with pytest.raises(ValueError):
        idcoder.decode_segment(bytes(data[:-500]))


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads Linux's figures of a process")
def test_a_whole_segment_takes_little_memory():
    env = os.environ | {"PYTHONPATH": REPO, "OMP_NUM_THREADS": "1"}
    out = subprocess.run([sys.executable, "-c", WORKER], cwd=REPO, env=env, capture_output=True, text=True, check=True).stdout
    assert float(out) < 125, out
