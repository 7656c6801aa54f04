"""Every registered query without SQL, and the pipeline, on one written fixture, against plain Python."""

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from eigenloom.llm import pieces, toxicity
from eigenloom.llm.frames import BATCH_ROWS
from eigenloom.llm.queries import QUERIES
from eigenloom.llm.textops import Words
from pyspark.sql import functions as F
from tests.llm.test_text import crc, full_ids, prints, removed_by_force
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
LONG = " ".join(f"word{i % 977} und die" for i in range(9000))
ODD = [(9000, None), (9001, ""), (9002, " \n\t "), (9003, LONG), (9004, "ü"), (9005, "12 34 !?"), (9006, "der hund und die katze"), (9006, "der hund und die katze")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """The small tables with odd rows: null, empty, blank and very long texts, repeated rows."""
    out = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "de" if i == 9006 else None, "odd", 0 if t is None else len(t)) for i, t in ODD], docs.schema)
    docs.unionByName(odd).repartition(5).write.parquet(f"{out}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    more = spark.createDataFrame([(9001, 1, 0), (9003, None, None), (9006, 1, 0), (None, 1, 1)], labels.schema)
    labels.unionByName(more).write.parquet(f"{out}/labels.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def relabelled(spark, sf, tmp_path, table, column, keep, value):
    """A copy of the tables in which ``column`` of ``table`` is ``value`` in the rows whose id ``keep`` refuses."""
    out = str(tmp_path)
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == table:
            rows = [r.asDict() for r in df.collect()]
            for r in rows:
                if not keep(r["doc_id"]):
                    r[column] = value(r[column])
            df = spark.createDataFrame([tuple(r[c] for c in df.columns) for r in rows], df.schema)
        df.write.parquet(f"{out}/{name}.parquet")
    return out


def test_op1(spark, sf, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.load(path)
    want = []
    for k, t in texts:
        ids = np.frombuffer(model.encode(t or ""), "<u4")
        want.append((k, len(ids), crc(ids), model.decode(ids.tolist()) == (t or "")))
    assert sorted(map(tuple, QUERIES["op1_sentencepiece"](spark, sf).collect()), key=str) == sorted(want, key=str)
    assert all(w[3] for w in want)


def test_op4(spark, sf, texts, tmp_path):
    got = QUERIES["op4_toxicity"](spark, sf).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in texts)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    model = toxicity.fit_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"),
                                  use=F.crc32(F.coalesce(F.col("k").cast("string"), F.lit("")).cast("binary")) % 3 != 1)
    weight, by_text = dict(zip(model.buckets.tolist(), model.weights.tolist())), dict(texts)
    for r in got[::17]:  # the sum over distinct n-grams of one text, one by one
        raw = (by_text[r.doc_id] or "").encode()
        _, bucket = toxicity._present(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        z = model.bias + sum(np.float32(weight.get(b, 0.0)) for b in set(bucket.tolist()))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    other = relabelled(spark, sf, tmp_path, "labels", "toxic", lambda i: i is None or fold(i, 3) != 1, lambda v: None if v is None else 1 - v)
    again = {(r.doc_id, round(r.score, 9)) for r in QUERIES["op4_toxicity"](spark, other).collect()}
    assert again == {(r.doc_id, round(r.score, 9)) for r in got}  # labels of held-out rows are never read


def test_op5(spark, sf, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_ids"](spark, sf).collect()}
    at, want = 0, {}
    for k, t in sorted(texts, key=lambda r: r[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[k, at] = (len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_op6(spark, sf, texts):
    want = prints(texts)
    group = list(range(len(want)))
    for _ in range(4):
        for i, (_, a) in enumerate(want):
            group[i] = min(group[j] for j, (_, b) in enumerate(want) if (a ^ b).bit_count() <= 3)
    least = {g: min(k for (k, _), h in zip(want, group) if h == g) for g in group}
    got = QUERIES["op6_simhash"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((k, f"{f:016x}", least[g]) for (k, f), g in zip(want, group))


def test_op7(spark, sf, texts):
    got = QUERIES["op7_best_fit_packing"](spark, sf).collect()
    ids = full_ids("word_bpe_49k.json", texts, 1)
    want = [(k, p // 4096, p, len(i[p : p + 4096]), crc(i[p : p + 4096])) for k, i in ids for p in range(0, len(i), 4096)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for s in held.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= -(-sum(len(i) for _, i in ids) // 4096) * 1.01 + 1


def test_op8(spark, sf, texts, tmp_path):
    got = QUERIES["op8_language"](spark, sf).collect()
    by_text = dict(texts)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in texts)
    langs = {r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").filter("lang IS NOT NULL").select("lang").collect()}
    for r in got:
        letters = any(c.isalpha() for c in by_text[r.doc_id] or "")
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred in langs) if letters else (r.lang_pred == "und")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scored = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert np.mean(scored) > 0.9
    other = relabelled(spark, sf, tmp_path, "documents", "lang", lambda i: fold(i, 4) != 2, lambda v: "xx")
    again = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in QUERIES["op8_language"](spark, other).collect()}
    assert again == {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in got}


def test_op9(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = defaultdict(list)
    for r in QUERIES["op9_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    recall = []
    for q, got in found.items():
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        recall.append(len({ids[i] for i in order} & {v for v, _ in got}) / 20)
        assert len(got) == 20 and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        assert all(s == pytest.approx(score[ids == v][0], abs=1e-12) for v, s in got)
    assert np.mean(recall) >= 0.9


def test_op10(spark, sf, texts):
    got = QUERIES["op10_quality"](spark, sf).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in texts)
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    least = keys[max(1, round(0.5 * len(got))) - 1]
    assert all(r.sampled == (r.gumbel_key >= least) for r in got)
    assert all(r.score == pytest.approx(r.log_weight / max(r.n_grams, 1)) for r in got)
    for r in got:  # the Gumbel draw is the log weight plus noise that depends on the row alone
        assert np.isfinite(r.gumbel_key - r.log_weight)
    out, kept = [r.score for r in got if not r.accepted], [r.score for r in got if r.accepted]
    assert max(out) < min(kept)


def test_pipeline(spark, sf):
    before = spark.conf.get(BATCH_ROWS)
    whole = corpus_pipeline.run(spark, sf)
    assert spark.conf.get(BATCH_ROWS) == before
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    steps, given = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, sf)
        steps[name] = given.collect()
        if name != "packing":
            assert given.columns == docs.columns
    spark.conf.set(BATCH_ROWS, before)
    rows = {name: [(r.doc_id, r.text) for r in out] for name, out in steps.items() if name != "packing"}
    every = [(r.doc_id, r.text) for r in docs.collect()]
    for now, last in (("quality", every), ("toxicity", rows["quality"]), ("near_duplicates", rows["toxicity"])):
        assert not set(rows[now]) - set(last)
    gone = {k for k, _ in set(every) - set(rows["quality"])}
    assert not [k for k in gone if k in labels and labels[k].quality == 1][1:]  # at most one good labelled document is lost
    gone = {k for k, _ in set(rows["quality"]) - set(rows["toxicity"])}
    assert not [k for k in gone if k in labels and labels[k].toxic == 0][1:]
    want = prints(rows["toxicity"])
    group = list(range(len(want)))
    for _ in range(4):
        for i, (_, a) in enumerate(want):
            group[i] = min(group[j] for j, (_, b) in enumerate(want) if (a ^ b).bit_count() <= 3)
    first = {g: min(k for (k, _), h in zip(want, group) if h == g) for g in group}
    assert sorted(k for k, _ in rows["near_duplicates"]) == sorted(first.values())
    cut = {k: d for k, _, _, d in removed_by_force(rows["near_duplicates"], 50)}
    for k, t in rows["repeated_passages"]:
        assert hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest() == cut[k] or not (t or "").isascii()
    ids = full_ids("word_bpe_49k.json", rows["repeated_passages"], 1)
    assert sorted((r.doc_id, r.start, r.length) for r in steps["packing"]) == sorted((k, p, len(i[p : p + 4096])) for k, i in ids for p in range(0, len(i), 4096))
    assert sorted(tuple(r)[:5] for r in whole.collect()) == sorted(tuple(r)[:5] for r in steps["packing"])
