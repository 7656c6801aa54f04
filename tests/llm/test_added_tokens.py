"""Token ids of the queries against the library at its defaults, where texts hold strings of added tokens."""

import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from eigenloom.llm import queries, tokens

END, START = "<|endoftext|>", "<|startoftext|>"
TEXTS = [f"end of one {END} next", END, f"{END}{END} a", f"x{END}b c", f"a  {START}  b \n", f"A <|ENDOFTEXT|> {START}{END}. naïve 日本", f"tail \n {END}", "no such string", "", None, f"é {END}́ <|endof{END}text|>"]


@cache
def plain(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def library(name, text, end=()):
    return [*plain(name).encode(text or "", add_special_tokens=False).ids, *end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_are_taken_out_first(name, lead):
    enc = tokens.Encoder(public_tokenizers.path(name), lead, added=True)
    r = np.random.default_rng(4)
    parts = [END, START, " ", "  ", "\n", "a", " the", "Ärger", "日本", "don't", "<|", "|>", "́", "12"]
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(parts, n)) for n in r.integers(0, 20, 400)]
    for _ in range(2):
        assert enc.encode(texts) == [np.asarray(library(name, t), "<u4").tobytes() for t in texts]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("added")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_op5_takes_the_library_default(spark, sf):
    at = 0
    for r in sorted(queries.op5_token_ids(spark, sf).collect(), key=lambda r: r["start"]):
        want = library("byte_bpe_50k.json", TEXTS[r["doc_id"]], [2])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), crc(want))
        at += len(want)
    assert at == sum(len(library("byte_bpe_50k.json", t, [2])) for t in TEXTS)


def test_op7_and_packing_stage_take_the_library_default(spark, sf):
    want = [(i, len(x), crc(x)) for i, x in enumerate(library("word_bpe_49k.json", t, [1]) for t in TEXTS)]
    stage = corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    for got in (queries.op7_best_fit_packing(spark, sf), stage):
        assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in got.collect()) == want


@pytest.mark.parametrize(("name", "lead"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("long", [1, 7, 1 << 20])
def test_long_texts_are_cut_where_nothing_is_joined(name, lead, long, monkeypatch):
    monkeypatch.setattr(tokens, "LONG", long)
    texts = ["a  b   c d\n\n e 'll don't  x ", " lead  and\ttab \r\n 12 3,4 !? ", "Über ñandú, l'été  ß", "日本 and 語 mixed  words", "", " ", "x" * 50 + " y" * 40]
    enc = tokens.Encoder(public_tokenizers.path(name), lead, True)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == [plain(name).encode(t, add_special_tokens=False).ids for t in texts]
