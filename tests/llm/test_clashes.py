"""Columns whose names clash with results, labels of one kind, junk languages, and settings of the session."""

import warnings

import numpy as np
import public_tokenizers
import pytest
from eigenloom.llm import frames
from eigenloom.llm import language as L
from eigenloom.llm import packing as P
from eigenloom.llm import pieces
from eigenloom.llm.quality import fit_quality
from eigenloom.llm.toxicity import fit_toxicity
from pyspark.sql import functions as F


def test_results_replace_columns_of_their_name(spark):
    df = spark.createDataFrame([(1, "a plain text", "x", 7, "y")], "doc_id long, text string, Score string, predicted int, lang_pred string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert fit_toxicity(df, labels).score(df).columns == ["doc_id", "text", "lang_pred", "score", "predicted"]
    assert L.fit_language(df.withColumn("lang", F.lit("en"))).predict(df).columns == ["doc_id", "text", "predicted", "lang_pred", "score"]
    assert fit_quality(df, labels).score(df).columns == ["doc_id", "text", "predicted", "lang_pred", "n_grams", "log_weight", "score", "accepted"]
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encode(df.withColumn("ids", F.lit(0)), model)
    back = pieces.decode(ids.withColumn("decoded", F.lit(0)), model)
    assert ids.columns.count("ids") == 1 and back.select("decoded").first()[0] == "a plain text"
    packed = P.pack(spark.createDataFrame([(1, 5, 9, 9)], "doc_id long, length int, sequence_id int, offset int"))
    assert packed.columns == ["doc_id", "length", "sequence_id", "offset"] and tuple(packed.first()) == (1, 5, 0, 0)


@pytest.mark.parametrize("toxic", [0, 1, None])
def test_labels_of_one_kind_reject_nothing(spark, toxic):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(5)] + [(None, None)], "doc_id long, text string")
    model = fit_toxicity(df, spark.createDataFrame([(i, toxic) for i in range(5)], "doc_id long, toxic int"))
    assert model.score(df, reject=True).count() == 6
    assert {(r.predicted, r.score < 1e-200) for r in model.score(df).collect()} == {(0, True)}


def test_a_column_of_junk_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 3)
    common = [(i, f"der hund und die katze {i}", "de") for i in range(9)] + [(20 + i, f"the dog and the cat {i}", "en") for i in range(8)]
    df = spark.createDataFrame(common + [(100 + i, f"junk text {i}", f"x{i:02d}") for i in range(40)], "doc_id long, text string, lang string")
    assert L.fit_language(df).languages == ["de", "en", "x00"]


def test_settings_of_the_session_come_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError):
        with frames.text_batches(spark):
            assert spark.conf.get(name) == "1000"
            raise RuntimeError
    assert spark.conf.get(name) == before


def test_grouped_plans_reach_best_fit():
    """Linear grouping alone needs no more sequences than plain best fit on a histogram like that of the tables; and it holds every length."""
    rng = np.random.default_rng(4)
    lengths = np.clip(np.r_[rng.gamma(2, 500, 9000), np.full(300, 4096), rng.integers(1, 300, 1500)].astype(int), 1, 4096)
    values, counts = np.unique(lengths, return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist()))
    runs = P.plan(histogram)
    best_fit = P.grouped_plan(histogram, 4096, 1.0)  # nothing counts as large
    assert sum(c for _, c, _ in runs) <= sum(c for _, c, _ in best_fit)
    held: dict = {}
    for _, count, holds in runs:
        at = 0
        for n, offset in sorted(holds, key=lambda h: h[1]):
            assert offset == at
            at += n
            held[n] = held.get(n, 0) + count
        assert at <= 4096
    assert held == histogram


def test_a_plan_that_is_cut_short_says_so(monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 1)
    with pytest.warns(UserWarning, match="short of the optimum"):
        P.grouped_plan({520 + 37 * i: 50 for i in range(30)}, 4096, 1 / 8)
    monkeypatch.undo()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        P.grouped_plan({520 + 37 * i: 50 for i in range(30)}, 4096, 1 / 8)
