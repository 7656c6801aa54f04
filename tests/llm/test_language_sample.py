"""The sample of the language model: every language has its rows, copies and texts without a letter take none."""

import numpy as np

from eigenloom.llm import language


def corpus(spark):
    r = np.random.default_rng(8)
    kinds = {"aa": ["the", "thing", "whoth", "ath"], "bb": ["ungen", "schu", "keit", "über"], "rare": ["zoq", "qox", "xoz", "oqqo"]}
    many = {"aa": 2500, "bb": 500, "rare": 3}
    data = [(x, " ".join(r.choice(kinds[x], 30))) for x, n in many.items() for _ in range(n)]
    data += [("bb", "ungen keit")] * 3000 + [("blank", t) for t in (None, "", " \n", "12 — !")]
    return spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(data)], "doc_id long, text string, lang string")


def test_rare_languages_are_fitted_and_predicted(spark):
    df = corpus(spark)
    model = language.fit_language(df)
    assert model.languages == ["aa", "bb", "rare"]
    got = model.predict(df.filter("lang = 'rare'")).collect()
    assert [r["lang_pred"] for r in got] == ["rare"] * 3


def test_sample_is_distinct_and_bounded(spark, monkeypatch):
    df = corpus(spark)
    _, picked = language._picked(df, None, "doc_id", "text", "lang", 600)
    assert len(set(picked)) == len(picked)
    assert {y: sum(p[0] == y for p in picked) for y in ("aa", "bb", "rare", "blank")} == {"aa": 200, "bb": 200, "rare": 3, "blank": 0}
    monkeypatch.setattr(language, "FIT_BYTES", 3000)
    monkeypatch.setattr(language, "LEAST_BYTES", 100)
    texts, picked = language._picked(df, None, "doc_id", "text", "lang", 600)
    assert 0 < sum(y == "aa" for y, _ in picked) < 20 and max(len(r["t"]) for r in texts.collect()) <= 1000
