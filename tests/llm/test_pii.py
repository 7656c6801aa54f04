"""Personal data: base spans against the plain forms, and patterns that find what no form sees."""

import hashlib
import re

import pytest
from eigenloom.llm import pii as P
from eigenloom.llm.queries import QUERIES
from hypothesis import given, settings
from hypothesis import strategies as st

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(t):
    """Spans of the forms as they are written."""
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def ours(t):
    return [f"{P.KINDS[k]}:{b}:{e}" for k, b, e in P.base_spans(t)]


TEXTS = [
    "a@b.c@d.e x..@y.z @q.r p@q p@q. p@-.-.- ü@x.yz aü@x.y.",
    "1.2.3.4.5.6.7.8.9 256.1.1.1.2.3.4.5 001.02.3.0000255 .1.2.3.4. 1.2.3 1..2.3.4",
    "4111111111111111 4111 1111-1111 1111 41111111111111112222 4111  1111 1111 1111 4012888888881881-",
    "+1 (377) 555-0271 +12 +1-2-3-4-5-6-7-8- ++49 30 123456 +1 (377) 555-0271 +1 5550271, +123456789012345678",
    "ÄÖ +49 (0)30.1234567\n34@mail7.example.com,248.40.198.62",
    "", "@", "+", "1", "....", "1.1.1.1@1.1.1.1",
]


@pytest.mark.parametrize("t", TEXTS)
def test_base_spans_on_given_texts(t):
    assert ours(t) == plain(t)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="014925.@+- ()abü\n", max_size=60))
def test_base_spans(t):
    assert ours(t) == plain(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" * 100_000, "@" * 200_000, "a@b" * 100_000, "(1) " * 80_000, "a:" * 100_000, "[at]" * 50_000):
        P.candidates(t, P.base_spans(t))


def test_candidates():
    t = "mail (me [at] mail (dot) com) tel 030/123 45 67, v6 2001:db8::1 at 12:30:45, user@localhost. x12345678 4111.1111.1111.1111"
    found = {t[b:e]: (kinds, name) for kinds, b, e, name in P.candidates(t, P.base_spans(t))}
    assert found["me [at] mail (dot) com"] == (1 << P.EMAIL, "eme@mail.com")
    assert found["030/123 45 67"] == (1 << P.PHONE, "d0301234567")
    assert found["2001:db8::1"] == (1 << P.IP, "i2001:db8::1")
    assert found["user@localhost"][0] == 1 << P.EMAIL
    assert found["4111.1111.1111.1111"] == (1 << P.CARD, "d4111111111111111")
    assert not any("12345678" in k for k in found)
    assert P.candidates(t, [(0, 0, len(t))]) == []


def corpus():
    """Seeds behind 'my card number:' and 'call me on', the same contexts before unseen spellings, and numbers in common contexts."""
    def card(n):
        body = f"41{n:013d}"
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    filler = "and so the story goes on with many plain words and the rest of the day "
    docs = [f"{filler}my card number: {card(n * 37)} {filler}" for n in range(20)]
    docs += [f"{filler}please call me on +49 30 55501{n:02d} today {filler}" for n in range(20)]
    docs += [f"{filler * 3}the {n + 1000000} and {filler}" for n in range(20)]
    unseen = [f"{filler}my card number: 378282246310005 {filler}", f"{filler}please call me on 0171 5550199 today {filler}"]
    plain_ = [f"{filler}the 5551234567 and {filler}"]
    return docs + unseen + plain_


def rows(spark, docs):
    return {r.doc_id: r for r in QUERIES["op11_personal_data"](spark, docs).collect()}


def test_query(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame([*enumerate(docs), (900, None), (901, ""), (None, TEXTS[4]), (40, docs[40]), (40, docs[40])], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op11_personal_data"](spark, str(tmp_path))
    assert df.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = df.collect()
    assert len(got) == len(docs) + 5
    text = {**dict(enumerate(docs)), 900: "", 901: "", None: TEXTS[4]}
    added = {}
    for r in got:
        want = plain(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in FORMS]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(want) <= set(spans)
        order = [(list(FORMS).index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)
        for s in set(spans) - set(want):
            kind, b, e = s.split(":")
            added[text[r.doc_id][int(b) : int(e)]] = kind
    assert added == {"378282246310005": "card", "0171 5550199": "phone"}  # and not the number after 'the'


def test_same_number_spelt_otherwise(spark):
    df = spark.createDataFrame([(1, "pay 4111 1111 1111 1111 now"), (2, "was 4111.1111.1111.1111 it"), (3, "or 4111.1111.1111.1112 it")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.find_pii(df).collect()}
    assert [(s.kind, s.b, s.e) for s in got[2]] == [(P.CARD, 4, 23)] and got[3] == []


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "x", 1)], "doc_id long, text string, spans string, k int")
    assert [tuple(r.base[0]) for r in P.find_pii(df).collect()] == [(P.EMAIL, 0, 6)]
    assert P.find_pii(df.limit(0)).count() == 0


def test_rounds_go_on_from_what_was_found(spark):
    """A second context is learnt only from numbers that the first one vouched for."""
    filler = "and so the story goes on with many plain words and the rest of the day "
    docs = [f"{filler}call me on +49 30 55501{n:02d} today {filler}" for n in range(20)]
    new = [f"0171 55502{n:02d}" for n in range(6)]
    docs += [f"{filler}call me on {x} today {filler} ring his mobile {x} now {filler}" for x in new]
    docs += [f"{filler}ring his mobile 0172 5559999 now {filler}"]
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    last = len(docs) - 1
    assert [len(r.spans) for r in P.find_pii(df, rounds=1).collect() if r.doc_id == last] == [0]
    assert [len(r.spans) for r in P.find_pii(df).collect() if r.doc_id == last] == [1]


def test_patterns_hash_alike_in_both_scans():
    import numpy as np
    from eigenloom.llm import textops as X

    text = "Ünï Call me: 42 on\tÀB-7 now".encode()
    words = X.Words(P._plain(np.frombuffer(text, np.uint8)), np.array([0, len(text)]))
    assert (words.hashes() == P._hashed(text.decode().split())).all()
