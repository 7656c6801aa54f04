"""Plain texts cut into parts many at once, and parts found again without a look into the caches."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eigenloom.llm import tokens

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
BITS = [*"ab sS tdmrvel'1 2!?\t\n\r ''é À ÿ-<|", "'s", "'re", "'ll", "'VE", "'d", " '", "\n'", "  ", "1'", "''", "don't", "incomprehensibilities", "日"]


def some_texts(seed, plain):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(BITS[:-1] if plain else BITS, n)) for n in r.integers(1, 30, 400)]


def ids(enc, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)]


@pytest.mark.parametrize("lead", [True, False])
def test_parts_are_those_of_the_pattern(lead):
    texts = [t if lead else t.lower() for t in some_texts(1, True)]
    raw = b"".join(t.encode() + bytes(3) for t in texts)
    begin, end, upto = tokens.plain_parts(np.frombuffer(raw, np.uint8), lead)
    parts = [raw[b:e].decode() for b, e in zip(begin, end)]
    pattern = tokens._BYTE_PARTS if lead else tokens._WORD_PARTS
    assert [parts[b:e] for b, e in zip([0, *upto], upto)] == [pattern.findall(t) for t in texts]
    assert upto[-1] == len(parts)


@pytest.mark.parametrize(("name", "lead"), FILES)
@pytest.mark.parametrize("slots", [1, 4, 19])
def test_parts_that_share_a_slot(name, lead, slots, monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", slots)
    ours, theirs = tokens.Encoder(public_tokenizers.path(name), lead, True), Tokenizer.from_file(public_tokenizers.path(name))
    for seed in (2, 3, 2):
        texts = [*some_texts(seed, False), "", " ", "\n"]
        assert ids(ours, texts) == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids(ours, [" "]) == [theirs.encode(" ", add_special_tokens=False).ids] and ids(ours, [""]) == [[]]


@pytest.mark.parametrize(("name", "lead"), FILES)
def test_known_parts_are_not_looked_up_one_by_one(name, lead, monkeypatch):
    enc = tokens.Encoder(public_tokenizers.path(name), lead)
    texts = ["Some words, and the same words again.", "again the words"]
    want = ids(enc, texts)
    asked = []
    monkeypatch.setattr(enc, "_learn_parts", lambda parts: asked.extend(parts))
    assert ids(enc, texts) == want and not asked


@pytest.mark.parametrize(("name", "lead"), FILES)
def test_new_words_do_not_walk_through_the_caches(name, lead):
    class Still(tokens.Recent):
        def __iter__(self):
            raise AssertionError("walked through")

    enc = tokens.Encoder(public_tokenizers.path(name), lead)
    enc.heads, enc.words, enc.parts = Still(), Still(), Still()
    theirs = Tokenizer.from_file(public_tokenizers.path(name))
    for texts in (["plain words"], ["other 日本 words"], ["newer words, 語 too", "and plain"]):
        assert ids(enc, texts) == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("name", "lead"), FILES)
@pytest.mark.parametrize("long", [1, 5])
def test_long_texts_without_spaces_are_cut(name, lead, long, monkeypatch):
    monkeypatch.setattr(tokens, "LONG", long)
    enc, theirs, sizes = tokens.Encoder(public_tokenizers.path(name), lead, True), Tokenizer.from_file(public_tokenizers.path(name)), []
    put = enc._put
    monkeypatch.setattr(enc, "_put", lambda some, out: (sizes.append(sum(len(t) for _, t in some)), put(some, out)))
    texts = [*some_texts(5, True), *(t.replace(" ", "") for t in some_texts(6, True))]
    assert ids(enc, texts) == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    sizes.clear()
    assert ids(enc, ["ab1,c2.d34;" * 9]) == [theirs.encode("ab1,c2.d34;" * 9, add_special_tokens=False).ids]
    assert max(sizes) <= long + 3
