"""Text operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from eigenloom.llm import idcoder, packing, pieces, quality, simhash, substring_dedup, tokens, toxicity
from eigenloom.llm.frames import LAST
from eigenloom.llm.language import fit_language, forward_backward

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def docs(spark, rows, more="lang string, k string, __k int"):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], f"doc_id long, text string, {more}")


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    words = ["w%d" % i for i in range(400)] + ["é", "Ärger", "<|endoftext|>", "▁x", "don't", "3½", "naïvé"]
    text = lambda n: " ".join(r.choice(words, n))
    shared = text(70)
    out = [(1, "a " + shared + " b"), (2, text(90) + "\n" + shared), (3, shared), (3, shared), (4, None), (5, ""), (6, "  \t\n"), (None, shared), (7, text(60))]
    out += [(8, text(60) + " " + shared[: len(shared) // 2]), (9, text(9000)), (10, "A b"), (11, "a B"), (12, "z" * 3000), (13, "x  y   z\r\n q ")]
    base = text(300).split(" ")
    for i in range(20, 40):
        one = list(base)
        one[i] = "changed%d" % i
        out.append((i, " ".join(one)))
    return out


def words(t):
    return WORD.findall((t or "").encode())


def removed_by_force(rows, window):
    low = {}
    for k, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            low[x] = min(low.get(x, LAST), LAST if k is None else k)
    out = []
    for k, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if low[tuple(w[i : i + window])] < (LAST if k is None else k):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "group"), [(50, 32768), (50, 1), (12, 3), (5, 2)])
def test_substring_dedup(spark, rows, window, group, monkeypatch):
    real = substring_dedup._with_spans
    monkeypatch.setattr(substring_dedup, "_with_spans", lambda *a: real(*a, group))
    got = substring_dedup.repeat_digest(docs(spark, rows), window=window).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, removed_by_force(rows, window)))


def test_strip_repeats_keeps_columns_and_other_text(spark, rows):
    df = docs(spark, rows)
    got = substring_dedup.strip_repeats(df)
    assert got.columns == df.columns
    want = {(k, d) for k, _, _, d in removed_by_force(rows, 50)}
    assert {(r["doc_id"], hashlib.sha256(b" ".join(words(r["text"]))).hexdigest()) for r in got.collect()} == want
    assert substring_dedup.strip_repeats(df.limit(0)).count() == 0


def joined_rows(plan):
    """Rows out of each join of an executed plan."""
    name, out = plan.nodeName(), []
    if name.startswith("AdaptiveSparkPlan"):
        return joined_rows(plan.executedPlan())
    if "QueryStage" in name or name == "ResultQueryStage":
        return joined_rows(plan.plan())
    if "Join" in name:
        out.append(plan.metrics().get("numOutputRows").get().value())
    children = plan.children()
    return out + [n for i in range(children.size()) for n in joined_rows(children.apply(i))]


@pytest.mark.parametrize("group", [32768, 2])
def test_a_text_meets_one_row_for_each_of_its_different_pieces(spark, group, monkeypatch):
    line = " ".join("l%d" % i for i in range(13))
    rows = [(i, f"a{i} " + " ".join([line] * (20 + i)) + f" z{i}") for i in range(30)]
    found = []
    real = substring_dedup._with_spans
    monkeypatch.setattr(substring_dedup, "_with_spans", lambda *a: found.append(real(*a, group)) or found[0])
    monkeypatch.setattr(substring_dedup, "COPIES", 8)
    got = substring_dedup.repeat_digest(docs(spark, rows))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, removed_by_force(rows, 50)))
    # one line over and over: hundreds of windows in a text, but few different pieces
    assert max(joined_rows(got._jdf.queryExecution().executedPlan())) <= 10 * len(rows)


def prints(rows):
    out = []
    for k, t in rows:
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        out.append((k, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return out


@pytest.mark.parametrize("long_list", [1024, 2])
def test_simhash(spark, rows, long_list, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", long_list)
    want = prints(rows)
    group = list(range(len(want)))
    for _ in group:
        for i, (_, a) in enumerate(want):
            group[i] = min(group[j] for j, (_, b) in enumerate(want) if (a ^ b).bit_count() <= 3)
    ids = [LAST if k is None else k for k, _ in want]
    least = {g: min(ids[i] for i in range(len(ids)) if group[i] == g) for g in group}
    got = simhash.near_duplicates(docs(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((k, f"{f:016x}", None if least[g] == LAST else least[g])) for (k, f), g in zip(want, group))
    kept = simhash.keep_first(docs(spark, rows)).collect()
    assert len(kept) == len(set(group))
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_long_lists_are_looked_up_exactly():
    r = np.random.default_rng(5)
    fps = np.unique(r.integers(0, 1 << 12, 600).astype(np.uint64) << np.uint64(20))
    a, b = simhash._near_in_long_run(fps, 3)
    want = {(int(x), int(y)) for x in fps for y in fps if x < y and (int(x) ^ int(y)).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want


def full_ids(name, rows, end):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True
    return [(k, tok.encode(t or "", add_special_tokens=False).ids + [end]) for k, t in rows]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, rows, capacity):
    got = packing.pack_documents(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), capacity=capacity).collect()
    want = [(k, p // capacity, p, len(ids[p : p + capacity]), crc(ids[p : p + capacity])) for k, ids in full_ids("word_bpe_49k.json", rows, 1) for p in range(0, len(ids), capacity)]
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= capacity
    assert packing.pack_documents(docs(spark, rows).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_plan_holds_every_length_once():
    r = np.random.default_rng(1)
    for n in (0, 1, 50, 3000):
        lengths = r.integers(1, 4097, n)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        runs = packing.plan(histogram)
        have = defaultdict(int)
        for _, count, holds in runs:
            for size, _ in holds:
                have[size] += count
        assert dict(have) == histogram
        made = sum(c for _, c, _ in runs)
        assert made <= 1.04 * -(-int(lengths.sum()) // 4096) + 2 or n < 100


def test_token_id_files(spark, rows, tmp_path):
    path = str(tmp_path / "ids")
    idcoder.write_ids(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), path)
    got = idcoder.read_ids(spark, path).collect()
    ids = {}
    for k, x in full_ids("byte_bpe_50k.json", rows, 2):
        ids.setdefault(k, []).append(x)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in rows if k is not None)) + [None]
    at = 0
    for r in got:
        assert r["start"] == at and r["ids"] in ids[r["doc_id"]] and r["ids_crc32"] == crc(r["ids"])
        at += r["n_tokens"]


@pytest.mark.parametrize("name,lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("cache", [0, 20, 150_000])
def test_word_caches_of_any_size_give_the_library_ids(name, lead, cache, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", cache)
    r = np.random.default_rng(5)
    words = ["the", "The", "don't", "Ärger", "naïvé.\nEz", "日本", "12345", "a\u3000b", "", "<|endoftext|>", "x\t\ty", "!?%%", "ß", "\n", "q\xa0q"]
    words += ["".join(r.choice(list("abcdeXYZ"), 5)) for _ in range(60)]
    texts = [" ".join(r.choice(words, n)) for n in r.integers(0, 40, 120)]
    ours, theirs = tokens.Encoder(public_tokenizers.path(name), lead), Tokenizer.from_file(public_tokenizers.path(name))
    theirs.encode_special_tokens = True
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        want = [np.asarray(x.ids, "<u4").tobytes() for x in theirs.encode_batch(part, add_special_tokens=False)]
        assert ours.encode(part) == want


def test_segments_take_blocks_by_their_size(monkeypatch):
    monkeypatch.setattr(idcoder, "LANES", 8)
    r = np.random.default_rng(7)
    for n in (1, 255, 256, 257, 511, 512, 513, 1024, 1025, 9000):
        ids = np.minimum(r.geometric(0.01, n), 65535).astype("<u4")
        found, sizes, out = idcoder.decode_segment(idcoder.encode_segment([4, 9], [ids[: n // 2].tobytes(), ids[n // 2 :].tobytes()]))
        assert found.tolist() == [4, 9] and sizes.tolist() == [n // 2, n - n // 2] and (out == ids).all()


def test_segments_round_trip_and_find_damage():
    r = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 5), (9000, 50), (5000, 2**31)):
        ids = r.integers(0, top, n).astype("<u4")
        data = idcoder.encode_segment([1, LAST], [ids.tobytes(), b""])
        found, sizes, out = idcoder.decode_segment(data)
        assert found.tolist() == [1, LAST] and sizes.tolist() == [n, 0] and (out == ids).all()
    with pytest.raises(ValueError):
        idcoder.decode_segment(data[:-4000] + bytes(8) + data[-3992:])


def test_pieces_against_plain_viterbi(spark, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.load(path)
    scores = {text: value for text, value in ((k, model.automaton.get(k)) for k in model.automaton.keys())}
    for chunk in ("▁hello", "▁▁▁x", "▁naïvé日本𝔘", "▁w123", "▁" + "ab" * 50):
        best = [(0.0, [])] + [(float("-inf"), [])] * len(chunk)
        for e in range(1, len(chunk) + 1):
            for b in range(max(0, e - 16), e):
                piece = scores.get(chunk[b:e])
                if piece and best[b][0] + piece[1] > best[e][0]:
                    best[e] = (best[b][0] + piece[1], [*best[b][1], piece[2]])
            if best[e][0] == float("-inf"):
                best[e] = (best[e - 1][0] + pieces.BYTE_SCORE * len(chunk[e - 1].encode()), best[e - 1][1] + [model.byte_ids[x] for x in chunk[e - 1].encode()])
        assert model.segment(chunk) == best[-1][1]
    got = pieces.round_trip(docs(spark, rows), path).collect()
    assert len(got) == len(rows) and all(r["exact"] for r in got)
    both = pieces.decode(pieces.encode(docs(spark, rows), path), path).filter("NOT decoded <=> text")
    assert both.count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(7)
    calm, rude = ["w%d" % i for i in range(200)], ["vexible", "vexing", "vexator"]
    data = []
    for i in range(600):
        w = list(r.choice(calm, 40))
        if i % 3 == 0:
            w[5:7] = r.choice(rude, 2)
        if i % 3 == 0 or i % 7 == 0:
            w[9] = "women"
        data.append((i, " ".join(w), int(i % 3 == 0)))
    table = spark.createDataFrame(data, "doc_id long, text string, y int")
    return table.drop("y"), table.select("doc_id", table.y.alias("toxic"), (1 - table.y).alias("quality"))


def test_toxicity(spark, labelled):
    df, labels = labelled
    model = toxicity.fit_toxicity(df, labels)
    got = model.score(df).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 595
    pair = spark.createDataFrame([(1, "calm women w1 w2"), (2, "calm men w1 w2"), (3, None), (4, "")], "doc_id long, text string")
    s = [r["score"] for r in model.score(pair).orderBy("doc_id").collect()]
    plain = toxicity.fit_toxicity(df, labels, pair_weight=0.0).score(pair).orderBy("doc_id").collect()
    assert abs(s[0] - s[1]) <= abs(plain[0]["score"] - plain[1]["score"]) + 1e-9 and s[2] == s[3] and max(s) < 0.7
    assert toxicity.fit_toxicity(df, labels.limit(0)).score(df.limit(3)).count() == 3
    assert model.score(df, reject=True).columns == df.columns


def test_quality_and_resampling(spark):
    r = np.random.default_rng(9)
    calm = ["w%d" % i for i in range(100)]
    data = [(i, " ".join(r.choice(calm, 50)) if i % 4 else " ".join("%s!!" % x.upper() for x in r.choice(calm, 50)), int(i % 4 > 0)) for i in range(400)]
    table = spark.createDataFrame(data, "doc_id long, text string, quality int")
    df, labels = table.drop("quality"), table.select("doc_id", "quality")
    model = quality.fit_quality(df, labels)
    assert {x["doc_id"] for x in model.accept(df).collect()} == {i for i, _, q in data if q}
    drawn = quality.importance_sample(df, labels, 0.25).collect()
    assert len(drawn) == 400 and sum(x["sampled"] for x in drawn) == 100
    assert min(x["gumbel_key"] for x in drawn if x["sampled"]) > max(x["gumbel_key"] for x in drawn if not x["sampled"])
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "w1")], "doc_id long, text string")
    assert model.score(odd).count() == 3 and quality.fit_quality(df, labels.limit(0)).accept(df).count() == 400
    values = spark.createDataFrame([(float(x),) for x in r.normal(size=5000)] + [(9.0,)] * 30, "x double")
    ordered = sorted((x[0] for x in values.collect()), reverse=True)
    for k in (1, 20, 31, 700, 5030):
        assert quality.kth_largest(values, "x", k, few=50) == ordered[k - 1]


def test_forward_backward_by_enumeration():
    from itertools import product

    r = np.random.default_rng(4)
    e, moves = r.normal(size=(7, 3)).astype(np.float32), r.normal(size=(3, 3))
    first = np.array([0, 4, 4, 7])
    got, pairs, z = forward_backward(e, first, moves)
    want, wanted, total = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for b, n in ((0, 4), (4, 3)):
        paths = list(product(range(3), repeat=n))
        weight = np.array([np.exp(sum(e[b + i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        total += np.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum()):
            for i, y in enumerate(p):
                want[b + i, y] += w
            for x, y in zip(p, p[1:]):
                wanted[x, y] += w
    assert np.allclose(got, want, atol=1e-6) and np.allclose(pairs, wanted, atol=1e-6) and abs(z - total) < 1e-5


def test_language(spark):
    r = np.random.default_rng(8)
    kinds = {"aa": ["the", "thing", "whoth", "ath"], "bb": ["ungen", "schu", "keit", "über"]}
    data = [(i, " ".join(r.choice(kinds[x], 30)), x) for i in range(60) for x in kinds]
    df = spark.createDataFrame(data + [(900, None, None), (901, "12 — !", "aa"), (None, "the thing schu the ath", None)], "doc_id long, text string, lang string")
    got = fit_language(df).predict(df).collect()
    assert all(x["lang_pred"] == x["lang"] for x in got if x["lang"] and x["doc_id"] != 901)
    assert [x["lang_pred"] for x in got if x["doc_id"] in (900, 901)] == ["und", "und"]
    assert [x["lang_pred"] for x in got if x["doc_id"] is None] == ["aa"]
    assert fit_language(df.limit(0)).predict(df.limit(2)).count() == 2
