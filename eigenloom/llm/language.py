"""Language of code-switched text: a linear-chain conditional random field over words.

Every word is scored for every language by hashed features: character n-grams of 2 to 4 bytes with the word's ends marked (so affixes are
features of their own) and the whole word (the lexicon). Transitions between the languages of neighbouring words are learned too. Training
text is code-switched: the words of a bounded sample of labelled documents, with a share for every language (``fit_language``), are cut into runs of 3 to 40 words, which are chained in random order, each word labelled
with its document's language; weights maximise the likelihood by forward-backward and Adam. A text's words get their marginals by forward-backward over the whole text, all
texts of a batch in step; the language with the largest mean marginal over words with a letter is the prediction, the mean its score.

Defined results: ``und`` and score 0 for null texts, texts without a letter, and without any training row; ties go to the first language in
alphabetical order; null ids, repeated rows and extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import key, without

FIT_ROWS = 600
LEAST_ROWS = 20
FIT_BYTES = 8 << 20
LEAST_BYTES = 128 << 10
BITS = 16
ROUNDS = 25
#: Values of the language that are learned at most: each brings its own sample rows and weights to the driver.
LANGUAGES = 200
RIDGE = 1e-6
#: Words that forward-backward takes at once, about.
STEP_WORDS = 1_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(words: X.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature (bucket, where each word's buckets begin); every word has one of each kind at least."""
    lens = words.ends - words.starts
    low = X.lowered(words.buf)[words.inside]
    yield (X.span_hashes(low, lens) >> X.U64(64 - BITS)).astype(np.int32), np.arange(len(lens))
    n = int(lens.sum())
    text = np.full(n + len(lens) + 1, 32, np.uint8)
    word = np.repeat(np.arange(len(lens)), lens)
    text[np.arange(n) + word + 1] = low
    at = np.cumsum(lens + 1) - lens - 1
    h = text.astype(np.uint64)
    for size in range(2, 5):
        h = h[:-1] * X._BASE + text[size - 1 :]
        bucket = (X.mix(h + X.U64(size)) >> X.U64(64 - BITS)).astype(np.int32)
        many = np.maximum(lens + 3 - size, 1)  # n-grams from the mark before to the mark after
        first = np.cumsum(many) - many
        place = np.arange(int(many.sum())) + np.repeat(at - first, many)
        yield bucket[np.minimum(place, len(bucket) - 1)], first


def emissions(words: X.Words, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words.starts), weights.shape[1]), np.float32)
    if len(out):
        for bucket, first in features(words):
            out += np.add.reduceat(weights[bucket], first, axis=0)
        letters = np.add.reduceat(_LETTER[words.buf[words.inside]], np.cumsum(words.ends - words.starts) - (words.ends - words.starts), dtype=np.int32)
        out[letters == 0] = 0
    return out


def forward_backward(e: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of every word, expected moves, log partition; ``first``: where each text begins in ``e`` (n + 1)."""
    a = np.exp(moves - moves.max())
    top = e.max(1, keepdims=True) if len(e) else e
    psi = np.exp(e - top).astype(np.float64)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    alpha, scale = np.empty_like(psi), np.ones(len(psi))
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more than t words
    state = None
    for t in range(steps):
        rows = start[: live[t]] + t
        state = psi[rows] if t == 0 else (state[: live[t]] @ a) * psi[rows]
        total = state.sum(1)
        state /= total[:, None]
        alpha[rows], scale[rows] = state, total
    marginal, pairs, beta = np.empty_like(psi), np.zeros_like(a), None
    for t in range(steps - 1, -1, -1):
        rows = start[: live[t]] + t
        now = np.ones((len(rows), psi.shape[1]))
        if t + 1 < steps:
            n = live[t + 1]
            ahead = psi[rows[:n] + 1] * beta / scale[rows[:n] + 1, None]
            now[:n] = ahead @ a.T
            pairs += (alpha[rows[:n]].T @ ahead) * a
        beta = now
        marginal[rows] = alpha[rows] * beta
    return marginal, pairs, float(np.log(scale).sum() + top.sum() + moves.max() * np.maximum(size - 1, 0).sum())


def switched(size: np.ndarray, label: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word order, label of each word there, where each chain begins): runs of words of texts of ``size`` words, chained at random."""
    rng = np.random.default_rng(seed)
    runs, at = [], 0
    for n, y in zip(size.tolist(), label.tolist()):
        done = 0
        while done < n:
            m = min(int(rng.integers(3, 41)), n - done)
            runs.append((at + done, m, y))
            done += m
        at += n
    runs = [runs[i] for i in rng.permutation(len(runs))]
    if not runs:
        return np.empty(0, int), np.empty(0, int), np.zeros(1, int)
    order = np.concatenate([np.arange(b, b + m) for b, m, _ in runs])
    labels = np.repeat([y for *_, y in runs], [m for _, m, _ in runs])
    ends = np.cumsum([m for _, m, _ in runs])[9::10]
    first = np.unique(np.r_[0, ends, len(order)])
    return order, labels, first


def fit_weights(texts: list[str], label: np.ndarray, kinds: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(weights of buckets, weights of moves) of the most likely labels."""
    words = X.Words(*X.flat(pa.array(texts, pa.string())))
    found = list(features(words)) if len(words.starts) else []
    order, y, first = switched(words.size, label)
    truth = np.zeros((len(order), kinds))
    truth[np.arange(len(order)), y] = 1
    inner = np.ones(max(len(order) - 1, 0), bool)
    inner[first[1:-1] - 1] = False
    seen = np.zeros((kinds, kinds))
    np.add.at(seen, (y[:-1][inner], y[1:][inner]), 1)
    w, moves = np.zeros((1 << BITS, kinds), np.float32), np.zeros((kinds, kinds))
    state = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(moves), np.zeros_like(moves))]
    back = np.empty(len(order), int)
    back[order] = np.arange(len(order))
    for t in range(1, rounds + 1):
        marginal, pairs, _ = forward_backward(emissions(words, w)[order], first, moves)
        miss = ((truth - marginal) / max(len(order), 1)).astype(np.float32)[back]
        grad = -RIDGE * w
        for bucket, at in found:
            many = np.diff(np.r_[at, len(bucket)])
            for j in range(kinds):
                grad[:, j] += np.bincount(bucket, np.repeat(miss[:, j], many), minlength=1 << BITS)
        for x, g, (m, v) in zip((w, moves), (grad, (seen - pairs) / max(len(order), 1)), state):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x += 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return w, moves


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def predict(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """All columns with ``lang_pred`` and ``score``, in place of columns of these names."""
        df = without(df, "lang_pred", "score")
        names, languages, moves = df.columns, self.languages, self.moves
        sent = df.sparkSession.sparkContext.broadcast(self.weights)

        def label(parts, scores):
            size = np.concatenate([s for _, _, s, _ in parts])
            lettered = np.concatenate([x for _, _, _, x in parts])
            e, spoken = np.concatenate([x for x, _ in scores]), np.concatenate([x for _, x in scores])
            first = np.r_[0, np.cumsum(size)]
            marginal = forward_backward(e, first, moves)[0] * spoken[:, None]
            total = np.vstack([np.zeros(marginal.shape[1]), np.cumsum(marginal, axis=0)])
            total = total[first[1:]] - total[first[:-1]]
            count = np.r_[0, np.cumsum(spoken)]
            mean = total / np.maximum(count[first[1:]] - count[first[:-1]], 1)[:, None]
            best = mean.round(12).argmax(1)
            score = np.where(lettered, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
            at = 0
            for part, _, s, _ in parts:
                n = len(s)
                pred = [languages[b] if ok else "und" for b, ok in zip(best[at : at + n].tolist(), lettered[at : at + n].tolist())]
                yield pa.record_batch([*part.columns, pa.array(pred, pa.string()), pa.array(score[at : at + n])], [*names, "lang_pred", "score"])
                at += n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = sent.value
            parts, scores, held = [], [], 0
            for part, buf, offs in X.slices(batches, text_col, 2 << 20):
                words = X.Words(buf, offs)
                if not languages:
                    n = part.num_rows
                    yield pa.record_batch([*part.columns, pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n))], [*names, "lang_pred", "score"])
                    continue
                inside = np.concatenate([[0], np.cumsum(_LETTER[buf])])
                spoken = inside[words.ends] > inside[words.starts]
                ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[buf] & (buf < 128))])
                lettered = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
                for r in np.flatnonzero(~lettered & (inside[offs[1:]] > inside[offs[:-1]])):
                    lettered[r] = any(c.isalpha() for c in buf[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace"))
                parts.append((part, None, words.size, lettered))
                scores.append((emissions(words, weights), spoken))
                held += len(words.starts)
                if held >= STEP_WORDS:
                    yield from label(parts, scores)
                    parts, scores, held = [], [], 0
            if parts:
                yield from label(parts, scores)

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def _picked(df: DataFrame, use: Column | None, id_col: str, text_col: str, lang_col: str, rows: int) -> tuple[DataFrame, list[tuple]]:
    """(k, y, t, th) of the labelled texts with a letter, and the sample's distinct (y, th); ``th`` is the text's hash.

    The ``LANGUAGES`` values with the most distinct texts (ties: the smaller) are learned. Each of them gets its share, however rare it is: distinct texts are counted by value, and of each only those below a
    hash that some more than its rows are expected to reach come to the driver.
    """
    texts = df.select(key(id_col).alias("k"), F.col(f"`{lang_col}`").cast("string").alias("y"), F.col(f"`{text_col}`").cast("string").alias("t"))
    texts = texts.filter("y IS NOT NULL").filter(F.col("t").rlike(r"\p{L}"))
    texts = (texts.filter(use) if use is not None else texts).withColumn("th", F.xxhash64("t"))
    distinct = texts.groupBy("y", "th").agg(F.max(F.octet_length("t")).alias("n"))
    counts = {r["y"]: r["c"] for r in distinct.groupBy("y").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "y").limit(LANGUAGES).collect()}
    if not counts:
        return texts, []
    each, size = max(-(-rows // len(counts)), LEAST_ROWS), max(FIT_BYTES // len(counts), LEAST_BYTES)
    reach = each + 6 * int(each**0.5) + 10
    cuts = [(y, 2**63 - 1 if c <= reach else int(reach / c * 2**64) - 2**63) for y, c in counts.items()]
    cut = df.sparkSession.createDataFrame(cuts, "y string, cut long")
    some = distinct.join(F.broadcast(cut), "y").filter("th <= cut").select("y", "th", "n").collect()
    picked, had = [], {}
    for r in sorted(some, key=lambda r: (r["y"], r["th"])):
        many, held = had.get(r["y"], (0, 0))
        if many < each and held < size:
            picked.append((r["y"], r["th"]))
            had[r["y"]] = many + 1, held + r["n"]
    return texts.withColumn("t", F.substring("t", 1, size)), picked


def fit_language(df: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> LanguageModel:
    """A model from a sample of every language's distinct texts; ``use`` is a condition on the id column ``k``.

    Per language those with the smallest hashes: an equal share of ``rows``, at least ``LEAST_ROWS``, until an equal share of ``FIT_BYTES``, at least
    ``LEAST_BYTES``, is reached; the first so many characters of a text longer than that.
    """
    texts, picked = _picked(df, use, id_col, text_col, lang_col, rows)
    if not picked:
        return LanguageModel([], np.zeros((1, 1)), np.zeros((1, 1)))
    some = df.sparkSession.createDataFrame(picked, "y string, th long")
    got = texts.join(F.broadcast(some), ["y", "th"]).groupBy("y", "th").agg(F.min("t").alias("t")).orderBy("th", "y").toArrow()
    found = got.column("y").to_pylist()
    languages = sorted(set(found))
    number = {x: i for i, x in enumerate(languages)}
    weights, moves = fit_weights(got.column("t").to_pylist(), np.array([number[x] for x in found]), len(languages))
    return LanguageModel(languages, weights, moves)
