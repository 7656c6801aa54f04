"""Toxicity: a counterfactual-regularised classifier.

A logistic regression on the presence of hashed character n-grams within words (3 to 8 bytes, word ends marked, ASCII and
Latin-1 letters in lower case), found once, twice, three or five times. It is fitted on a bounded sample of labelled rows: their n-gram presences are summed on the
cluster, the ``FEATURES`` n-grams that tell the labels apart best are kept, and the sample's presences of these reach the driver.
Labelled texts with an identity term are also taken with their terms swapped (``SWAPS``); squared changes of the
score's logit between a text and its counterfactual are added to the loss, so that naming a group does not raise a score.

Scoring is one map over whole texts. Defined results: null and blank texts get the score of a text without features; without
labelled rows of both kinds nothing is known, every score is 0 (below 1e-200) and nothing is rejected; null ids, repeated rows and extra columns
are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import without
from .labels import labelled

#: Labelled rows used at most, n-grams kept at most, hash buckets.
FIT_ROWS = 20_000
FEATURES = 2048
BITS = 20
TIMES = (2, 3, 5)
LONGEST = 8
THRESHOLD = 0.7
#: Weight of the counterfactual term; weight of the squared weights, divided by the number of rows; least chi-square of an n-gram.
PAIR_WEIGHT = 1.0
RIDGE = 0.1
EVIDENCE = 20.0
#: Identity terms and what each is swapped with.
SWAPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight"), ("muslims", "christians"), ("muslim", "christian"),
    ("jews", "hindus"), ("jewish", "hindu"), ("black", "white"), ("asian", "european"), ("immigrants", "citizens"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen"), ("femmes", "hommes"), ("musulmans", "chrétiens"), ("mujeres", "hombres"), ("musulmanes", "cristianos"),
)


def ngrams(words: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of every word, not yet made unique."""
    lens = words.ends - words.starts
    n = int(lens.sum())
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.repeat(np.arange(len(lens)), lens)
    text = np.full(n + len(lens) + 1, 32, np.uint8)
    text[np.arange(n) + word + 1] = X.lowered(words.buf)[words.inside]
    owner = np.empty(len(text), np.int32)
    doc = words.doc()
    owner[np.arange(n) + word + 1] = doc[word]
    spaces = np.flatnonzero(text == 32)
    owner[spaces] = np.r_[doc, doc[-1]]
    letter = text != 32
    h, ok = text.astype(np.uint64), np.ones(len(text), bool)
    docs, buckets = [], []
    for size in range(2, LONGEST + 1):
        h = h[:-1] * X._BASE + text[size - 1 :]
        ok = ok[:-1] & (letter[size - 2 : -1] if size > 2 else True)
        if size > 2:
            at = np.flatnonzero(ok)
            docs.append(owner[at])
            buckets.append(((X.mix(h[at] + X.U64(size))) >> X.U64(64 - BITS)).astype(np.int32))
    return np.concatenate(docs), np.concatenate(buckets)


def _often(bucket: np.ndarray, times: int) -> np.ndarray:
    """The bucket that stands for an n-gram found at least ``times`` times."""
    return (X.mix(bucket.astype(np.uint64) + X.U64(times << BITS)) >> X.U64(64 - BITS)).astype(np.int64)


def _sources(keep: np.ndarray) -> np.ndarray:
    """The buckets that may lead to one marked in ``keep``."""
    every = np.arange(1 << BITS)
    return keep | np.logical_or.reduce([keep[_often(every, n)] for n in TIMES])


def _present(words: X.Words, keep: np.ndarray | None = None, sources: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) of n-grams, also of those found ``TIMES`` times or more; with ``keep``, only buckets it marks."""
    doc, bucket = ngrams(words)
    if keep is not None:
        hit = sources[bucket]
        doc, bucket = doc[hit], bucket[hit]
    pair, count = np.unique((doc.astype(np.int64) << BITS) | bucket, return_counts=True)
    doc, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
    docs, buckets = [doc], [bucket]
    for n in TIMES:
        docs.append(doc[count >= n])
        buckets.append(_often(bucket[count >= n], n))
    pair = (np.concatenate(docs) << BITS) | np.concatenate(buckets)
    if keep is not None:
        pair = pair[keep[pair & ((1 << BITS) - 1)]]
    pair = np.unique(pair)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def swapped(text: str, pattern: re.Pattern, other: dict[str, str]) -> str:
    return pattern.sub(lambda m: other[m[0].lower()], text)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 << BITS), np.int64)
    for part, buf, offs in X.slices(batches, "t", X.FEW_BYTES):
        y = part.column("y").to_numpy() > 0
        doc, bucket = _present(X.Words(buf, offs))
        for kind in (0, 1):
            np.add.at(sums[kind], bucket[y[doc] == kind], 1)
    at = np.flatnonzero(sums.sum(0))
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at])], ["b", "n0", "n1"])


def _sparse(chosen: np.ndarray, swaps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << BITS, bool)
        keep[chosen] = True
        sources = _sources(keep)
        other = {**dict(swaps), **{b: a for a, b in swaps}}
        pattern = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, other), key=len, reverse=True)) + r")\b", re.I) if other else None

        def lists(array):
            buf, offs = X.flat(array)
            doc, bucket = _present(X.Words(buf, offs), keep, sources)
            cut = np.searchsorted(doc, np.arange(len(array) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.searchsorted(chosen, bucket).astype(np.int32)))

        for part, _, _ in X.slices(batches, "t", X.FEW_BYTES):
            texts = part.column("t")
            twins = [swapped(t, pattern, other) if t and pattern and pattern.search(t) else None for t in texts.to_pylist()]
            paired = [t is not None for t in twins]
            yield pa.record_batch([part.column("y"), lists(texts), pa.array(paired), lists(pa.array(twins, pa.string()))], ["y", "f", "paired", "g"])

    return run


def _flat_lists(lists) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(x) for x in lists], int)
    return np.repeat(np.arange(len(lists)), lens), np.concatenate([np.asarray(x, int) for x in lists]) if lens.sum() else np.empty(0, int)


def fit_weights(y: np.ndarray, f: list, paired: np.ndarray, g: list, size: int, pair_weight: float = PAIR_WEIGHT, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of least log loss + ridge + squared logit changes of pairs, by Adam on all rows at once."""
    n = max(len(y), 1)
    row, col = _flat_lists(f)
    mine = np.flatnonzero(paired)
    prow, pcol = _flat_lists([f[i] for i in mine])
    qrow, qcol = _flat_lists([g[i] for i in mine])
    rate = np.clip(y.mean() if len(y) else 0.1, 1e-3, 1 - 1e-3)
    w, bias = np.zeros(size), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col], minlength=len(y)) + bias
        d = (1 / (1 + np.exp(-z)) - y) / n
        grad = np.bincount(col, d[row], minlength=size) + RIDGE / n * w
        if len(mine):
            change = np.bincount(prow, w[pcol], minlength=len(mine)) - np.bincount(qrow, w[qcol], minlength=len(mine))
            change *= 2 * pair_weight / n
            grad += np.bincount(pcol, change[prow], minlength=size) - np.bincount(qcol, change[qrow], minlength=size)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * d.sum(), 0.99 * vb + 0.01 * d.sum() ** 2
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.1 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.1 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w, float(bias)


@dataclass(frozen=True)
class ToxicityModel:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, reject: bool = False) -> DataFrame:
        """All columns with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on), in place of columns of these names; with ``reject`` only the table's
        columns, without rows predicted 1."""
        df = df if reject else without(df, "score", "predicted")
        names = df.columns
        buckets, weights, bias = self.buckets, self.weights, self.bias

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(1 << BITS, np.float32)
            table[buckets] = weights
            used = table != 0
            sources = _sources(used)
            for part, buf, offs in X.slices(batches, text_col, X.FEW_BYTES):
                doc, bucket = _present(X.Words(buf, offs), used, sources)
                z = np.bincount(doc, table[bucket].astype(float), minlength=part.num_rows) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                if reject:
                    yield part.filter(pa.array(score < threshold))
                else:
                    cols = [part.column(c) for c in names]
                    yield pa.record_batch([*cols, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

        schema = df.schema if reject else T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
        return df.mapInArrow(run, schema)


def fit_toxicity(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", use: Column | None = None, rows: int = FIT_ROWS, features: int = FEATURES, swaps=SWAPS, pair_weight: float = PAIR_WEIGHT) -> ToxicityModel:
    sample = labelled(df, labels, label_col, rows, id_col, text_col, use)
    totals = {r["y"] > 0: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    t0, t1 = totals.get(False, 0), totals.get(True, 0)
    if not t0 or not t1:
        return ToxicityModel(np.empty(0, int), np.empty(0), -500.0)
    counts = sample.mapInArrow(_tally, "b int, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p = (F.col("n0") + F.col("n1")) / F.lit(t0 + t1)
    gain = (F.col("n1") / F.lit(t1) - F.col("n0") / F.lit(t0)) ** 2 / F.greatest(p * (1 - p) * F.lit(1 / t0 + 1 / t1), F.lit(1e-12))
    best = counts.select("b", gain.alias("gain")).filter(F.col("gain") >= EVIDENCE).orderBy(F.desc("gain"), "b").limit(features)
    chosen = np.sort(np.array([r["b"] for r in best.collect()], int))
    rows_ = sample.mapInArrow(_sparse(chosen, tuple(swaps)), "y int, f array<int>, paired boolean, g array<int>").toArrow()
    y, f, paired, g = (rows_.column(c) for c in ("y", "f", "paired", "g"))
    w, bias = fit_weights((y.to_numpy() > 0).astype(float), f.to_pylist(), paired.to_numpy(), g.to_pylist(), len(chosen), pair_weight)
    return ToxicityModel(chosen, w, bias)
