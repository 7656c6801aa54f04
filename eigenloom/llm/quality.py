"""Quality: importance resampling with hashed n-gram generative models.

Two bag models over ``1 << BITS`` hashed n-grams: the target's from a bounded sample of documents labelled good, the raw
one from every document of the table. A document's log importance weight is the sum over its n-grams of log target / raw; its mean per n-gram is the
score. Tokens are words in lower case and their shapes (runs of small and capital letters, digits, and every sign as it is; a
word equal to the one before it has a shape of its own); n-grams are single words, and one, two and three shapes.

``resample`` draws without replacement in proportion to the weights: Gumbel noise, a function of id, text and seed, is
added to the log weights and the k largest keys are taken. ``accepted`` compares the mean with a threshold that the labelled sample
gives: the one with the fewest errors among those that turn away at most ``LOST`` of the good sample.

Defined results: null or blank text has no n-grams, weight and score 0, and is accepted only if the threshold is below 0; null ids, repeated rows and
extra columns are kept; an empty table or no labels give equal models, scores of 0 and nothing rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import key, stored, without
from .labels import labelled

BITS = 16
FIT_ROWS = 20_000
LOST = 0.002
SMOOTH = 1.0
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = 1
_SHAPE[128:] = 1
_SHAPE[ord("A") : ord("Z") + 1] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3


def ngrams(words: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram."""
    if not len(words.starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = X.span_hashes(X.lowered(words.buf)[words.inside], words.ends - words.starts)
    kind = _SHAPE[words.buf]
    keep = words.inside.copy()
    keep[1:] &= (kind[1:] != kind[:-1]) | ~words.inside[:-1]
    keep[words.starts] = True
    place = np.r_[0, np.cumsum(keep)]
    shape = X.span_hashes(kind[keep], place[words.ends] - place[words.starts])
    doc = words.doc()
    again = np.r_[False, (low[1:] == low[:-1]) & (doc[1:] == doc[:-1])]
    shape = np.where(again, X.U64(7), shape)
    docs, grams = [doc, doc], [low, X.mix(shape + X.U64(1))]
    run = shape
    for size in (2, 3):
        run = X.chain(run[:-1], shape[size - 1 :])
        same = doc[size - 1 :] == doc[: len(doc) - size + 1]
        docs.append(doc[: len(run)][same])
        grams.append(X.mix(run[same] + X.U64(size)))
    return np.concatenate(docs), (np.concatenate(grams) >> X.U64(64 - BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(1 << BITS, np.int64)
    for _, buf, offs in X.slices(batches, "t", X.FEW_BYTES):
        sums += np.bincount(ngrams(X.Words(buf, offs))[1], minlength=1 << BITS)
    at = np.flatnonzero(sums)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["b", "n"])


def model_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts ``t``: at most one row a bucket reaches the driver."""
    rows = texts.mapInArrow(_count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS)
    out[rows.column("b").to_numpy()] = rows.column("n").to_numpy()
    return out


def choose_threshold(score: np.ndarray, good: np.ndarray, lost: float = LOST) -> float:
    """Fewest errors when scores below it are rejected, with at most ``lost`` of the good ones rejected."""
    if not good.any() or good.all():
        return -np.inf
    values = np.unique(score)
    bad_out = np.searchsorted(np.sort(score[~good]), values)
    good_out = np.searchsorted(np.sort(score[good]), values)
    errors = np.where(good_out <= lost * good.sum(), (~good).sum() - bad_out + good_out, np.inf)
    at = int(np.argmin(errors))
    return float((values[at] + values[at - 1]) / 2) if at else -np.inf


@dataclass(frozen=True)
class QualityModel:
    ratio: np.ndarray
    threshold: float

    def _map(self, df: DataFrame, text_col: str, fields: list[T.StructField], reject: bool) -> DataFrame:
        df = without(df, *(f.name for f in fields))
        names, ratio, threshold = df.columns, self.ratio.astype(np.float32), self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, buf, offs in X.slices(batches, text_col, X.FEW_BYTES):
                doc, bucket = ngrams(X.Words(buf, offs))
                n = np.bincount(doc, minlength=part.num_rows)
                weight = np.bincount(doc, ratio[bucket].astype(float), minlength=part.num_rows).astype(float)
                mean = weight / np.maximum(n, 1)
                accepted = pa.array(mean >= threshold)
                if reject:
                    yield part.filter(accepted)
                else:
                    yield pa.record_batch([*(part.column(c) for c in names), pa.array(n), pa.array(weight), pa.array(mean), accepted], [*names, *(f.name for f in fields)])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """All columns with n_grams, log_weight, score (its mean per n-gram) and accepted, in place of columns of these names."""
        kinds = {"n_grams": T.LongType(), "log_weight": T.DoubleType(), "score": T.DoubleType(), "accepted": T.BooleanType()}
        return self._map(df, text_col, [T.StructField(n, k) for n, k in kinds.items()], False)

    def accept(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """The table without rejected documents."""
        return self._map(df, text_col, [], True)


def fit_quality(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> QualityModel:
    sample = labelled(df, labels, label_col, rows, id_col, text_col)
    raw = model_counts(df.select(F.col(f"`{text_col}`").cast("string").alias("t")))
    target = model_counts(sample.filter("y > 0").select("t"))
    if not raw.sum() or not target.sum():
        return QualityModel(np.zeros(1 << BITS), -np.inf)
    share = lambda n: np.log((n + SMOOTH) / (n.sum() + SMOOTH * len(n)))
    ratio = np.where(raw > 0, share(target) - share(raw), 0.0)
    seen = QualityModel(ratio, -np.inf).score(sample, "t").select("y", "score").toArrow()
    return QualityModel(ratio, choose_threshold(seen.column("score").to_numpy(), seen.column("y").to_numpy() > 0))


def kth_largest(df: DataFrame, col: str, k: int, few: int = 10_000) -> float | None:
    """The k-th largest value (None: fewer than k), by histograms of ever narrower ranges; at most ``few`` values reach the driver."""
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if n < k or k < 1:
        return None
    left = k
    while True:
        inside = df.filter(F.col(col).between(low, high))
        if n <= few or low >= high:
            values = sorted((r[0] for r in inside.select(col).limit(few).collect()), reverse=True)
            return low if low >= high else values[left - 1]
        step = (high - low) / 1024
        cell = F.least(F.floor((F.col(col) - low) / step), F.lit(1023)).alias("cell")
        cells = inside.groupBy(cell).agg(F.count("*").alias("n"), F.min(col).alias("a"), F.max(col).alias("b")).orderBy(F.desc("cell")).collect()
        for r in cells:
            if left <= r["n"]:
                low, high, n = r["a"], r["b"], r["n"]
                break
            left -= r["n"]


def resample(scored: DataFrame, k: int, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """A scored table with ``gumbel_key`` and ``sampled``: the k rows with the largest keys (all rows, if fewer; equal keys stay together)."""
    bits = F.shiftrightunsigned(F.xxhash64(key(id_col), "log_weight", "n_grams", F.lit(seed)), 11)
    u = (bits + F.lit(0.5)) / F.lit(2.0**53)
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    least = kth_largest(keyed, "gumbel_key", k)
    return keyed.withColumn("sampled", F.lit(True) if least is None else F.col("gumbel_key") >= least)


def importance_sample(df: DataFrame, labels: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_grams, log_weight, score, accepted, gumbel_key and sampled: a ``share`` of all rows is drawn."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = stored(fit_quality(docs, labels).score(docs).drop("text"))
    return resample(scored, max(1, round(share * scored.count())), "doc_id")
