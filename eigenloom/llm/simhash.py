"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two fingerprints of 64 bits at most 3 bits apart agree in at least 5 of their 8 bytes. The index lists each distinct fingerprint under
positional bytes. Single bytes would give lists that grow with the corpus, so a list is named by three positions
of one half and their bytes: five agreeing bytes always hold three in one half, 8 lists in all. In each list the shared
positional bytes of a pair are tallied, pairs with fewer than 8 - distance are dropped, the others verified by counting
differing bits. Copies share a fingerprint, which is indexed once.

A list with more than ``LIST`` members is replaced by its ten refinements with two more positions (any five agreeing
bytes with three given ones hold two of the other five). A refined list leaves 24 free bits, so it has at most 2^24
members (128 MB); the few masks of up to 3 bits in them are looked up instead of comparing all pairs. A list puts out
a spanning forest of its verified pairs: components stay the same, rows stay linear.

Defined results: null or blank text has fingerprint 0, linked like any other; a null doc_id counts as the largest and is put out as null;
repeated rows give repeated results; an empty table gives an empty result. A task needs memory for one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .components import components
from .frames import LAST, fresh, key, stored

SHINGLE = 3
DISTANCE = 3
LIST = 1024
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
_LANES = X.U64(0x0001000100010001)


def _bit_sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of each run (``first``: where runs of at most 65,535 begin)."""
    out = np.empty((len(first), 64), np.int64)
    for b in range(16):
        lanes = np.add.reduceat((h >> X.U64(b)) & _LANES, first)
        for q in range(4):
            out[:, b + 16 * q] = (lanes >> X.U64(16 * q)) & X.U64(0xFFFF)
    return out


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for part, buf, offs in X.slices(batches, "t", X.FEW_BYTES):
            words = X.Words(np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8), offs)
            text, starts, ends = words.joined()
            text = text.tobytes()
            many = np.where(words.size > 0, np.maximum(words.size - shingle + 1, 1), 0)
            doc = np.repeat(np.arange(len(many)), many)
            at = np.cumsum(many) - many
            begin = words.first[:-1][doc] + np.arange(len(doc)) - at[doc]
            end = np.minimum(begin + shingle, words.first[1:][doc]) - 1
            h = np.fromiter((digest(text[a:b], 42) for a, b in zip(starts[begin].tolist(), ends[end].tolist())), X.U64, len(doc))
            fps = np.zeros(len(many), X.U64)
            if len(h):
                runs = [(r, b) for r in np.flatnonzero(many).tolist() for b in range(int(at[r]), int(at[r] + many[r]), 65_535)]
                owner, first = (np.array(x) for x in zip(*runs))
                sums = np.zeros((len(many), 64), np.int64)
                np.add.at(sums, owner, _bit_sums(h, first))
                bits = (2 * sums > many[:, None]).astype(np.uint8)
                fps = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
            yield pa.record_batch([part.column("k"), part.column("th"), pa.array(X.as_signed(fps.astype(X.U64)))], ["k", "th", "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(k, th, fp): id (null: the largest long), hash of the text, fingerprint of every row."""
    text = F.col(f"`{text_col}`").cast("string")
    docs = df.select(key(id_col).alias("k"), F.xxhash64(text).alias("th"), text.alias("t"))
    return docs.mapInArrow(_fingerprints(shingle), "k long, th long, fp long")


def _byte(i: int):
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def _list_name(number: int, positions) -> F.Column:
    out = F.lit(number).cast("long")
    for i in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(i))
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest with the components of the links a-b."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    joined = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[joined], nodes[label[joined]]


def _verified(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Count filter on shared positional bytes, then the bit distance."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    return (shared >= 8 - distance) & (np.bitwise_count(x) <= distance)


def _near_in_runs(names: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of short runs: neighbours 1, 2, 3, ... places on, for as long as a run reaches."""
    left, right = [], []
    live, step = np.arange(len(names)), 1
    while True:
        live = live[live + step < len(names)]
        live = live[names[live] == names[live + step]]
        if not len(live):
            break
        good = live[_verified(fps[live], fps[live + step], distance)]
        left.append(fps[good])
        right.append(fps[good + step])
        step += 1
    none = [np.empty(0, X.U64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _near_in_long_run(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of one long run, whose members differ in few positions: every mask of up to ``distance`` free bits is looked up."""
    fps = np.sort(fps)
    differ = np.bitwise_or.reduce(fps ^ fps[0])
    bits = [X.U64(1 << i) for i in range(64) if int(differ) >> i & 1]
    left, right = [], []
    for n in range(1, distance + 1):
        for chosen in combinations(bits, n):
            want = fps ^ np.bitwise_or.reduce(np.array(chosen))
            at = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
            hit = (fps[at] == want) & (fps < want)
            left.append(fps[hit])
            right.append(want[hit])
    none = [np.empty(0, X.U64)]
    a, b = np.concatenate(left or none), np.concatenate(right or none)
    good = _verified(a, b, distance)
    return a[good], b[good]


def _links(distance: int):
    """Spanning links of the lists, which come sorted by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b):
            a, b = _forest(a, b)
            return pa.record_batch([pa.array(X.as_signed(a)), pa.array(X.as_signed(b))], ["a", "b"])

        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(names, fps):
            if not len(names):
                return
            cut = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            size = np.diff(np.r_[cut, len(names)])
            for at, n in zip(cut[size > LIST].tolist(), size[size > LIST].tolist()):
                yield out(*_near_in_long_run(fps[at : at + n], distance))
            some = np.repeat((size > 1) & (size <= LIST), size)
            yield out(*_near_in_runs(names[some], fps[some], distance))

        for batch in batches:
            names, fps = batch.column("l").to_numpy(), batch.column("fp").to_numpy().view(X.U64)
            if not len(names):
                continue
            cut = int(np.searchsorted(names, names[-1]))  # the last list may go on
            if cut:
                whole = [*kept, (names[:cut], fps[:cut])]
                kept = []
                yield from flush(*(np.concatenate(x) for x in zip(*whole)))
            elif kept and kept[-1][0][-1] != names[0]:
                yield from flush(*(np.concatenate(x) for x in zip(*kept)))
                kept = []
            kept.append((names[cut:].copy(), fps[cut:].copy()))
        if kept:
            yield from flush(*(np.concatenate(x) for x in zip(*kept)))

    return run


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): spanning links between the distinct fingerprints ``fp`` of the table at most ``distance`` (0 to 3) bits apart."""
    if not 0 <= distance <= 3:
        raise ValueError("the index guarantees its byte matches for distances 0 to 3")
    named = F.array(*(F.struct(F.lit(n).alias("n"), _list_name(n, t).alias("l")) for n, t in enumerate(TRIPLES)))
    lists = fps.select("fp", F.explode(named).alias("x")).select("fp", "x.n", "x.l")
    sizes = lists.groupBy("l").agg(F.count("*").alias("c")).filter("c > 1")
    lists = lists.join(sizes, "l")
    finer = []
    for n, t in enumerate(TRIPLES):
        rest = [i for i in range(8) if i not in t]
        finer.append(F.array(*(_list_name(16 + 10 * n + m, (*t, *two)) for m, two in enumerate(combinations(rest, 2)))))
    refined = F.element_at(F.array(*finer), F.col("n") + 1)
    members = lists.select("fp", F.explode(F.when(F.col("c") > LIST, refined).otherwise(F.array("l"))).alias("l"))
    return members.repartition("l").sortWithinPartitions("l", "fp").mapInArrow(_links(distance), "a long, b long")


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, distance: int) -> DataFrame:
    """(k, th, fp, c): every row with the smallest id of its component."""
    prints = stored(fingerprints(df, id_col, text_col, shingle))
    owner = stored(prints.groupBy("fp").agg(F.min("k").alias("rep")))
    group = components(links(owner.select("fp"), distance)).withColumnRenamed("node", "fp")
    classes = owner.join(group, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("g"))
    least = classes.groupBy("g").agg(F.min("rep").alias("c"))
    return prints.join(classes.join(least, "g").select("fp", "g", "c"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row doc_id, fp, fingerprint (hex) and component_id, the smallest doc_id reachable by links of near fingerprints."""
    ids = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return _grouped(df, id_col, text_col, shingle, distance).select(
        ids("k").alias("doc_id"), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), ids("c").alias("component_id")
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The table with one row of each group of near duplicates: one with the smallest id."""
    k, th, n = (fresh(df, c) for c in ("__k", "__th", "__n"))
    found = _grouped(df, id_col, text_col, shingle, distance)
    first = found.groupBy("g").agg(F.min(F.struct("k", "th")).alias("x")).select(F.col("x.k").alias(k), F.col("x.th").alias(th))
    rows = df.withColumns({k: key(id_col), th: F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    kept = rows.join(first, [k, th], "left_semi")
    one = F.row_number().over(Window.partitionBy(k, th).orderBy(k))
    return kept.withColumn(n, one).filter(F.col(n) == 1).drop(k, th, n)
