"""Words covered by passages that repeat across documents: prefix-partitioned suffix trees.

Only suffixes that begin with a repeated prefix can share a deep node. Every window of ``window`` words is given the
suffix prefix at its anchor, the rightmost smallest of the hashes of its ``PREFIX``-word sequences, so that equal windows
meet under equal prefixes and a document sends about two prefixes in 44 words.

1. Prefixes that occur in one document only are dropped (one partial aggregate over all prefixes).
2. The text around the remaining anchors, as many words as their windows reach, is dealt out by prefix; equal pieces
   are merged before that, so that a passage copied a million times is one piece of its group.
3. A group of up to ``GROUP`` different pieces gets its subtree, built level by level: nodes of depth 1, 2, 4, ... ``window`` are named
   by pairs of names of half the depth (names of depth 1 are the words themselves, so names stand for texts, not hashes).
   A node of depth ``window`` is a repeat; it carries its smallest doc_id. A prefix with more pieces is lengthened to
   the whole window: its pieces, each once, are broken into windows, whose smallest doc_id is a plain aggregate, and never enter a tree task.
4. A piece's nodes are one row, and so are all its places in a text, so that a text meets one row for each of its different pieces; copies of a piece are
   dealt over several keys. Places in texts with a larger doc_id than their node's are removed.

Defined results: null or blank text has no words; a null doc_id counts as the largest; rows with the same doc_id never remove
words of each other, repeated rows give repeated results; an empty table gives an empty result. Texts of any length are
handled whole; a task needs memory for one document. ``strip_repeats`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .frames import LAST, fresh, key

WINDOW = 50
PREFIX = 8
#: Pieces in one subtree at most, and words built at once.
GROUP = 32_768
#: Copies of one piece, or window, that meet on one key, about, and keys they are dealt over at most.
COPIES = 4_096
SALTS = 256
BUILD_WORDS = 250_000


def anchors(words: X.Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, prefix hash, word index of the anchor, first and last window) for each anchor; indices count from the slice's first word."""
    k = min(PREFIX, window)
    spread = window - k + 1
    h = words.hashes()
    if len(h) < window:
        none = np.empty(0, np.int64)
        return none, np.empty(0, X.U64), none, none, none
    grams, n = h, len(h)
    have = 1
    while have < k:
        step = min(have, k - have)
        grams = X.chain(grams[: len(grams) - step], grams[step:])
        have += step
    value, at, have = grams, np.arange(len(grams)), 1
    while have < spread:
        step = min(have, spread - have)
        right = value[step:] <= value[:-step]
        value, at = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    doc = words.doc()[: n - window + 1]
    valid = np.flatnonzero(np.arange(n - window + 1) + window <= words.first[1:][doc])
    at, doc = at[valid], doc[valid]
    if not len(valid):
        return doc, np.empty(0, X.U64), at, at, at
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    return doc[new], grams[at[new]], at[new], valid[new], valid[last]


def _prefixes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in X.slices(batches, "t", X.FEW_BYTES):
            doc, prefix, *_ = anchors(X.Words(buf, offs), window)
            pairs = np.unique(np.rec.fromarrays([doc, prefix], names="d,p"))
            ids = part.column("k").to_numpy()
            yield pa.record_batch([pa.array(X.as_signed(pairs["p"])), pa.array(ids[pairs["d"]])], ["p", "k"])

    return run


_PIECE = pa.schema([("p", pa.int64()), ("sh", pa.binary()), ("k", pa.int64()), ("th", pa.int64()), ("ws", pa.list_(pa.int32())), ("n", pa.int32())])
_PIECE_DDL = "p long, sh binary, k long, th long, ws array<int>, n int"
_TEXT = pa.schema([("p", pa.int64()), ("sh", pa.binary()), ("seg", pa.binary())])
_TEXT_DDL = "p long, sh binary, seg binary"


def _text_hash(buf: np.ndarray, offs: np.ndarray, row: int) -> int:
    return xxhash.xxh64_intdigest(buf[offs[row] : offs[row + 1]].tobytes()) - 2**63


def _pieces(window: int, k_col: str, text_col: str, ps_col: str, texts: bool):
    """Of each text, the pieces around anchors whose prefix is in its list, each once with all its places.

    ``texts``: instead the words of the pieces, each once a task at least.
    """
    schema = _TEXT if texts else _PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part, buf, offs in X.slices(batches, text_col, X.FEW_BYTES):
            words = X.Words(buf, offs)
            doc, prefix, at, lo, hi = anchors(words, window)
            text, starts, ends = words.joined()
            text = text.tobytes()
            lists, ids = part.column(ps_col), part.column(k_col).to_numpy()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), sizes)
            mine = np.sort(np.rec.fromarrays([row, lists.flatten().to_numpy().view(X.U64)], names="d,p"))
            have = np.rec.fromarrays([doc.astype(np.int64), prefix], names="d,p")
            place = np.minimum(np.searchsorted(mine, have), max(len(mine) - 1, 0))
            hit = np.flatnonzero(mine[place] == have) if len(mine) else np.empty(0, np.int64)
            cols: list[list] = [[] for _ in schema]
            put = [c.append for c in cols]
            places: dict[tuple[int, bytes], list[int]] = {}
            hashes = {} if texts else {r: _text_hash(buf, offs, r) for r in set(doc[hit].tolist())}
            for j in hit.tolist():
                r, a, i, e = int(doc[j]), int(at[j]), int(lo[j]), int(hi[j])
                p, base = int(prefix[j].view(np.int64)), int(words.first[r])
                seg = text[starts[i] : ends[e + window - 1]]
                sh = xxhash.xxh3_128_digest(seg, a - i)
                if not texts:
                    ws = places.get((r, sh))
                    if ws is None:
                        places[r, sh] = ws = []
                        for f, v in zip(put, (p, sh, int(ids[r]), hashes[r], ws, e - i + 1)):
                            f(v)
                    ws.append(i - base)
                elif sh not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(sh)
                    for f, v in zip(put, (p, sh, seg)):
                        f(v)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def node_names(words: np.ndarray, size: int) -> np.ndarray:
    """Names of the nodes at depth ``size`` for the suffix at each place: equal names, equal sequences. ``words``: names of depth 1."""
    names, depth = words, 1
    while depth < size:
        step = min(depth, size - depth)
        pair = names[:-step].astype(np.int64) * (int(names.max()) + 1) + names[step:] if len(names) > step else np.empty(0, np.int64)
        names = np.unique(pair, return_inverse=True)[1] if len(pair) else pair
        depth += step
    return names


def _built(rows: list[tuple], window: int) -> Iterator[tuple]:
    """(p, sh, marks) of pieces ``(p, sh, lo, hi, n, seg)`` that hold repeats; marks are (first window, last window, smallest doc_id)."""
    vocabulary: dict[bytes, int] = {}
    name = vocabulary.setdefault
    flat = [name(w, len(vocabulary)) for r in rows for w in r[5].split(b" ")]
    flat = np.asarray(flat, np.int64)
    size = np.array([r[4] + window - 1 for r in rows])
    first = np.cumsum(size) - size
    names = node_names(flat, window)
    count = np.array([r[4] for r in rows])
    piece = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    node = names[first[piece] + offset]
    low = np.array([r[2] for r in rows], np.int64)
    least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, low[piece])
    least = least[node]
    cut = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (least[1:] != least[:-1])])
    now, marks = -1, []
    for b, e in zip(cut.tolist(), np.r_[cut[1:], len(piece)].tolist()):
        if piece[b] != now:
            if marks:
                yield (*rows[now][:2], marks)
            now, marks = int(piece[b]), []
        if least[b] < rows[now][3]:
            marks.append({"w0": int(offset[b]), "w1": int(offset[e - 1]), "low": int(least[b])})
    if marks:
        yield (*rows[now][:2], marks)


_MARKS = pa.list_(pa.struct([("w0", pa.int32()), ("w1", pa.int32()), ("low", pa.int64())]))
_NODES_DDL = "p long, sh binary, marks array<struct<w0:int,w1:int,low:long>>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(p, sh, lo, hi, n, seg) of each piece, whose rows come one after another: what is known of it before its words, which several tasks may have sent."""
    about = None
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("p", "sh", "lo", "hi", "n", "seg"))):
            if r[5] is None:
                about = r
            elif about is not None and about[1] == r[1]:
                yield (*about[:5], r[5])
                about = None


def _trees(window: int):
    """Subtrees of the pieces, which come sorted by prefix: whole groups are built together, some at once. A row for each piece with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            cols = list(zip(*found)) or [[]] * 3
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.binary(), _MARKS))], ["p", "sh", "marks"])

        rows, words = [], 0
        for r in _merged(batches):
            if words >= BUILD_WORDS and rows[-1][0] != r[0]:
                yield out(_built(rows, window))
                rows, words = [], 0
            rows.append(r)
            words += r[4] + window - 1
        if rows:
            yield out(_built(rows, window))

    return run


_WINDOW = pa.schema([("wh", pa.binary()), ("p", pa.int64()), ("sh", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("w", pa.int32())])
_WINDOW_DDL = "wh binary, p long, sh binary, lo long, hi long, w int"


def _broken(window: int):
    """The windows of pieces, by the hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out():
            return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _WINDOW)], schema=_WINDOW)

        for p, sh, lo, hi, n, seg in _merged(batches):
            words = seg.split(b" ")
            rows += [(xxhash.xxh3_128_digest(b" ".join(words[w : w + window])), p, sh, lo, hi, w) for w in range(n)]
            if len(rows) > 10_000:
                yield out()
                rows = []
        if rows:
            yield out()

    return run


def _joined(rows: DataFrame, nodes: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the one row that ``nodes`` has for their key. ``counts``: how many ``copies`` a key has in ``rows``; keys with more than ``COPIES``,
    which are few, are dealt over several."""
    salts = F.least(F.ceil(F.col("copies") / F.lit(COPIES)), F.lit(SALTS)).cast("int")
    hot = counts.filter(F.col("copies") > COPIES).select(*on, salts.alias("salts"))
    each = F.coalesce(F.col("salts"), F.lit(1))
    rows = rows.join(F.broadcast(hot), on, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), each).cast("int")).drop("salts")
    nodes = nodes.join(F.broadcast(hot), on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), each - 1))).drop("salts")
    return rows.join(nodes, [*on, "salt"]).drop("salt")


def _with_spans(df: DataFrame, id_col: str, text_col: str, window: int, group: int = GROUP) -> tuple[DataFrame, str, str]:
    """The rows with their key and ``spans``: an array of (th, s, e), words s to e - 1 of the key's text with hash th are repeats.

    The table is dealt out by its key twice in one plan, with the same columns, so that Spark reuses the exchange.
    """
    k, spans, ps = fresh(df, "__k"), fresh(df, "__spans"), fresh(df, "__ps")
    base = df.withColumn(k, key(id_col))
    pairs = df.select(key(id_col).alias("k"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(_prefixes(window), "p long, k long")
    shared = pairs.groupBy("p").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi")
    wanted = pairs.join(shared.select("p"), "p").groupBy(F.col("k").alias(k)).agg(F.collect_set("p").alias(ps))
    around = base.join(wanted, k)
    pieces = around.mapInArrow(_pieces(window, k, text_col, ps, False), _PIECE_DDL)
    texts = around.mapInArrow(_pieces(window, k, text_col, ps, True), _TEXT_DDL)
    known = pieces.groupBy("p", "sh").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.first("n").alias("n"), F.count("*").alias("copies"))
    crowded = F.broadcast(known.groupBy("p").agg(F.count("*").alias("c")).filter(F.col("c") > group).select("p"))  # one prefix in ``group`` pieces at most
    groups = known.drop("copies").withColumn("seg", F.lit(None).cast("binary")).unionByName(texts, allowMissingColumns=True)
    order = ("p", "sh", F.asc_nulls_first("seg"))
    nodes = groups.join(crowded, "p", "left_anti").repartition("p").sortWithinPartitions(*order).mapInArrow(_trees(window), _NODES_DDL)
    windows = groups.join(crowded, "p", "left_semi").repartition("p", "sh").sortWithinPartitions(*order).mapInArrow(_broken(window), _WINDOW_DDL)
    least = windows.groupBy("wh").agg(F.min("lo").alias("low"), F.count("*").alias("copies"))
    marked = _joined(windows, least.select("wh", "low"), least, ["wh"]).filter("low < hi")
    marked = marked.groupBy("p", "sh").agg(F.collect_list(F.struct(F.col("w").alias("w0"), F.col("w").alias("w1"), "low")).alias("marks"))
    found = _joined(pieces.select("p", "sh", "k", "th", "ws"), nodes.unionByName(marked), known, ["p", "sh"])
    found = found.select("k", "th", "ws", F.filter("marks", lambda m: m["low"] < F.col("k")).alias("marks")).filter(F.size("marks") > 0)
    span = lambda w: F.transform("marks", lambda m: F.struct(F.col("th").alias("th"), (w + m["w0"]).alias("s"), (w + m["w1"] + window).alias("e")))
    found = found.groupBy(F.col("k").alias(k)).agg(F.flatten(F.collect_list(F.flatten(F.transform("ws", span)))).alias(spans))
    return base.join(found, k, "left"), k, spans


def _removed(part: pa.RecordBatch, spans: str, buf: np.ndarray, offs: np.ndarray, words: X.Words) -> np.ndarray:
    """Which words lie in the spans of their text."""
    lists = part.column(spans)
    flat = lists.flatten()
    change = np.zeros(len(words.starts) + 1, np.int64)
    if len(flat):
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(part.num_rows), sizes)
        hashes = np.zeros(part.num_rows, np.int64)
        for r in np.unique(row):
            hashes[r] = _text_hash(buf, offs, r)
        mine = flat.field("th").to_numpy() == hashes[row]
        row = row[mine]
        np.add.at(change, words.first[row] + flat.field("s").to_numpy()[mine], 1)
        np.add.at(change, words.first[row] + flat.field("e").to_numpy()[mine], -1)
    return np.cumsum(change[:-1]) > 0


def repeat_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row its id, n_words, n_removed and the SHA-256 of its kept words, joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in X.slices(batches, "t", X.FEW_BYTES):
            words = X.Words(buf, offs)
            gone = _removed(part, "spans", buf, offs, words)
            text, starts, ends = words.joined()
            text, digests, counts = text.tobytes(), [], np.zeros(part.num_rows, np.int64)
            total = np.concatenate([[0], np.cumsum(gone)])
            counts = total[words.first[1:]] - total[words.first[:-1]]
            for r, (b, e) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                if b == e:
                    kept = b""
                elif not counts[r]:
                    kept = text[starts[b] : ends[e - 1]]
                else:
                    stay = np.flatnonzero(~gone[b:e]) + b
                    cut = np.flatnonzero(np.r_[True, np.diff(stay) > 1]) if len(stay) else stay
                    heads, tails = stay[cut], stay[np.r_[cut[1:], len(stay)] - 1] if len(stay) else stay
                    kept = b" ".join(text[starts[x] : ends[y]] for x, y in zip(heads, tails))
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([pa.array(part.column("k").to_numpy(), mask=part.column("k").to_numpy() == LAST), pa.array(words.size.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = df.select(key(id_col).alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    marked, _, spans = _with_spans(docs, "k", "t", window)
    marked = marked.select("k", "t", F.col(spans).alias("spans"))
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The table with repeated words cut out of its texts; other words and the white space between them stay as they are.

    A column ``n_chars`` gets the new number of characters.
    """
    marked, _, spans = _with_spans(df, id_col, text_col, window)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in X.slices(batches, text_col, X.FEW_BYTES):
            words = X.Words(buf, offs)
            gone = _removed(part, spans, buf, offs, words)
            doc = words.doc()
            column = part.column(text_col)
            if gone.any():
                reach = np.r_[words.starts[1:], len(buf)]
                last = np.r_[doc[1:] != doc[:-1], True]
                reach[last] = offs[1:][doc[last]]
                edge = np.zeros(len(buf) + 1, np.int64)
                np.add.at(edge, words.starts[gone], 1)
                np.add.at(edge, reach[gone], -1)
                stay = np.cumsum(edge[:-1]) == 0
                raw, place = buf[stay].tobytes(), np.r_[0, np.cumsum(stay)][offs]
                hit = set(doc[gone].tolist())
                old = column.to_pylist()
                texts = [raw[place[r] : place[r + 1]].decode() if r in hit else x for r, x in enumerate(old)]
                column = pa.array(texts, column.type)
            cols = [column if c == text_col else part.column(c) for c in names]
            if "n_chars" in names and gone.any():
                i = names.index("n_chars")
                lens = [len(x) if r in hit else y for r, (x, y) in enumerate(zip(texts, cols[i].to_pylist()))]
                cols[i] = pa.array(lens, cols[i].type)
            yield pa.record_batch(cols, names)

    return marked.mapInArrow(run, df.schema)
