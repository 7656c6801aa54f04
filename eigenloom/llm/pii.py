"""Personal data by bootstrapped contextual extraction.

Base spans come from four fixed forms (leftmost, non-overlapping, each kind by itself; matches that fail their check are dropped without a retry). They are the seeds:

1. One scan of the whole texts writes all mentions to the shared folder: base spans, and candidates, which are other spans that look like an identifier (numbers with separators,
   addresses with colons, words around an ``@`` or a spelt-out one). A mention carries its instance (the identifier without its spelling), the kinds its form
   allows, and its lexical patterns: the two words before it; the words on both sides; the word before it if that is a label (ends in ``:``, ``=`` or ``#``).
2. Patterns and instances form a graph whose edges are the distinct pairs. Patterns with at least ``SUPPORT`` distinct instances that could be of a kind are looked up in
   all texts once more, to count how often their words occur at all (a bitmap of fixed size is sent along; the exact join follows).
3. In rounds, patterns are scored from their instances, then instances from their patterns, by aggregates over the edges. A pattern's confidence for a kind is
   ``F / (F + others + unknown / 2 + 1)``: F distinct instances known to be of the kind, others known to be of another one. It is accepted with
   ``SUPPORT`` of the former and from ``CONFIDENCE`` on, if its words are followed by the kind at least ``LIFT`` times as often as any word is, so that common words never are patterns. A candidate's score is
   ``1 - product(1 - confidence)`` over accepted patterns of a kind its form allows; from ``ACCEPT`` on it is known, with the better kind, and counts as such in the next round. The
   rounds end when nothing new is found, or after ``ROUNDS``.
4. All candidates whose instance is known, by its own spelling elsewhere or by patterns, are added to the base spans.

A pattern or instance on a third of all rows is one group of partial sums; joins on it are salted over ``SALTS`` keys. The driver holds the bitmap and four counts.

Defined results: null text counts as empty, as does a text without spans: no spans; a null id stays null; spans depend on the text and on the whole table, so repeated rows get equal spans
(their instances count once); an empty table gives an empty result. Places are code points. Texts of any length are read whole in linear time. Columns other than the two named ones
are left out, whatever their names.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from . import textops as X
from .frames import key, stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SUPPORT = 3
CONFIDENCE = 0.75
ACCEPT = 0.9
LIFT = 20.0
ROUNDS = 5
SALTS = 8
BITS = 1 << 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

_CHAIN = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]++(?![A-Za-z])(?:[ ()./_-]{1,3}[0-9]++(?![A-Za-z]))*+")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_AT = re.compile(r"[\[(](?:at|AT|At)[\])]")
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?$")
_AFTER = re.compile(r" ?([A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(](?:dot|DOT|Dot)[\])] ?)[A-Za-z0-9-]{1,63})+)")
_SIDE = re.compile(r"[^\s@<>()\[\]{},;:\"'\\]{1,64}")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """From every ``@`` to both sides, in one walk: the local part cannot hold an ``@``, so no place is read twice."""
    end, at = 0, t.find("@")
    while at >= 0:
        m = _DOMAIN.match(t, at + 1)
        if m:
            start = at
            while start > end and t[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                end = m.end()
        at = t.find("@", max(at + 1, end))


def _addresses(t: str) -> Iterator[tuple[int, int]]:
    """A chain of dotted numbers holds one match for every four of them."""
    for chain in _NUMBERS.finditer(t):
        parts = [m.span() for m in _DIGITS.finditer(t, *chain.span())]
        for n in range(0, len(parts) - 3, 4):
            four = [t[b:e].lstrip("0") for b, e in parts[n : n + 4]]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in four):
                yield parts[n][0], parts[n + 3][1]


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by kind and place."""
    out = [(EMAIL, *s) for s in _emails(t)] + [(IP, *s) for s in _addresses(t)]
    for m in _CARD.finditer(t):
        digits = "".join(_DIGITS.findall(m.group()))
        if len(digits) <= 19 and luhn(digits):
            out.append((CARD, *m.span()))
    out += [(PHONE, *m.span()) for m in _PHONE.finditer(t) if 8 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return out


def masked(t: str, spans: list[tuple[int, int]]) -> str:
    """The text with the characters of ``spans`` replaced."""
    parts, at = [], 0
    for b, e in sorted(spans):
        if e > at:
            parts += [t[at : max(at, b)], "\0" * (e - max(at, b))]
            at = e
    return "".join([*parts, t[at:]])


def candidates(t: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(kinds as bits, start, end, instance) of other spans that look like an identifier, clear of the ``taken`` ones and of each other."""
    out: list[tuple[int, int, int, str]] = []
    t = masked(t, [s[1:] for s in taken])
    found = []
    for m in _AT.finditer(t):
        before, after = _BEFORE.search(t, max(0, m.start() - 65), m.start()), _AFTER.match(t, m.end())
        if before and after:
            host = re.sub(r" ?[\[(](?:dot|DOT|Dot)[\])] ?", ".", after.group(1))
            found.append((before.start(), after.end(), f"{before.group().strip()}@{host}"))
    at = t.find("@")
    while at >= 0:
        b, after = at, _SIDE.match(t, at + 1)
        while b > 0 and at - b < 64 and _SIDE.match(t[b - 1]) and t[b - 1] != "\0":
            b -= 1
        if after and b < at and "\0" not in after.group():
            e = at + 1 + len(after.group().rstrip(".!?"))
            if e > at + 1:
                found.append((b, e, t[b:e]))
        at = t.find("@", at + 1)
    last = 0
    for b, e, name in sorted(found):
        if b >= last:
            out.append((1 << EMAIL, b, e, "e" + name.lower()))
            last = e
    t = masked(t, [c[1:3] for c in out])
    if ":" in t:
        for m in _COLONS.finditer(t):
            try:
                out.append((1 << IP, *m.span(), "i" + str(ipaddress.IPv6Address(m.group()))))
            except ValueError:
                continue
        t = masked(t, [c[1:3] for c in out])
    for m in _CHAIN.finditer(t):
        digits = "".join(_DIGITS.findall(m.group()))
        kinds = (7 <= len(digits) <= 15) << PHONE | (13 <= len(digits) <= 19) << CARD
        b = m.start() + (m.group()[0] == "(" and ")" not in m.group())
        out.append((kinds, b, m.end(), "d" + digits))
    return sorted(out, key=lambda c: c[1])


def instance(kind: int, text: str) -> str:
    """A base span without its spelling."""
    if kind == EMAIL:
        return "e" + text.lower()
    return "i" + text if kind == IP else "d" + "".join(_DIGITS.findall(text))


def _left(t: str, b: int) -> list[str]:
    """The last two words before ``b``, nearest last; the piece of a word that touches ``b`` is one."""
    reach = 256
    while True:
        lo = max(0, b - reach)
        words = _SPACES.split(t[lo:b])
        words = words[:-1] if words and not words[-1] else words
        if not lo or len(words) > 2:
            return [w for w in words[-2:] if w]
        reach *= 8


def _right(t: str, e: int) -> str:
    reach = 256
    while True:
        words = [w for w in _SPACES.split(t[e : e + reach], maxsplit=2) if w]
        if e + reach >= len(t) or len(words) > 1:
            return words[0] if words else ""
        reach *= 8


_TAGS = [X.U64(n) for n in (101, 103, 107)]


def _plain(buf: np.ndarray) -> np.ndarray:
    """Bytes of words as patterns see them: lower case, every digit as 0."""
    out = X.lowered(buf)
    return np.where((out >= 48) & (out <= 57), 48, out).astype(np.uint8)


def _hashed(words: list[str]) -> np.ndarray:
    """Hashes of words, equal to those of ``textops.Words`` on plain bytes; 0 for an empty one."""
    raw = [w.encode() for w in words]
    full = [w for w in raw if w]
    out = np.zeros(len(raw), X.U64)
    if full:
        out[[bool(w) for w in raw]] = X.span_hashes(_plain(np.frombuffer(b"".join(full), np.uint8)), np.array([len(w) for w in full]))
    return out


def _patterns(before: np.ndarray, near: np.ndarray, after: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 3 pattern hashes, which of them exist)."""
    with np.errstate(over="ignore"):
        made = np.stack([X.chain(X.chain(_TAGS[0] + before, near), X.U64(1)), X.chain(X.chain(_TAGS[1] + near, after), X.U64(2)), X.chain(_TAGS[2] + near, X.U64(3))], axis=1)
    return made, np.stack([(before != 0) & (near != 0), (near != 0) & (after != 0), label & (near != 0)], axis=1)


_MENTIONS = "k long, h long, kind int, kinds int, b int, e int, inst long, patterns array<long>"


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, offs in X.slices(batches, "t"):
        marked = np.concatenate([[0], np.cumsum((buf == 64) | ((buf >= 48) & (buf <= 57)) | (buf == 58))])
        rows = np.flatnonzero(marked[offs[1:]] > marked[offs[:-1]])
        names, found, words = [], [], ([], [], [])
        for r in rows.tolist():
            t = buf[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace")
            base = base_spans(t)
            own = [(k, 1 << k, b, e, instance(k, t[b:e])) for k, b, e in base]
            for kind, kinds, b, e, name in own + [(-1, *c) for c in candidates(t, base)]:
                left = _left(t, b)
                found.append((r, kind, kinds, b, e))
                names.append(xxhash.xxh64_intdigest(name))
                words[0].append(left[0] if len(left) > 1 else "")
                words[1].append(left[-1] if left else "")
                words[2].append(_right(t, e))
        if not found:
            continue
        label = np.array([w[-1:] in (":", "=", "#") for w in words[1]])
        made, there = _patterns(*(_hashed(w) for w in words), label)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(there.sum(1))].astype(np.int32)), pa.array(X.as_signed(made[there])))
        r, kind, kinds, b, e = (np.array(c, np.int32) for c in zip(*found))
        ids = part.select(["k", "h"]).take(pa.array(r))
        yield pa.record_batch([*ids.columns, *(pa.array(c) for c in (kind, kinds, b, e)), pa.array(X.as_signed(np.array(names, np.uint64))), lists], ["k", "h", "kind", "kinds", "b", "e", "inst", "patterns"])


def _occurrences(bits: np.ndarray):
    """(p, n): how often the words of patterns that pass the bitmap occur around any word; a null p counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offs in X.slices(batches, "t"):
            words = X.Words(_plain(buf), offs)
            n = len(words.starts)
            if not n:
                continue
            h, doc = words.hashes(), words.doc()

            def shifted(by: int) -> np.ndarray:
                """The hash of the word ``by`` places on, 0 beyond the text."""
                out, at = np.zeros(n, X.U64), np.arange(n) + by
                fine = (at >= 0) & (at < n)
                fine[fine] &= doc[at[fine]] == doc[fine]
                out[fine] = h[at[fine]]
                return out

            near = shifted(-1)
            label = np.isin(words.buf[words.ends - 1], [58, 61, 35])
            label = np.r_[False, label[:-1]]
            made, there = _patterns(shifted(-2), near, shifted(1), label)
            p = made[there]
            place = p % X.U64(BITS)
            p = p[(bits[(place >> X.U64(6)).astype(np.int64)] >> (place & X.U64(63))) & X.U64(1) == 1]
            p, count = np.unique(p, return_counts=True)
            yield pa.record_batch([pa.array([None, *X.as_signed(p).tolist()], pa.int64()), pa.array(np.r_[n, count].astype(np.int64))], ["p", "n"])

    return run


def _bitmap(patterns: DataFrame) -> np.ndarray:
    """A bitmap of ``BITS`` places with those of the pattern hashes set."""
    place = F.pmod("p", F.lit(BITS))  # 2**24 divides 2**64, so the sign does not matter
    words = patterns.select((place / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(p, {BITS}) % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    got, out = words.toArrow(), np.zeros(BITS // 64, np.uint64)
    out[got.column("w").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    return out


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _spread(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def score_patterns(edges: DataFrame, counts: DataFrame, words: int, seeds: list[int], support: int, confidence: float, lift: float) -> DataFrame:
    """(p, kind, c) of the accepted patterns. ``edges`` (p, inst, known): distinct pairs with the kind known, or -1; ``counts`` (p, n)."""
    known = [F.sum((F.col("known") == k).cast("long")).alias(f"f{k}") for k in range(len(KINDS))]
    stats = edges.groupBy("p").agg(F.count("*").alias("all"), *known).join(counts, "p")
    total = sum((F.col(f"f{k}") for k in range(len(KINDS))), F.lit(0))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"f{k}").alias("f"), F.lit(max(seeds[k], 1) / max(words, 1)).alias("rate")) for k in range(len(KINDS))])
    rows = stats.select("p", "n", "all", total.alias("sure"), F.explode(each).alias("x")).select("p", "n", "all", "sure", "x.*")
    rows = rows.withColumn("c", F.col("f") / (F.col("sure") + (F.col("all") - F.col("sure")) / 2 + 1))
    often = F.col("f") / F.greatest("n", "all") >= lift * F.col("rate")
    return rows.filter((F.col("f") >= support) & (F.col("c") >= confidence) & often).select("p", "kind", "c")


def score_instances(edges: DataFrame, patterns: DataFrame, accept: float) -> DataFrame:
    """(inst, new): candidates that accepted patterns vouch for, with the kind of the better score (ties: as listed)."""
    open_ = _salted(edges.filter("known < 0"), "inst").join(_spread(patterns), ["p", "salt"])
    open_ = open_.filter(F.expr("shiftright(kinds, kind) % 2 = 1"))
    scored = open_.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("s")).filter(F.col("s") >= accept)
    return scored.groupBy("inst").agg(F.max_by("kind", F.struct("s", -F.col("kind"))).alias("new"))


def bootstrap(docs: DataFrame, mentions: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT, lift: float = LIFT, rounds: int = ROUNDS) -> DataFrame | None:
    """(inst, kind) that the patterns vouch for; None if they vouch for nothing."""
    pairs = mentions.select(F.explode("patterns").alias("p"), "inst", "kind", "kinds")
    pairs = pairs.groupBy("p", "inst").agg(F.max("kind").alias("known"), F.bit_or("kinds").alias("kinds"))
    supported = stored(pairs.filter("kinds > 0").groupBy("p").count().filter(F.col("count") >= support).select("p"))
    if supported.isEmpty():
        return None
    edges = stored(_salted(pairs, "inst").join(_spread(supported), ["p", "salt"]).drop("salt"))
    seen = docs.select("t").mapInArrow(_occurrences(_bitmap(supported)), "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    seen = stored(seen.join(supported.withColumn("hit", F.lit(True)), "p", "left").filter("hit OR p IS NULL").select("p", "n"))
    words = seen.filter("p IS NULL").collect()
    words = words[0]["n"] if words else 0
    counts = supported.join(seen.filter("p IS NOT NULL"), "p", "left").select("p", F.coalesce("n", F.lit(0)).alias("n"))
    totals = mentions.filter("kind >= 0").select("kind", "inst").distinct().groupBy("kind").count().collect()
    seeds = [next((r["count"] for r in totals if r["kind"] == k), 0) for k in range(len(KINDS))]
    found = None
    for _ in range(rounds):
        accepted = score_patterns(edges, counts, words, seeds, support, confidence, lift)
        new = stored(score_instances(edges, accepted, accept))
        if new.isEmpty():
            break
        found = new if found is None else found.union(new)
        edges = stored(_salted(edges, "p").join(_spread(new), ["inst", "salt"], "left").select("p", "inst", F.when(F.col("known") < 0, F.coalesce("new", F.lit(-1))).otherwise(F.col("known")).alias("known"), "kinds"))
    return None if found is None else found.select("inst", F.col("new").alias("kind"))


def _based(id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in X.slices(batches, "t"):
            marked = np.concatenate([[0], np.cumsum((buf == 64) | ((buf >= 48) & (buf <= 57)))])
            kinds, starts, ends, cut = [], [], [], [0]
            for r, any_ in enumerate((marked[offs[1:]] > marked[offs[:-1]]).tolist()):
                if any_:
                    for k, b, e in base_spans(buf[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace")):
                        kinds.append(k)
                        starts.append(b)
                        ends.append(e)
                cut.append(len(kinds))
            spans = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (kinds, starts, ends)], ["kind", "b", "e"])
            yield pa.record_batch([part.column("id"), part.column("k"), part.column("h"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)], ["id", "k", "h", "base"])

    return run, f"id {id_type}, k long, h long, base array<struct<kind:int,b:int,e:int>>"


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, base, spans): one row for each row of ``df``, its id under its own name. Both lists hold (kind, b, e), kinds as places in ``KINDS``, ends exclusive, sorted.

    ``settings``: those of ``bootstrap``.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "mentions")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").alias("id"), key(id_col).alias("k"), F.xxhash64(text).alias("h"), text.alias("t"))
    docs.select("k", "h", "t").mapInArrow(_mentions, _MENTIONS).write.parquet(path)
    mentions = spark.read.parquet(path)
    learnt = bootstrap(docs, mentions, **settings)
    known = mentions.filter("kind >= 0").select("inst", "kind").groupBy("inst").agg(F.min("kind").alias("kind"))
    if learnt is not None:
        known = known.unionByName(learnt).groupBy("inst").agg(F.min("kind").alias("kind"))
    more = _salted(mentions.filter("kind < 0 AND kinds > 0").drop("kind"), "h").join(_spread(known), ["inst", "salt"])
    more = more.filter(F.expr("shiftright(kinds, kind) % 2 = 1")).groupBy("k", "h").agg(F.collect_set(F.struct("kind", "b", "e")).alias("more"))
    run, schema = _based(df.schema[id_col].dataType.simpleString())
    spans = docs.mapInArrow(run, schema).join(more, ["k", "h"], "left")
    return spans.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", F.coalesce("more", F.slice("base", 1, 0)))).alias("spans"))


def digest(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["b"].cast("string"), s["e"].cast("string"))), ",")
