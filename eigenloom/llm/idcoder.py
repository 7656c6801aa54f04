"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

A block, up to ``LANES`` lanes of ``BLOCK`` ids (down to ``LEAST`` in a small segment, so that it has lanes enough; the segment says how many), starts with an empty model, which all of
its lanes share: they are coded in step, one numpy element per lane, and what they meant in one step is known to all of them in the next. Two contexts predict the next id outright: the two
ids before it (order 2) and the one before it (order 1), each from a table of what followed last and how often that held. A mixer, adaptive frequencies that depend on how well both predictions
have held so far and on whether they agree, shares the range among "order 2 is right", "order 1 is right" and "neither"; then the order-0 model codes the id's low 16 bits by adaptive frequencies,
an unseen one by the share of all unseen ones and 16 plain bits; bits above 16 are plain. Frequencies are learnt every few steps, predictions after each. Encoder and decoder run the same model.

The arithmetic is a range coder with a state of 63 bits and words of 32, one stream a lane; an id is one interval within the mixer's share, and carries are settled at the end. A segment, one
block or more of whole documents, is one row: its document index, lane sizes, CRC-32 of every block's ids and of the index, and the words.

A corpus is dealt out by ranges of ids, every range is a file of segments written by Spark (so lost tasks leave nothing behind), and reading needs no shuffle.
Defined results: null texts are empty; null ids sort last and read back as null; rows of equal id sort by the hash of their text; an empty table
gives empty files. A document of any length stays in one segment, which then is longer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X
from .frames import LAST, key, text_batches
from .tokens import encoder

BLOCK = 512
LEAST = 256
LANES = 8192  # 2^16 at most
MAGIC = b"EIDS3\0"
_U = np.uint64
#: Bits of a gate's shares, of the order-0 frequencies, of the slots of the two tables of contexts.
_GATE, _ZERO, _ONE, _TWO = 12, 18, 16, 17
#: A lane takes a word in as soon as its range is below the first; a word is 32 of the 63 bits of the state.
_LEAST, _SPAN, _WORD = _U(1 << 31), _U((1 << 63) - 1), _U((1 << 32) - 1)
#: Stands for every id that order 0 has not seen.
_NEW = 1 << 16
#: Counts of the mixer's gate, and of order 0, are halved beyond these; order 0 learns after 1, 2, 4, ... steps and then every so many, a gate every so many.
_GATE_LIMIT, _ZERO_LIMIT, _ZERO_STEPS, _GATE_STEPS = 1 << 16, 1 << 20, 128, 8


class _Range:
    def __init__(self, lanes: int):
        self.range = np.full(lanes, _SPAN)

    def take(self, below: np.ndarray, width: np.ndarray) -> None:
        """Each of the first lanes codes ``width`` parts in 2^30 of its range, from the part ``below`` on."""
        span = self.range[: len(below)]
        unit = span >> _U(_GATE + _ZERO)
        self.move(slice(len(below)), below * unit)
        np.multiply(width, unit, out=span)
        self.shift(np.flatnonzero(span < _LEAST))

    def shift(self, at: np.ndarray) -> None:
        if len(at):
            self.word(at)
            self.range[at] <<= _U(32)


class _Writer(_Range):
    """``words``: what lanes have put out, step by step: 32 bits each and what is to be carried into the lane's word before."""

    def __init__(self, lanes: int):
        super().__init__(lanes)
        self.low = np.zeros(lanes, _U)
        self.words, self.lanes = [], []

    def move(self, at, by: np.ndarray) -> None:
        self.low[at] += by

    def word(self, at: np.ndarray) -> None:
        low = self.low[at]
        self.words.append(low >> _U(31))
        self.lanes.append(at)
        self.low[at] = (low & (_LEAST - _U(1))) << _U(32)

    def flat(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """16 bits in each of the lanes ``at``, all values alike."""
        unit = self.range[at] >> _U(16)
        self.low[at] += unit * value
        self.range[at] = unit
        self.shift(at[unit < _LEAST])
        return value

    def finish(self) -> tuple[np.ndarray, bytes]:
        """The number of words of each lane, and all of them."""
        self.low = (self.low + (_LEAST - _U(1))) & ~(_LEAST - _U(1))  # still inside the range; what follows are zeros
        every = np.arange(len(self.low))
        self.word(every)
        lane = np.concatenate(self.lanes)
        size = np.bincount(lane)
        words = np.zeros((len(size), int(size.max()) + 1), _U)
        words[np.arange(words.shape[1]) < size[:, None]] = np.concatenate(self.words)[np.argsort(lane.astype(np.uint16), kind="stable")]
        while True:
            carry = words >> _U(32)
            if not carry.any():
                break
            words &= _WORD
            words[:, :-1] += carry[:, 1:]
        size += (words[every, size - 1] & _U(1)).astype(np.int64)
        out = (words >> _U(1)).astype("<u4")  # a reader starts with two words, of which it needs 63 bits
        out[:, 1:] |= (words[:, :-1] << _U(31)).astype(np.uint32)
        return size, out[np.arange(words.shape[1]) < size[:, None]].tobytes()


class _Reader(_Range):
    def __init__(self, lens: np.ndarray, data: bytes):
        super().__init__(len(lens))
        width = int(lens.max()) + 2
        words = np.zeros((len(lens), width), np.uint32)
        words[np.arange(width) < lens[:, None]] = np.frombuffer(data, "<u4")
        self.words, self.at = words.ravel(), np.arange(len(lens)) * width + 2
        self.code = (words[:, 0].astype(_U) << _U(32)) | words[:, 1]

    def move(self, at, by: np.ndarray) -> None:
        self.code[at] -= by

    def word(self, at: np.ndarray) -> None:
        place = self.at[at]
        self.code[at] = (self.code[at] << _U(32)) | self.words.take(place, mode="clip")
        self.at[at] = place + 1

    def part(self, n: int) -> np.ndarray:
        """Which part in 2^30 of its range each of the first lanes holds."""
        return (self.code[:n] // (self.range[:n] >> _U(_GATE + _ZERO))).astype(np.uint32)

    def flat(self, at: np.ndarray, value) -> np.ndarray:
        unit = self.range[at] >> _U(16)
        value = np.minimum(self.code[at] // unit, _U(65535))
        self.code[at] -= unit * value
        self.range[at] = unit
        self.shift(at[unit < _LEAST])
        return value.astype(np.uint32)


class _Gate:
    """What share of the range the predictions get, for each firmness of both and whether they agree."""

    def __init__(self):
        self.count, self.fresh = np.tile(np.array([6, 1, 1]), (32, 1)), []
        self.learn()

    def learn(self) -> None:
        if self.fresh:
            self.count += np.bincount(np.concatenate(self.fresh), minlength=96).reshape(32, 3)
            self.fresh = []
        total = self.count.sum(1, keepdims=True)
        share = 1 + self.count * ((1 << _GATE) - 3) // total
        self.two, self.any = (share[:, 2] << _ZERO).astype(np.uint32), ((share[:, 2] + share[:, 1]) << _ZERO).astype(np.uint32)
        full = total[:, 0] > _GATE_LIMIT
        self.count[full] = (self.count[full] + 1) >> 1


class _Zero:
    """Order 0: frequencies of the low 16 bits of the ids that no prediction gave, and one for all those not seen yet.

    ``freq``, ``below``: each value's part in 2^18, that of ``_NEW`` for those not seen; ``find``: the value of each part."""

    def __init__(self):
        self.count, self.fresh = np.zeros(_NEW, np.int64), []
        self.learn()

    def learn(self) -> None:
        if self.fresh:
            self.count += np.bincount(np.concatenate(self.fresh), minlength=_NEW)
            self.fresh = []
        total = int(self.count.sum())
        if total > _ZERO_LIMIT:
            self.count -= self.count >> 1
            total = int(self.count.sum())
        seen = np.flatnonzero(self.count)
        count = self.count[seen]
        room = (1 << _ZERO) - len(seen)
        new = min(max(room * int((count == 1).sum()) // max(total, 1), 64), room // 2)
        part = 1 + count * (room - new) // max(total, 1)
        ends = np.cumsum(part)
        self.new = int(ends[-1]) if len(seen) else 0
        rest = (1 << _ZERO) - self.new
        self.freq, self.below = np.full(_NEW + 1, rest, np.uint32), np.full(_NEW + 1, self.new, np.uint32)
        self.freq[seen], self.below[seen] = part, ends - part
        self.find = np.repeat(np.append(seen, _NEW).astype(np.uint32), np.append(part, rest))


def _mask(yes: np.ndarray, kind: type) -> np.ndarray:
    """All bits where ``yes`` holds: choosing by bits is faster than by branches."""
    return np.negative(yes.view(np.int8)).astype(kind)


def _run(coder, sizes: np.ndarray, ids: np.ndarray | None, wide: bool) -> np.ndarray:
    """Codes the lanes of a block in step (``ids``: a row for each, sizes descending), or decodes them."""
    lanes, steps = len(sizes), int(sizes[0])
    gate, zero = _Gate(), _Zero()
    signed, kind = (np.int64, np.uint64) if wide else (np.int32, np.uint32)
    table = np.zeros((1 << _ONE) + (1 << _TWO), kind)  # what id followed a context last, and in two bits how firmly
    out = np.zeros((steps, lanes), np.uint32)
    given = None if ids is None else np.ascontiguousarray(ids.T)
    before, earlier = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    live = np.searchsorted(-sizes, -np.arange(steps), "left")
    for t in range(steps):
        n = int(live[t])
        before, earlier = before[:n], earlier[:n]
        slot = np.empty((2, n), np.int64)
        slot[0] = before & 0xFFFF if wide else before
        slot[1] = (before * np.uint32(0x9E3779B1) + earlier * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _TWO)
        slot[1] += 1 << _ONE
        known = table.take(slot, mode="clip")
        firm, said = known & 3, (known >> 2).astype(np.uint32, copy=False)
        context = ((firm[1] << 3) | (firm[0] << 1)).astype(np.uint8) | (said[0] == said[1]).view(np.uint8)
        two, some = gate.two.take(context, mode="clip"), gate.any.take(context, mode="clip")
        if given is None:
            part = coder.part(n)
            by_two, by_any = part < two, part < some
            x = said[0] ^ ((said[0] ^ said[1]) & _mask(by_two, np.int32).view(np.uint32))
        else:
            x = given[t, :n]
            by_two = x == said[1]
            by_any = by_two | (x == said[0])
        gate.fresh.append(context * 3 + by_two.view(np.uint8) + by_any.view(np.uint8))
        chosen, width = _mask(by_two, np.int32).view(np.uint32), some - two
        below = two & ~chosen
        width ^= (width ^ two) & chosen
        rest = np.flatnonzero(~by_any)
        if len(rest):
            start = some.take(rest)
            share = (np.uint32(1 << _GATE + _ZERO) - start) >> np.uint32(_ZERO)
            if given is None:
                low = zero.find.take((part.take(rest) - start) // share, mode="clip")
            else:
                low = x.take(rest)
                high, low = low >> np.uint32(16), low & np.uint32(0xFFFF)
            at = zero.below.take(low, mode="clip")
            below[rest] = start + share * at
            width[rest] = share * zero.freq.take(low, mode="clip")
        coder.take(below, width)
        if len(rest):
            new = np.flatnonzero(at == zero.new)
            if len(new):
                low[new] = coder.flat(rest[new], low[new])
            zero.fresh.append(low)
            if wide:
                high = coder.flat(rest, None if given is None else high)
            if given is None:
                x[rest] = low | (high << np.uint32(16)) if wide else low
        if given is None:
            out[t, :n] = x
        right, firmly = said == x, firm > 1
        step = ((firm < 3) & right).view(np.int8) - (firmly > right).view(np.int8)
        fresh = (x.astype(kind, copy=False) << kind(2)) | kind(1)
        # of lanes with one slot the last one counts, as numpy defines it
        table[slot] = fresh ^ ((fresh ^ (known + step.astype(signed).view(kind))) & _mask(right | firmly, signed).view(kind))
        before, earlier = x, before
        done = t + 1
        if done < steps:
            if done & t == 0 or done % _ZERO_STEPS == 0:
                zero.learn()
            if t < _GATE_STEPS or done % _GATE_STEPS == 0:
                gate.learn()
    return out.T


def encode_segment(doc_ids: list[int], docs: list[bytes]) -> bytes:
    """A segment of documents, given as little-endian unsigned 32-bit ids."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
    size = LEAST
    while size < BLOCK and len(ids) > size * LANES // 4:
        size *= 2
    lens, sums, words = [], [], []
    for part, sizes in _blocks(len(ids), size, LANES):
        grid = np.zeros((len(sizes), int(sizes[0])), np.uint32)
        grid.ravel()[: part.stop - part.start] = ids[part]
        coder = _Writer(len(sizes))
        _run(coder, sizes, grid, wide)
        count, data = coder.finish()
        lens.append(count.astype("<u4").tobytes())
        sums.append(zlib.crc32(ids[part]))
        words.append(data)
    index = np.asarray(doc_ids, "<i8").tobytes() + np.asarray([len(d) // 4 for d in docs], "<u8").tobytes()
    index += b"".join(lens) + np.asarray(sums, "<u4").tobytes()
    head = MAGIC + struct.pack("<BIIIQI", wide, size, LANES, len(docs), len(ids), zlib.crc32(index))
    return head + index + b"".join(words)


def _blocks(n_ids: int, size: int, lanes: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Where each block's ids stand, and how many of them each of its lanes has."""
    for at in range(0, n_ids, size * lanes):
        n = min(size * lanes, n_ids - at)
        sizes = np.full(-(-n // size), size)
        sizes[-1] = n - size * (len(sizes) - 1)
        yield slice(at, at + n), sizes


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, their numbers of ids, all ids); a wrong checksum is an error."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a segment of token ids")
    wide, size, lanes, n_docs, n_ids, crc = struct.unpack_from("<BIIIQI", data, len(MAGIC))
    at = len(MAGIC) + struct.calcsize("<BIIIQI")
    n_lanes, n_blocks = -(-n_ids // size), -(-n_ids // (size * lanes))
    index = data[at : at + 16 * n_docs + 4 * n_lanes + 4 * n_blocks]
    if zlib.crc32(index) != crc:
        raise ValueError("the index of a segment does not match its checksum")
    doc_ids, held = np.frombuffer(index, "<i8", n_docs), np.frombuffer(index, "<u8", n_docs, 8 * n_docs).astype(np.int64)
    lens = np.frombuffer(index, "<u4", n_lanes, 16 * n_docs).astype(np.int64)
    sums = np.frombuffer(index, "<u4", n_blocks, 16 * n_docs + 4 * n_lanes)
    at += len(index)
    out = np.empty(n_ids, "<u4")
    for i, (part, sizes) in enumerate(_blocks(n_ids, size, lanes)):
        some = lens[i * lanes : i * lanes + len(sizes)]
        end = at + 4 * int(some.sum())
        out[part] = _run(_Reader(some, data[at:end]), sizes, None, bool(wide)).ravel()[: part.stop - part.start]
        at = end
        if zlib.crc32(out[part]) != sums[i]:
            raise ValueError(f"block {i} of a segment does not match its checksum")
    return doc_ids, held, out


def write_ids(df: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, added: bool = False) -> None:
    """Writes every document's ids and end id, in ascending order of document ids, as files of segments. ``added``: see ``Encoder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path, True, added), np.uint32(end_id).astype("<u4").tobytes()
        file, seq, start = TaskContext.get().partitionId(), 0, 0
        ids, docs, held = [], [], 0

        def segment():
            cols = [[file], [seq], [start], [held], [encode_segment(ids, docs)]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["file", "seq", "start", "n_ids", "segment"])

        for part, _, _ in X.slices(batches, "t"):
            found = enc.encode([t or "" for t in part.column("t").to_pylist()])
            for k, x in zip(part.column("k").to_pylist(), found):
                if docs and held + len(x) // 4 + 1 > BLOCK * LANES:
                    yield segment()
                    seq, start = seq + 1, start + held
                    ids, docs, held = [], [], 0
                ids.append(k)
                docs.append(x + end)
                held += len(x) // 4 + 1
        if docs:
            yield segment()

    files = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(key(id_col).alias("k"), F.xxhash64(text).alias("th"), text.alias("t"))
    rows = rows.repartitionByRange(files, "k", "th").sortWithinPartitions("k", "th").drop("th")
    out = rows.mapInArrow(run, "file int, seq long, start long, n_ids long, segment binary")
    with text_batches(df.sparkSession):
        out.write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and with ``ids`` the ids) of every document of the files."""
    rows = spark.read.parquet(path)
    totals = sorted((r["file"], r["n"]) for r in rows.groupBy("file").agg(F.sum("n_ids").alias("n")).collect())
    base, at = {}, 0
    for file, n in totals:
        base[file], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for file, start, data in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("segment")):
                    docs, sizes, found = decode_segment(data.as_py())
                    cut = np.r_[0, np.cumsum(sizes)]
                    raw = found.view(np.uint8)
                    sums = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    cols = [pa.array(docs, mask=docs == LAST), pa.array(base[file] + start + cut[:-1]), pa.array(sizes), pa.array(sums, pa.int64())]
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(found.astype(np.int32))))
                    yield pa.record_batch(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
        finally:
            X.give_back()

    return rows.select("file", "start", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))
