"""Words, their places and hashes in whole Arrow batches of text, by numpy on the UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: For work whose arrays are up to a hundred times as large as the text, so that a slice decides what a Python worker needs.
FEW_BYTES = 1 << 18
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another and the n + 1 places where they begin; null counts as empty."""
    if pa.types.is_null(array.type):
        array = array.cast(pa.string())
    array = pc.fill_null(array, "")
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text (one row at least), with their bytes and offsets. What the task has freed is given back at the end."""
    try:
        for batch in batches:
            buf, offs = flat(batch.column(column))
            at, n = 0, batch.num_rows
            while at < n:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
                yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
                at = to
    finally:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: Spark's Python workers live on after a task, and would hold what its largest slice took beside the next stage's needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of texts.

    ``starts``, ``ends``: byte places; ``first``: index of each text's first word (n + 1); ``inside``: which bytes
    belong to words; ``size``: words of each text.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        begin, end = inside.copy(), inside.copy()
        if len(buf):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            full = offs[1:] > offs[:-1]
            head, tail = offs[:-1][full], offs[1:][full] - 1
            begin[head] = inside[head]
            end[tail] = inside[tail]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.size = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.size)), self.size)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: equal words have equal hashes."""
        return span_hashes(self.buf[self.inside], self.ends - self.starts)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes in which consecutive words of a text are one space apart; where each word starts and ends there."""
        keep = self.inside.copy()
        if len(keep):
            keep[1:] |= self.inside[:-1]
        place = np.cumsum(keep)
        starts = place[self.starts] - 1 if len(self.starts) else self.starts
        out = np.where(self.inside, self.buf, 32)[keep] if len(keep) else self.buf
        return out.astype(np.uint8), starts, starts + (self.ends - self.starts)


def span_hashes(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hashes of consecutive spans of ``data`` with lengths ``lens`` (all at least 1)."""
    if not len(lens):
        return np.empty(0, U64)
    at = np.cumsum(lens) - lens
    place = np.arange(len(data), dtype=np.int64) - np.repeat(at, lens)
    powers = np.cumprod(np.full(int(lens.max()), _BASE, U64))
    return mix(np.add.reduceat((data.astype(U64) + U64(1)) * powers[place], at) + lens.astype(U64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def chain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of the sequence (x, y)."""
    return mix(x * _BASE + y)


def lowered(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z, and the letters of Latin-1 beyond ASCII, in lower case."""
    out = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    if len(out):
        after = np.zeros(len(out), bool)
        after[1:] = out[:-1] == 0xC3
        out[after & (out >= 0x80) & (out <= 0x9E) & (out != 0x97)] += 32
    return out


def as_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
