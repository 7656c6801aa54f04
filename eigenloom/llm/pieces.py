"""SentencePiece encoding and decoding: one automaton over all pieces, one Viterbi pass.

An Aho-Corasick automaton over the ordinary pieces of a model file reads the text once. At each place it follows the output links to every piece that
ends there, longest first, and relaxes the best score of that place from the place where the piece begins; the segmentation is read back from the end.
Scores are the model's. A character that is no piece is written as its byte pieces (``BYTE_SCORE`` each).

As no piece has the space mark after another character, the text falls apart before every run of marks, and a worker remembers the ids of
the words it has met (a bounded cache of whole results, not a cut of the work).

Decoding gives back every text exactly: a space mark that stands in the text itself is written as bytes. Defined results: null gives null ids and an empty
list gives an empty text; ids that are no pieces, and bytes that are no UTF-8, decode to the replacement character; extra columns and repeated rows are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import without

MARK = "▁"
BYTE_SCORE = -40_000.0
CACHE = 200_000
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """Pieces as (text, score, id); ``byte_ids`` by byte value."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text, score, number in pieces:
            self.automaton.add_word(text, (len(text), score, number))
        self.automaton.make_automaton()
        self.byte_ids = byte_ids
        self.texts = {number: text.replace(MARK, " ").encode() for text, _, number in pieces}
        self.texts.update((b, bytes([i])) for i, b in enumerate(byte_ids))
        self.known: dict[str, bytes] = {}

    def segment(self, chunk: str) -> list[int]:
        """The ids of the best segmentation; equal scores go to the longer last piece."""
        n, least = len(chunk), float("-inf")
        best, size, number = [0.0] + [least] * n, [0] * (n + 1), [0] * (n + 1)
        done = 0

        def close(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if best[done] == least:
                    best[done], size[done], number[done] = best[done - 1] + BYTE_SCORE * len(chunk[done - 1].encode()), 1, -1

        for end, (length, score, piece) in self.automaton.iter(chunk):
            close(end)
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], size[end + 1], number[end + 1] = total, length, piece
        close(n)
        out: list[int] = []
        while n:
            if number[n] < 0:
                out += [self.byte_ids[b] for b in reversed(chunk[n - 1].encode())]
            else:
                out.append(number[n])
            n -= size[n]
        return out[::-1]

    def _ids(self, chunk: str) -> bytes:
        found = self.known.get(chunk)
        if found is None:
            found = np.asarray(self.segment(chunk), "<u4").tobytes()
            if len(chunk) <= 64:
                if len(self.known) >= CACHE:
                    self.known = {}
                self.known[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if not text:
            return b""
        parts = text.split(MARK)
        out = [self._ids(c) for c in _CHUNKS.findall(MARK + parts[0].replace(" ", MARK))]
        if len(parts) > 1:
            literal = np.asarray([self.byte_ids[b] for b in MARK.encode()], "<u4").tobytes()
            for part in parts[1:]:
                out.append(literal)
                out += [self._ids(c) for c in _CHUNKS.findall(part.replace(" ", MARK))]
        return b"".join(out)

    def decode(self, ids) -> str:
        get = self.texts.get
        raw = b"".join([get(i, b"\xef\xbf\xbd") for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The ordinary and byte pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, by = [], [0] * 256
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            by[int(text[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((text, model.get_score(i), i))
    return PieceModel(pieces, by)


def _added(df: DataFrame, column: str, name: str, kind: T.DataType, work) -> DataFrame:
    kept = df if column == name else without(df, name)
    names = [c for c in kept.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*(batch.column(c) for c in names), work(batch.column(column))], [*names, name])

    return kept.mapInArrow(run, T.StructType([*(f for f in kept.schema.fields if f.name != name), T.StructField(name, kind)]))


def encode(df: DataFrame, path: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """All columns and the list of ids, in place of a column of that name."""

    def work(column):
        model = load(path)
        return pa.array([None if t is None else np.frombuffer(model.encode(t), "<u4").astype(np.int32) for t in column.to_pylist()], pa.list_(pa.int32()))

    return _added(df, text_col, name, T.ArrayType(T.IntegerType()), work)


def decode(df: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the text of the ids, in place of a column of that name."""

    def work(column):
        model = load(path)
        return pa.array([None if x is None else model.decode(x) for x in column.to_pylist()], pa.string())

    return _added(df, ids_col, name, T.StringType(), work)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and whether decoding gives the text back; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for part, _, _ in X.slices(batches, "t"):
            texts = [t or "" for t in part.column("t").to_pylist()]
            ids = [model.encode(t) for t in texts]
            same = [model.decode(np.frombuffer(i, "<u4").tolist()) == t for i, t in zip(ids, texts)]
            yield pa.record_batch([part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "exact"])

    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return docs.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, exact boolean")
