"""Token ids of whole texts with a public tokenizer file, word by word with a bounded cache."""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Words, and parts of words, whose ids a worker remembers at least; it holds at most twice as many and those of one call.
CACHE = 150_000
#: Characters of texts that are cut into parts at once, about.
LONG = 1 << 20
#: The pre-tokenizers' patterns of the two kinds of files, over ASCII and the letters of Latin-1.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_BYTE_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t\n\r A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
_WORD_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\t\n\r A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
#: Kinds of the bytes of plain texts, as the patterns see them: white space, letters, digits, other characters, the end of a text.
_SPACE, _LETTER, _DIGIT, _OTHER, _END = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[9, 10, 13, 32]] = _SPACE
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[0] = _END
#: Parts that a worker finds at a glance: 2^SLOTS of up to WIDE ids, 25 MB.
SLOTS, WIDE = 19, 8
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def plain_parts(buf: np.ndarray, lead: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts that ``_BYTE_PARTS`` (``lead``) or ``_WORD_PARTS`` find in plain texts, each of which three zero bytes end: where each part begins
    and ends, and how many parts begin before the end of each text."""
    kind = _KINDS.take(buf)
    cut = np.ones(len(buf), bool)
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    if lead:  # the last white space before something else stands alone, or leads it if it is a space
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
        cut[last] = True
        cut[last[buf[last] == 32] + 1] = False
    else:
        cut |= kind == _DIGIT
    mark = np.flatnonzero(buf == 39)
    mark = mark[cut[mark]]
    one, two = buf[mark + 1], buf[mark + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))
    mark, size = mark[short | long], np.where(short, 2, 3)[short | long]
    cut[mark + 1] = False
    cut[mark + size] = True
    places = np.flatnonzero(cut)
    kind = kind.take(places)
    part = kind != _END if lead else (kind != _END) & (kind != _SPACE)
    at = np.flatnonzero(part)  # the last place is the end of a text
    return places[at], places[at + 1], np.cumsum(part)[kind == _END]


class Table:
    """Ids of parts of up to 16 bytes that have up to ``WIDE`` ids: a slot for each hash, which holds the part that came last."""

    def __init__(self):
        self.head, self.tail = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint64)
        self.size, self.ids = np.zeros(1 << SLOTS, np.uint8), np.zeros((1 << SLOTS, WIDE), "<u4")

    def find(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Looks up parts of ``buf``, which 16 zero bytes end; no part holds a zero byte. ``there``: which of them were found in their ``slot``."""
        eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
        size = end - begin
        self.heads = eight[begin] & _FIRST.take(np.minimum(size, 8))
        self.tails = eight[begin + 8] & _FIRST.take(np.clip(size - 8, 0, 8))
        mixed = (self.heads ^ (self.tails * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        self.slot = (mixed >> np.uint64(64 - SLOTS)).view(np.int64)
        self.there = (self.head.take(self.slot) == self.heads) & (self.tail.take(self.slot) == self.tails) & (size <= 16)

    def keep(self, which: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Puts in parts of the last look-up: ``size`` ids each, one after another in ``ids``."""
        slot, first = np.unique(self.slot[which], return_index=True)
        at = (np.cumsum(size) - size)[first]
        self.head[slot], self.tail[slot], self.size[slot] = self.heads[which[first]], self.tails[which[first]], size[first]
        self.ids[slot] = ids.take(at[:, None] + np.arange(WIDE), mode="clip")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level files: itself if it prints, else the next one from 256 on."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Recent(dict):
    """Ids by text. Beyond ``CACHE`` entries ``turn`` sets them aside, and those used again come back; the others go with the next turn."""

    aside: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self) > CACHE:
            self.aside = dict(self)
            self.clear()

    def back(self, text: str) -> bytes | None:
        found = self.aside.get(text)
        if found is not None:
            self[text] = found
        return found


class Encoder:
    """Ids as the ``tokenizers`` library gives them. ``added``: strings that the file lists as added tokens get their own ids, as by
    the library's default; otherwise they are read as ordinary text.

    Its pre-tokenizer never joins what stands before and after a space that a non-space follows, so a text may be cut there
    and equal words encoded once. ``lead``: the space belongs to the word after it (byte-level files); otherwise spaces leave
    no ids. Texts of ASCII and Latin-1 letters are cut as the pre-tokenizer's pattern does, many at once (``plain_parts``), and only their
    parts go to the library's model, each once; other texts are cut into words, and words with other letters go through the whole library. The library takes added tokens out of the raw text
    first, the leftmost and longest, and reads what stands between them as texts of their own; so does ``encode``.
    """

    def __init__(self, path: str, lead: bool, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        kinds = self.tokenizer.get_added_tokens_decoder() if added else {}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in kinds.values()):
            raise ValueError(f"{path}: added tokens that depend on the text around them or on normalized text are not supported")
        self.added = {t.content: _bytes([i]) for i, t in kinds.items()}
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.lead = lead
        self.odd = re.compile(r" (?:\s|\Z)")
        self.cut = re.compile(r" (?=\S)")
        self.ends = re.compile(r"(?<=[A-Za-z])(?![A-Za-zÀ-ÖØ-öø-ÿ])|(?<=[0-9])(?![0-9])" + ("" if lead else "|(?=[0-9])"))
        self.heads, self.words, self.parts = Recent(), Recent(), Recent()
        self.table = Table()
        self.letters = dict(enumerate(byte_letters()))
        self.cut_parts = (_BYTE_PARTS if lead else _WORD_PARTS).findall

    def _learn(self, cache: Recent, words: list[str], before: str) -> None:
        """Put the ids of all ``words`` into ``cache``: of plain ones by their parts, of others by the whole library."""
        rare, fresh = [], {}
        for w in set(words):
            if w in cache or cache.back(w) is not None:
                continue
            if _PLAIN.fullmatch(w):
                fresh[w] = self.cut_parts(before + w if self.lead else w.lower())
            else:
                rare.append(w)
        self._learn_parts({p for parts in fresh.values() for p in parts})
        get = self.parts.__getitem__
        cache.update((w, b"".join(map(get, parts))) for w, parts in fresh.items())
        for at in range(0, len(rare), 4096):
            some = rare[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([before + w for w in some], add_special_tokens=False)
            cache.update((w, _bytes(x.ids)) for w, x in zip(some, found))

    def _learn_parts(self, parts: set[str]) -> None:
        known, aside, tokenize, letters = self.parts, self.parts.aside, self.tokenizer.model.tokenize, self.letters
        space = letters[32]
        for p in parts:
            if p in known:
                continue
            found = aside.get(p)
            if found is None:
                # printing ASCII but the space stands for itself
                spelt = p.replace(" ", space) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters)
                found = _bytes([t.id for t in tokenize(spelt)])
            known[p] = found

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts, about ``LONG`` characters at once; a longer text is cut where letters or digits end, which ends a part in any text."""
        out: list[list[bytes]] = [[] for _ in texts]
        some: list[tuple[int, str]] = []
        held = 0
        for i, t in enumerate(texts):
            at = 0
            while at < len(t):
                m = self.ends.search(t, at + LONG) if len(t) - at > LONG else None
                end = m.start() if m else len(t)
                if held and held + end - at > LONG:
                    self._put(some, out)
                    some, held = [], 0
                some.append((i, t[at:end]))
                at, held = end, held + end - at
        if some:
            self._put(some, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _put(self, some: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        """Appends the ids of pieces of plain texts to those of their texts."""
        joined = "\0\0\0".join([t for _, t in some])
        raw = (joined if self.lead else joined.lower()).encode() + bytes(16)
        buf, table = np.frombuffer(raw, np.uint8), self.table
        begin, end, upto = plain_parts(buf[:-13], self.lead)
        table.find(buf, begin, end)
        there = table.there
        many = np.where(there, table.size.take(table.slot), 0).astype(np.int64)
        ids = table.ids.take(table.slot[there], axis=0)[np.arange(WIDE) < many[there][:, None]]
        new = np.flatnonzero(~there)
        if len(new):
            parts = [raw[b:e].decode() for b, e in zip(begin[new].tolist(), end[new].tolist())]
            self._learn_parts(set(parts))
            found = list(map(self.parts.__getitem__, parts))
            size = many[new] = np.fromiter(map(len, found), np.int64, len(found)) // 4
            more = np.frombuffer(b"".join(found), "<u4")
            known, every = np.repeat(there, many), np.empty(many.sum(), "<u4")
            every[known], every[~known] = ids, more
            ids = every
            fit = (end[new] - begin[new] <= 16) & (size > 0) & (size <= WIDE)
            table.keep(new[fit], size[fit], more[np.repeat(fit, size)])
        bound = [0, *(4 * np.r_[0, np.cumsum(many)][upto]).tolist()]
        ids = ids.tobytes()
        for (i, _), b, e in zip(some, bound, bound[1:]):
            out[i].append(ids[b:e])

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not any(s in t for s in self.added for t in texts):
            return self._ordinary(texts)
        split = [self.around.split(t) for t in texts]
        found = iter(self._ordinary([s for one in split for s in one[::2]]))
        return [b"".join([self.added[s] if i % 2 else next(found) for i, s in enumerate(one)]) for one in split]

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        for cache in (self.heads, self.words, self.parts):
            cache.turn()
        plain = [_PLAIN.fullmatch(t) is not None for t in texts]
        easy = iter(self._plain_ids([t for t, p in zip(texts, plain) if p]))
        odd = iter(self._odd_ids([t for t, p in zip(texts, plain) if not p]))
        return [next(easy if p else odd) for p in plain]

    def _odd_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with other letters, word by word."""
        if not self.lead:
            split = [t.split(" ") for t in texts]
            self._learn(self.words, [w for s in split for w in s], "")
            get = self.words.__getitem__
            return [b"".join(map(get, s)) for s in split]
        split = [self.cut.split(t) if self.odd.search(t) else t.split(" ") for t in texts]
        self._learn(self.heads, [s[0] for s in split], "")
        self._learn(self.words, [w for s in split for w in s[1:]], " ")
        get = self.words.__getitem__
        return [self.heads[s[0]] + b"".join(map(get, s[1:])) for s in split]


@lru_cache(maxsize=2)
def encoder(path: str, lead: bool, added: bool = False) -> Encoder:
    return Encoder(path, lead, added)
