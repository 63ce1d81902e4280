"""Exact BPE encoding of Arrow batches: array-wise pre-tokenization, the model on each different pre-token.

Pre-tokens are looked up by hash and then compared letter by letter with the
one that the cached ids belong to; those that only share its hash are looked up
as strings.

Serves the two pre-tokenizers of the public files: byte-level with the space
before a word kept, and words with white space dropped. Everything else about
the file (vocabulary, merges, added tokens) is read from it.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from lectern.llm.bytesops import U, prefix_hashes_of, span_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Pre-tokens that a worker keeps, and letters of them; beyond either the cache starts anew.
CACHED, LETTERS = 400_000, 1 << 23
_SLOTS = 19
_RARE = re.compile("[\u1C80-\u1C8F\uA7C0-\uA7FF\U00010000-\U0001EFFF\U00020000-\U0010FFFF]")


@cache
def classes() -> np.ndarray:
    """Code point -> SPACE, LETTER, NUMBER or OTHER."""
    kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kind[c] = LETTER if k == "L" else NUMBER
    kind[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kind


@cache
def _random() -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 63, sys.maxunicode + 1, dtype=np.uint64) | U(1)


@cache
def byte_letters() -> str:
    """The letter that byte-level files use for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(free)) for b in range(256))


def bounds(c: np.ndarray, first: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of code points ``c``; ``first`` marks each document's first.

    ``spaced``: numbers run together, one space goes with what follows it and
    other white space makes pre-tokens of its own (the byte-level form);
    otherwise each number stands alone and white space is dropped.
    """
    n = len(c)
    kind = classes()[c]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= first
    if not spaced:
        begin |= kind == NUMBER
    at = np.flatnonzero(c == 39)
    at = at[begin[at]]
    if len(at):
        after, after2 = np.minimum(at + 1, n - 1), np.minimum(at + 2, n - 1)
        a, b = c[after], c[after2]
        inside, inside2 = (at + 1 < n) & ~first[after], (at + 2 < n) & ~first[after2]
        one = np.isin(a, [115, 116, 109, 100]) & inside
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & inside & inside2
        if spaced:
            free = first[at] | (c[at - 1] != 32)
            one, two = one & free, two & free
        x, y = at[one], at[two]
        begin[x + 1] = False
        begin[y + 1] = False
        begin[np.minimum(x + 2, n - 1)] |= x + 2 < n
        begin[np.minimum(y + 3, n - 1)] |= y + 3 < n
    if not spaced:
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        keep = kind[starts] != SPACE
        return starts[keep], ends[keep]
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    run = np.flatnonzero(kind[starts] == SPACE)
    last = ends[run] - 1
    inner = ends[run] < n
    inner[inner] = ~first[ends[run][inner]]
    blank = inner & (c[last] == 32)
    begin[ends[run[blank]]] = False
    begin[last[inner]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n)


class Pretokens:
    """Encodes texts piece by piece; every different pre-token goes through the library's model once while it is cached."""

    def __init__(self, path: str, encode_pretoken=None, *, cached: int | None = None, letters: int | None = None, slots: int = _SLOTS) -> None:
        """``encode_pretoken`` gets a pre-token in the file's letters and returns its ids; by default the library's model does.

        ``cached`` and ``letters`` bound the cache (``CACHED`` and ``LETTERS``), whose table has twice 2 ** ``slots`` places.
        """
        self.bound, self.slots = (cached, letters), slots
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.spaced = file["pre_tokenizer"]["type"] == "ByteLevel"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in file["added_tokens"]]
        model = self.library.model
        self.encode_pretoken = encode_pretoken or (lambda mapped: [t.id for t in model.tokenize(mapped)])
        self.names = np.array([self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())], object)
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.slot_hash, self.slot_row = np.zeros(2 << self.slots, U), np.zeros(2 << self.slots, np.int32)
        self.rows, self.exact = 0, {}
        self.ids, self.starts = np.zeros(1 << 18, np.int32), np.zeros(1 << 16, np.int64)
        self.chars, self.char_starts = np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int64)

    def _put(self, what: str, values: np.ndarray, lengths: np.ndarray) -> None:
        """Append to ``what`` (ids or chars) the values of new rows."""
        flat, starts = getattr(self, what), getattr(self, "starts" if what == "ids" else "char_starts")
        at, n = int(starts[self.rows]), self.rows + len(lengths) + 1
        while at + len(values) > len(flat):
            flat = np.append(flat, np.zeros_like(flat))
        while n > len(starts):
            starts = np.append(starts, np.zeros_like(starts))
        flat[at : at + len(values)] = values
        starts[self.rows + 1 : n] = at + np.cumsum(lengths)
        setattr(self, what, flat)
        setattr(self, "starts" if what == "ids" else "char_starts", starts)

    def _add(self, pretokens: list[str]) -> np.ndarray:
        """Encode pre-tokens and keep them; their rows."""
        found = [self.encode_pretoken(p.encode().decode("latin-1").translate(self.letters)) for p in pretokens]
        self._put("ids", np.fromiter((i for x in found for i in x), np.int32), np.fromiter(map(len, found), np.int64, len(found)))
        self._put("chars", np.frombuffer("".join(pretokens).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, pretokens), np.int64, len(found)))
        self.rows += len(found)
        return np.arange(self.rows - len(found), self.rows)

    def normal(self, text: str) -> str:
        if self.spaced:
            return text
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()

    def odd(self, text: str) -> bool:
        """Whether the text needs the whole library: it holds an added token, a letter whose lower case
        depends on its place, or one of those on which Unicode versions differ.
        """
        return any(s in text for s in self.special) or not self.spaced and "Σ" in text or not text.isascii() and _RARE.search(text) is not None

    def _second(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes & U((1 << self.slots) - 1)) + U(1 << self.slots)).astype(np.int64)

    def _learn(self, text: str, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows of the pre-tokens, new ones included."""
        hashes = span_hashes(prefix_hashes_of(_random()[c]), start, end)
        slot = (hashes >> U(64 - self.slots)).astype(np.int64)
        row = self.slot_row[slot]
        missing = np.flatnonzero(self.slot_hash[slot] != hashes)
        if len(missing):  # each hash has a second place
            other = self._second(hashes[missing])
            row[missing] = self.slot_row[other]
            missing = missing[self.slot_hash[other] != hashes[missing]]
        if len(missing):
            new, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            rows = self._add([text[a:b] for a, b in zip(start[missing[at]].tolist(), end[missing[at]].tolist(), strict=True)])
            place = slot[missing[at]]
            place = np.where(self.slot_hash[place] == 0, place, self._second(new))
            self.slot_hash[place], self.slot_row[place] = new, rows
            row[missing] = rows[back]
        for k in self._others(c, start, end, row).tolist():  # another pre-token has this one's hash
            own = text[start[k] : end[k]]
            if own not in self.exact:
                self.exact[own] = int(self._add([own])[0])
            row[k] = self.exact[own]
        return row

    def _others(self, c: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which pre-tokens differ from the letters of their row."""
        length, a = end - start, self.char_starts[row]
        short = self.char_starts[row + 1] - a != length
        own, before = gather(c, start, end)
        kept, _ = self._cut(a, length, short) if short.any() else gather(self.chars, a, a + length)
        wrong = np.flatnonzero(own != kept)
        return np.union1d(np.flatnonzero(short), np.searchsorted(before, wrong, "right") - 1)

    def _cut(self, a: np.ndarray, length: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like ``gather``, with zeros for the rows in ``short``."""
        flat = np.append(self.chars, np.zeros(int(length.max()), np.uint32))
        return gather(flat, np.where(short, len(self.chars), a), np.where(short, len(self.chars), a) + length)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the n+1 offsets of the texts."""
        texts = [t or "" for t in texts]
        odd = self.odd("".join(texts))
        whole = {k: self.library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if odd and self.odd(t)}
        normal = ["" if k in whole else self.normal(t) for k, t in enumerate(texts)]
        joined = "".join(normal)
        if not joined:
            ids, offsets = np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        else:
            cached, letters = (own or default for own, default in zip(self.bound, (CACHED, LETTERS), strict=True))
            if self.rows > cached or self.char_starts[self.rows] > letters:
                self.clear()
            c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            edges = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) for t in normal], out=edges[1:])
            first = np.zeros(len(c), bool)
            first[edges[:-1][edges[:-1] < len(c)]] = True
            start, end = bounds(c, first, self.spaced)
            row = self._learn(joined, c, start, end)
            ids, before = gather(self.ids, self.starts[row], self.starts[row + 1])
            offsets = before[np.searchsorted(start, edges)]
        if whole:
            parts = [np.asarray(whole[k], np.int32) if k in whole else ids[offsets[k] : offsets[k + 1]] for k in range(len(texts))]
            ids, offsets = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, offsets


def places(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indexes that the spans cover, one span after another, and the spans' n+1 offsets in that."""
    length = end - start
    before = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=before[1:])
    at = np.arange(before[-1])
    at += np.repeat(start - before[:-1], length)
    return at, before


def gather(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``flat`` one after another, and their n+1 offsets in that."""
    at, before = places(start, end)
    return flat[at], before
