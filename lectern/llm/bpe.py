"""BPE encoding and decoding by tree concatenation.

Every different pre-token is cut into halves down to leaves of ``LEAF``
characters; the leaves of long text are encoded as one parallel batch, and
encoded halves are joined by encoding growing windows around the joint anew
until both sides agree with what they were.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from lectern.llm.bytesops import pieces
from lectern.llm.common import between, frugal, give_back
from lectern.llm.pretokens import Pretokens, gather

#: Leaves of the tree have at most this many characters; a pre-token of more is encoded as halves.
LEAF = 8
#: From this many leaves they are encoded by the library's threads.
MANY = 256
#: Bytes of text encoded at a time.
STEP = 1 << 17
#: Pre-tokens that a worker keeps, letters of them, and bits of their table's places: less than op4 keeps, whose model costs less memory.
CACHED, LETTERS, SLOTS = 200_000, 1 << 21, 18


class TreeBpe:
    """The BPE model of a tokenizer file on one pre-token, by concatenation of encoded halves."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.middle = models.BPE(self.vocab, merges)
        self.last = models.BPE(self.vocab, merges, end_of_word_suffix=self.suffix) if self.suffix else self.middle
        self.inner = Tokenizer(self.middle)

    def _leaves(self, pieces: list[str]) -> list[list[str]]:
        if len(pieces) < MANY:
            return [self._encode(p, k + 1 == len(pieces)) for k, p in enumerate(pieces)]
        return [x.tokens for x in self.inner.encode_batch(pieces[:-1], add_special_tokens=False)] + [self._encode(pieces[-1], True)]

    def _encode(self, text: str, final: bool) -> list[str]:
        return [t.value for t in (self.last if final else self.middle).tokenize(text)]

    def _window(self, tokens: Sequence[str], final: bool) -> list[str]:
        text = "".join(tokens)
        return self._encode(text.removesuffix(self.suffix) if final else text, final)

    def join(self, left: list[str], right: list[str], final: bool) -> list[str]:
        """One encoding from two: re-encode a window around the joint, growing until its ends are the sides' own tokens.

        A sequence is the BPE encoding of its text exactly if each adjacent
        pair is one of its own text, so agreement at both ends suffices.
        """
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            middle = self._window(left[len(left) - i :] + right[:j], final and j == len(right))
            left_agrees = i == len(left) or middle[0] == left[-i]
            right_agrees = j == len(right) or middle[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[: len(left) - i] + middle + right[j:]
            i, j = i * (1 if left_agrees else 2), j * (1 if right_agrees else 2)

    def tokens(self, text: str, leaf: int = LEAF) -> list[str]:
        """Halves down to leaves, then joined pairwise, level by level."""
        if not text:
            return []
        n = 1
        while n * leaf < len(text):
            n *= 2
        bounds = [len(text) * k // n for k in range(n + 1)]
        level = self._leaves([text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1], k + 2 == len(level)) for k in range(0, len(level), 2)]
        return level[0]


class Encoder:
    """A tokenizer file's encoding and decoding of Arrow batches."""

    def __init__(self, path: str) -> None:
        self.tree = TreeBpe(path)
        self.own = Pretokens(path, lambda mapped: [self.tree.vocab[t] for t in self.tree.tokens(mapped)], cached=CACHED, letters=LETTERS, slots=SLOTS)
        self.plain = self.own.library.decoder is None
        self.decimal = csr([f"{i} ".encode() for i in range(len(self.own.names))])
        self.name = csr([f"{x} ".encode() for x in self.own.names])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, o = self.own.encode(texts)
        return [ids[a:b].tolist() for a, b in zip(o, o[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.own.library.decode(ids, skip_special_tokens=False) if ids else ""

    def decoded(self, ids: np.ndarray, o: np.ndarray) -> list[bytes]:
        """The decoding of each text's ids in UTF-8."""
        if self.plain:
            return self._joined(ids, o, self.name)
        return [self.decode(ids[a:b].tolist()).encode() for a, b in zip(o, o[1:], strict=False)]

    def decimals(self, ids: np.ndarray, o: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal with a space between."""
        return self._joined(ids, o, self.decimal)

    @staticmethod
    def _joined(ids: np.ndarray, o: np.ndarray, parts: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        flat, start = parts
        made, before = gather(flat, start[ids], start[ids + 1])
        at = before[o].tolist()
        return [made[a : max(a, b - 1)].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def written(self, texts: list[str | None]) -> list[tuple[int, bytes, bytes]]:
        """Of each text, how many ids, they in decimal, and their decoding."""
        ids, o = self.own.encode(texts)
        return [*zip(np.diff(o).tolist(), self.decimals(ids, o), self.decoded(ids, o), strict=True)]


def csr(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts]))


@cache
def encoder(path: str) -> Encoder:
    """One a worker; what it remembers of texts is bounded."""
    made = Encoder(path)
    give_back()
    return made


#: What the two columns made of the ids are called on the way.
MADE = ("__lectern_made_1", "__lectern_made_2")


def _mapper(path: str, text: str, full: bool):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in between(batches):
            for batch in pieces(whole, text, STEP):
                at = batch.schema.get_field_index(text)
                ids, o = own.own.encode(batch.column(at).to_pylist())
                decoded, counts = own.decoded(ids, o), np.diff(o)
                if full:
                    added = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.binary()).cast(pa.string())]
                else:
                    added = [pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string()) for made in (own.decimals(ids, o), decoded)]
                kept = [k for k in range(batch.num_columns) if k != at or full]
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(counts, pa.int64()), *added], [names[k] for k in kept] + ["n_tokens", *MADE])

    return run


def encode(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids`` (array of int) and ``decoded`` to every row.

    Null and empty texts have no ids and decode to an empty text. Columns of
    these names are replaced; all others pass through.
    """
    own = docs.drop("n_tokens", "ids", "decoded")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(_mapper(path, text, True), f"{fields}, n_tokens long, {MADE[0]} array<int>, {MADE[1]} string").withColumnsRenamed(dict(zip(MADE, ("ids", "decoded"), strict=True)))


def digests(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row per document of the contract: counts and hashes of ids and decoding, made where the text is encoded."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(_mapper(path, text, False), f"`{doc_id}` {kind}, n_tokens long, {MADE[0]} string, {MADE[1]} string").withColumnsRenamed(dict(zip(MADE, ("ids_sha256", "decoded_sha256"), strict=True)))
