"""Repeated substrings across documents by distributed prefix doubling over thinned positions.

Every string of ``LENGTH`` bytes holds a seed: of its ``SEED``-byte substrings
the one with the least hash. Equal strings have equal seeds, so a position
whose seed lies in one document only is unique and drops out after the first
rank. Neighbouring positions with one seed make a run; runs that remain go, as
the bytes they span, to the range of seeds they belong to. There positions are
ranked by their first bytes and reranked by sorted pairs of ranks at growing
offsets until they are unique or the ranks cover ``LENGTH`` bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytesops import U, buffers, mix, pieces, prefix_hashes, span_hashes, strong_hashes
from lectern.llm.exchange import ANSWER, REQUEST, answer, answered, ask, buckets_for, grouped, request, rows_by_range, unpacked
from lectern.llm.pretokens import gather, places

#: Bytes of a repeated string, of a seed, and of the first rank.
LENGTH, SEED, FIRST = 50, 20, 25
#: Bytes of the corpus for each range of seeds (at least one range a shuffle partition), and of entries ranked at a time.
RANGE_BYTES, STEP_BYTES = 8 << 20, 2 << 20
NONE = np.iinfo(np.int64).max


@dataclass
class Runs:
    """Runs of positions with one seed, of a group of documents."""

    raw: list[np.ndarray]  # bytes, by piece
    piece: np.ndarray  # of each run
    start: np.ndarray  # first position, in its piece
    length: np.ndarray  # positions
    seed: np.ndarray
    document: np.ndarray  # row
    content: np.ndarray  # hash of the bytes that the run spans
    offsets: list[np.ndarray]  # document bounds, by piece
    rows: int

    @classmethod
    def of(cls, docs: pa.Table) -> Runs:
        raws, bounds, parts, rows = [], [], [], 0
        for chunk in docs.select(["text"]).to_batches():
            for batch in pieces(chunk):
                raw, o = buffers(batch.column(0))
                parts.append(_runs(raw, o, len(raws), rows))
                raws.append(raw)
                bounds.append(o)
                rows += len(o) - 1
        if not parts:
            return cls([], *[np.zeros(0, np.int64)] * 3, np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, U), [], 0)
        piece, start, length, seed, document, content = (np.concatenate(x) for x in zip(*parts, strict=True))
        return cls(raws, piece, start, length, seed, document, content, bounds, rows)

    def bytes_of(self, runs: np.ndarray) -> bytes:
        out = []
        for p in np.unique(self.piece[runs]):
            own = runs[self.piece[runs] == p]
            out.append((own, gather(self.raw[p], self.start[own], self.start[own] + self.length[own] + LENGTH - 1)))
        found: dict[int, bytes] = {}
        for own, (flat, at) in out:
            blob, at = flat.tobytes(), at.tolist()
            found.update(zip(own.tolist(), (blob[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))
        return b"".join(found[k] for k in runs.tolist())


def _runs(raw: np.ndarray, o: np.ndarray, piece: int, row: int) -> tuple[np.ndarray, ...]:
    n = len(raw) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty.astype(U), empty, empty.astype(U)
    c = prefix_hashes(raw)
    at = np.arange(len(raw) - SEED + 1)
    low, width = span_hashes(c, at, at + SEED), 1
    window = LENGTH - SEED + 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if window > width:
        low = np.minimum(low[: -(window - width)], low[window - width :])
    inside = np.zeros(n + 1, np.int32)
    has = o[1:] - o[:-1] >= LENGTH
    np.add.at(inside, o[:-1][has], 1)
    np.add.at(inside, o[1:][has] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    first = inside.copy()
    first[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    first[o[:-1][has]] = True
    start = np.flatnonzero(first)
    so_far = np.append(0, np.cumsum(inside))
    length = so_far[np.append(start[1:], n)] - so_far[start]
    document = np.searchsorted(o, start, "right") - 1
    content = strong_hashes(raw, start, start + length + LENGTH - 1)
    seed = mix(low[start] + U(1))  # least values lie low; ranges of keys must not
    return np.full(len(start), piece), start, length, seed, document + row, content


def _seed_request(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        """Each different seed of a group, and whether more than one of its documents hold it."""
        own = Runs.of(docs)
        keys, at = np.unique(own.seed, return_inverse=True)
        low, high = np.full(len(keys), NONE), np.full(len(keys), -1)
        np.minimum.at(low, at, own.document)
        np.maximum.at(high, at, own.document)
        return request(docs.column("g")[0].as_py(), keys, (low < high).astype(np.uint8), buckets)

    return run


def _shared(keys: np.ndarray, said: np.ndarray, sender: np.ndarray) -> np.ndarray:
    """1 for each seed that more than one document holds."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.bincount(back, weights=said, minlength=len(n)) > 0
    return ((n > 1) | several)[back].astype(np.uint8)


@dataclass
class Entries:
    """The different remaining runs of a group, by seed and content: one of each, with the least document id."""

    run: np.ndarray  # a run of each entry
    of: np.ndarray  # entry of each remaining run
    remaining: np.ndarray  # runs
    doc_id: np.ndarray

    @classmethod
    def of_group(cls, runs: Runs, shared: bytes, doc_ids: np.ndarray) -> Entries:
        keys, at = np.unique(runs.seed, return_inverse=True)
        remaining = np.flatnonzero(np.frombuffer(shared, np.uint8)[at] == 1) if len(keys) else np.zeros(0, np.int64)
        remaining = remaining[doc_ids[runs.document[remaining]] != NONE]
        order = np.lexsort((runs.content[remaining], runs.seed[remaining]))
        seed, content = runs.seed[remaining][order], runs.content[remaining][order]
        new = np.append(True, (seed[1:] != seed[:-1]) | (content[1:] != content[:-1]))[: len(order)]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        low = np.full(int(new.sum()), NONE)
        np.minimum.at(low, of, doc_ids[runs.document[remaining]])
        return cls(remaining[order][new], of, remaining, low)


def _ids(docs: pa.Table) -> np.ndarray:
    return docs.column("doc_id").fill_null(NONE).to_numpy()


def _run_request(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        runs = Runs.of(docs)
        own = Entries.of_group(runs, answered(answers), _ids(docs))
        seeds, lengths = runs.seed[own.run], runs.length[own.run]

        def said(a: int, b: int) -> bytes:
            return zstandard.ZstdCompressor(level=1).compress(own.doc_id[a:b].tobytes() + lengths[a:b].astype(np.uint32).tobytes() + runs.bytes_of(own.run[a:b]))

        return rows_by_range(docs.column("g")[0].as_py(), seeds, buckets, said)

    return run


def least_documents(flat: np.ndarray, start: np.ndarray, positions: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Of each position of each entry, the least id of a document with the same ``LENGTH`` bytes there.

    ``flat`` holds the entries' bytes, entry k from ``start[k]`` with
    ``positions[k]`` positions. Prefix doubling: ranks of the first bytes, then
    of pairs of ranks; positions with a rank of their own drop out.
    """
    c = prefix_hashes(flat)
    at = np.arange(len(flat) - FIRST + 1)
    rank = np.unique(span_hashes(c, at, at + FIRST), return_inverse=True)[1]
    every, before = gather(np.arange(len(flat)), start, start + positions)
    owner = np.repeat(doc_id, positions)
    out = owner.copy()
    alive, covered = np.arange(len(every)), FIRST
    names = np.full(len(flat), -1, np.int64)
    names[: len(rank)] = rank
    while covered < LENGTH and len(alive):
        step = min(covered, LENGTH - covered)
        # the rank at the offset is taken over all positions: one whose rank is unique there is unique here
        pair = names[:-step] * np.int64(len(flat) + 1) + names[step:]
        pair[(names[:-step] < 0) | (names[step:] < 0)] = -1
        _, new, n = np.unique(pair, return_inverse=True, return_counts=True)
        names = np.append(new, np.full(step, -1))
        names[: len(pair)][pair < 0] = -1
        covered += step
        alive = alive[n[new[every[alive]]] > 1]
    if len(alive):
        name = names[every[alive]]
        low = np.full(int(name.max()) + 1, NONE)
        np.minimum.at(low, name, owner[alive])
        out[alive] = low[name]
    return out


def _rank(batches):
    """One range of seeds: entries of all groups in, least documents by position out.

    Seeds are ranked in steps of bounded bytes. Of entries with the same seed
    and bytes, from whichever groups, one is ranked, with the least document.
    """
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    seeds, docs, counts, texts = [], [], [], []
    for r in rows:
        seeds.append(unpacked(r["keys"]))
        n = len(seeds[-1])
        blob = zstandard.ZstdDecompressor().decompress(r["said"])
        docs.append(np.frombuffer(blob, np.int64, n))
        counts.append(np.frombuffer(blob, np.uint32, n, 8 * n).astype(np.int64))
        texts.append(np.frombuffer(blob, np.uint8, offset=12 * n))
        r["keys"] = r["said"] = None
    sizes = [len(x) for x in seeds]
    seed, doc, positions, flat = (np.concatenate(x) for x in (seeds, docs, counts, texts))
    del seeds, docs, counts, texts
    size = positions + LENGTH - 1
    start = np.cumsum(size) - size
    at = np.append(0, np.cumsum(positions))
    low = np.empty(at[-1], np.int64)
    order = np.argsort(seed, kind="stable")
    done = np.cumsum(size[order])
    new = np.append(True, seed[order][1:] != seed[order][:-1])
    edges, a = np.flatnonzero(np.append(new, True)), 0
    while a < len(order):  # whole seeds of about STEP_BYTES
        most = (done[a - 1] if a else 0) + STEP_BYTES
        k = np.searchsorted(edges, np.searchsorted(done, most, "right"), "right") - 1
        b = int(edges[k]) if edges[k] > a else int(edges[np.searchsorted(edges, a, "right")])
        own = order[a:b]
        least = _ranked(flat, seed[own], start[own], positions[own], doc[own])
        low[places(at[own], at[own] + positions[own])[0]] = least
        a = b
    bounds = at[np.append(0, np.cumsum(sizes))]
    for k, r in enumerate(rows):
        yield answer(r, zstandard.ZstdCompressor(level=1).compress(low[bounds[k] : bounds[k + 1]].tobytes()))


def _ranked(flat: np.ndarray, seed: np.ndarray, start: np.ndarray, positions: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Least documents of the entries' positions, one entry after another."""
    size = positions + LENGTH - 1
    own, begin = gather(flat, start, start + size)
    content = strong_hashes(own, begin[:-1], begin[1:])
    order = np.lexsort((doc, content, size, seed))
    s, z, c = seed[order], size[order], content[order]
    new = np.append(True, (s[1:] != s[:-1]) | (z[1:] != z[:-1]) | (c[1:] != c[:-1]))
    one = order[new]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    if len(one) < len(order):
        own, begin = gather(own, begin[one], begin[one + 1])
    least = least_documents(own, begin[:-1], positions[one], doc[one])
    after = np.append(0, np.cumsum(positions[one]))
    return gather(least, after[which], after[which] + positions)[0]


def _removed(docs: pa.Table, answers: pa.Table) -> tuple[Runs, list[np.ndarray]]:
    """Of each document's bytes, whether they are removed, by piece."""
    step = answers.column("step").to_numpy()
    runs, ids = Runs.of(docs), _ids(docs)
    own = Entries.of_group(runs, answered(answers.filter(pa.array(step == 1))), ids)
    low = np.frombuffer(answered(answers.filter(pa.array(step == 2))), np.int64)
    positions = runs.length[own.run]
    begin = np.cumsum(positions) - positions
    marks = [np.zeros(len(raw) + 1, np.int32) for raw in runs.raw]
    for p in np.unique(runs.piece[own.remaining]):
        mine = np.flatnonzero(runs.piece[own.remaining] == p)
        run, entry = own.remaining[mine], own.of[mine]
        least, before = gather(low, begin[entry], begin[entry] + positions[entry])
        place = np.arange(len(least)) + np.repeat(runs.start[run] - before[:-1], runs.length[run])
        hit = place[least < np.repeat(ids[runs.document[run]], runs.length[run])]
        np.add.at(marks[p], hit, 1)
        np.add.at(marks[p], hit + LENGTH, -1)
    return runs, [np.cumsum(m[:-1]) > 0 for m in marks]


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_TEXT = "doc_id long, text string, n_removed long"


def _finish(full: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        runs, gone = _removed(docs, answers)
        out = []
        for raw, o, off in zip(runs.raw, runs.offsets, gone, strict=True):
            for a, b in zip(o.tolist(), o[1:].tolist(), strict=False):
                own = off[a:b]
                kept = raw[a:b][~own].tobytes()
                n = int(own.sum())
                if full:
                    out.append((kept.decode("utf-8", "ignore"), n))
                else:
                    out.append((b - a, n, int((own[1:] & ~own[:-1]).sum() + own[:1].sum()), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * (2 if full else 4)
        names = [x.split()[0] for x in (_TEXT if full else _DIGEST).split(", ")]
        return pa.table(dict(zip(names, [docs.column("doc_id"), *columns], strict=True)))

    return run


def _answers(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt, size = grouped(own, "text")
    buckets = buckets_for(own, size, RANGE_BYTES)
    seeds = ask(dealt.groupBy("g").applyInArrow(_seed_request(buckets), REQUEST), buckets, np.uint8, _shared)
    runs = dealt.groupBy("g").cogroup(seeds.groupBy("g")).applyInArrow(_run_request(buckets), REQUEST)
    ranked = runs.repartitionById(buckets, F.col("bucket")).mapInArrow(_rank, ANSWER)
    return dealt, seeds.withColumn("step", F.lit(1)).union(ranked.withColumn("step", F.lit(2)))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` without repeated bytes (characters that lose a byte go) and ``n_removed`` bytes, a row per row of ``docs``.

    Removed is every byte covered by a string of ``LENGTH`` bytes that also
    starts in a document with a smaller id, judged on the input. Matches never
    cross documents. A null text is empty; rows with a null id lose nothing and
    take nothing away; rows with the same id take nothing from each other.
    Other columns are not returned; join them by id.
    """
    dealt, answers = _answers(docs, doc_id, text)
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_finish(True), _TEXT)


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row per document of the contract."""
    dealt, answers = _answers(docs, doc_id, text)
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_finish(False), _DIGEST)
