"""Benchmark decontamination: word windows of documents against a broadcast set of test windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytesops import ALNUM_KEEP, Words, pieces, window_hashes
from lectern.llm.common import frugal, stored

#: Words in a window; an item of fewer words, but not none, is one window.
WINDOW = 13
#: A document is contaminated from this share of hit words: 1 of 20.
SHARE = 20
#: Bytes of item text in one broadcast set; more items are taken in blocks of this size.
BLOCK_BYTES = 16 << 20

_ADDED = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_bits", pa.binary()), ("hit_items", pa.list_(pa.string()))])


class TestWindows:
    """The hash set of one block of items: by window length, ascending hashes with each window's item and place in one text."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        self.names, texts, size = [item for item, _ in items], [], 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            w = Words(pa.array([text]), ALNUM_KEEP)
            if length := min(n, len(w.starts)):
                texts.append(_joined(w, 0, len(w.starts)))
                end = size + np.cumsum(w.ends - w.starts + 1) - 1
                start = end - (w.ends - w.starts)
                size += len(texts[-1])
                hashes = window_hashes(w.hashes, length)
                found[length].append((hashes, np.full(len(hashes), k, np.int32), start[: len(hashes)], end[length - 1 :]))
        self.text = b"".join(texts)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for length, parts in found.items():
            hashes, item, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            bits = max(10, int(16 * len(hashes)).bit_length())  # a slot in 16 or fewer is taken
            slots = np.zeros(1 << bits, bool)
            slots[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_length[length] = hashes[order], item[order], start[order], end[order], slots

    def scan(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items found by document."""
        diff, items = np.zeros(len(w.starts) + 1, np.int64), defaultdict(set)
        document = w.document()
        for length, (hashes, item, start, end, slots) in self.by_length.items():
            h = window_hashes(w.hashes, length)
            bits = len(slots).bit_length() - 1
            likely = np.flatnonzero(slots[(h >> np.uint64(64 - bits)).astype(np.int64)])
            likely = likely[document[likely] == document[likely + length - 1]]
            a, b = np.searchsorted(hashes, h[likely], "left"), np.searchsorted(hashes, h[likely], "right")
            for k, first, last in zip(likely[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                own = _joined(w, k, length)
                owners = [self.names[item[x]] for x in range(first, last) if self.text[start[x] : end[x]] == own]
                if owners:
                    diff[k] += 1
                    diff[k + length] -= 1
                    items[int(document[k])].update(owners)
        return np.cumsum(diff[:-1]) > 0, items


def _joined(w: Words, k: int, length: int) -> bytes:
    return b" ".join(w.data[a:b].tobytes() for a, b in zip(w.starts[k : k + length], w.ends[k : k + length], strict=True))


def _scanner(windows, text: str):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: TestWindows = windows.value
        for whole in batches:
            for batch in pieces(whole, text):
                w = Words(batch.column(batch.schema.get_field_index(text)), ALNUM_KEEP)
                hit, items = known.scan(w)
                old_bits, old_items = batch.column("hit_bits"), batch.column("hit_items")
                bits, lists, counts = [], [], []
                for d in range(batch.num_rows):
                    own = hit[w.first[d] : w.first[d + 1]]
                    if old_bits[d].as_py():
                        own = own | np.unpackbits(np.frombuffer(old_bits[d].as_py(), np.uint8), count=len(own)).astype(bool)
                    counts.append(int(own.sum()))
                    bits.append(np.packbits(own).tobytes() if own.any() else b"")
                    lists.append(sorted({*(old_items[d].as_py() or ()), *items.get(d, ())}))
                added = [pa.array(w.counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(bits, pa.binary()), pa.array(lists, pa.list_(pa.string()))]
                kept = [k for k, name in enumerate(batch.schema.names) if name not in _ADDED.names]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + added, [batch.schema.names[k] for k in kept] + _ADDED.names)

    return run


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded bytes; an item longer than that is a block of its own."""
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string"), text)
    block, size = [], 0
    for item, content in rows.toLocalIterator():
        if block and size + len(content) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, content))
        size += len(content)
    yield block


def scan(docs: DataFrame, items: DataFrame, *, n: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit``, ``hit_bits`` (a bit a word, empty if none is hit) and ``hit_items``.

    The items are read as bounded blocks, each broadcast as one hash set; a
    hash hit is verified on the words themselves. With more than one block the
    rows pass once for each, and hits are united.

    Null or word-less texts have no words and no hits; null item ids and texts
    are left out; without items nothing is hit; repeated rows each keep their
    row; other columns pass through (columns named as the four added ones are
    replaced).
    """
    sc = docs.sparkSession.sparkContext
    out = docs.drop(*_ADDED.names).withColumns({k: F.lit(None).cast(t) for k, t in (("n_words", "long"), ("n_hit", "long"), ("hit_bits", "binary"), ("hit_items", "array<string>"))})
    schema = out.schema
    for k, block in enumerate(_blocks(items, item_id, item_text)):
        if k:
            out = stored(out, "decontamination")
        out = out.mapInArrow(_scanner(sc.broadcast(TestWindows(block, n)), text), schema)
    return out


def decide(scanned: DataFrame, share: int = SHARE) -> DataFrame:
    """Adds ``contaminated`` to what ``scan`` returns."""
    return scanned.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _cut(text: str):
    """Removes the bytes from the first to the last word of each run of hit words."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            w = Words(batch.column(at), ALNUM_KEEP)
            texts = batch.column(at).to_pylist()
            for d, bits in enumerate(batch.column("hit_bits").to_pylist()):
                if bits:
                    a, b = w.first[d], w.first[d + 1]
                    hit = np.concatenate([[False], np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool), [False]])
                    raw, base, kept, done = texts[d].encode(), w.offsets[d], [], 0
                    for x, y in zip(np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:]), strict=True):
                        kept.append(raw[done : w.starts[a + x] - base])
                        done = int(w.ends[a + y - 1] - base)
                    texts[d] = b"".join([*kept, raw[done:]]).decode()
            yield batch.set_column(at, text, pa.array(texts, batch.schema.field(at).type))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, *, remove: str = "documents", n: int = WINDOW, share: int = SHARE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words of every document cut out.

    Same columns as ``docs``. See ``scan`` for nulls and empty inputs: such
    documents stay.
    """
    seen = scan(docs, items, n=n, text=text, item_id=item_id, item_text=item_text)
    if remove == "spans":
        return seen.mapInArrow(_cut(text), seen.schema).select(*docs.columns)
    return decide(seen, share).where(~F.col("contaminated")).select(*docs.columns)


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest row per document of the contract."""
    return decide(scan(docs.select("doc_id", "text"), items)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
