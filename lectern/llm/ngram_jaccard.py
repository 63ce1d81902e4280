"""Near-copies by Jaccard similarity of word shingles: parity sketches, pigeonhole join by size band, exact check.

A document's sketch for a size band is a vector of words; each shingle XORs
its hash into one of them, so the number of differing words is at most the
symmetric difference. Documents at or above the similarity differ in at most
(size a + size b) / 9 shingles (at 0.8), so with more words than that they
share one, and sharing a word of the sketch makes a candidate. Words that hold
more shingles are rarer in the corpus; both sides send only the fullest ones,
one more than may differ, which must still meet (prefix filtering).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytesops import PLAIN_KEEP, U, Words, mix, pieces, window_hashes
from lectern.llm.common import BROADCAST_IDS, frugal, keep_ids, shuffles, stored
from lectern.llm.components import connected_components

#: Words in a shingle, and the similarity from which documents link, in hundredths.
SHINGLE, PERCENT = 5, 80
#: Ratio of neighbouring size bands, and sketch words to differing ones.
BAND, SPARE = 1.5, 1.3
#: A sketch word shared by more texts than this is joined by stars and reviewed, by fewer as pairs.
FEW = 8
#: Texts of a reviewed key that one task holds the others against.
SLICE = 4096
#: A map task deals its sketch words out when it has this many.
HELD = 1 << 20
#: 64-bit words of the compact sketch that pre-checks reviewed pairs.
COMPACT = 8


def _bands() -> list[int]:
    """Smallest size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


BANDS = np.array(_bands())


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct shingles."""
    w = Words(column, PLAIN_KEEP)
    runs = window_hashes(w.hashes, SHINGLE)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = b - a
        own = runs[a : b - SHINGLE + 1] if n >= SHINGLE else window_hashes(w.hashes[a:b], n) if n else runs[:0]
        out.append(np.unique(own))
    return out


def most_different(a: int, b: int) -> int:
    """The largest symmetric difference of sets of these sizes that still link: d <= (100 - p) U / 100 and U = (a + b + d) / 2."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def sketch_keys(s: np.ndarray) -> list[np.ndarray]:
    """The hashed sketch words that a set sends, for its own band and, if a smaller partner may lie there, the one below."""
    n = len(s)
    band = int(np.searchsorted(BANDS, n, "right")) - 1
    out = []
    for g in (band, band - 1):
        if g < 0:
            continue
        top = int(BANDS[g + 1]) - 1  # the largest size of the smaller partner
        if g != band and n * PERCENT > 100 * top:
            continue
        width = int(SPARE * most_different(top, 100 * top // PERCENT)) + 2
        sent = most_different(n, 100 * n // PERCENT) if g == band else most_different(top, n)
        at = ((s >> U(32)) * U(width)) >> U(32)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        load = np.diff(np.append(first, n))
        word = np.bitwise_xor.reduceat(mix(s), first)
        key = mix(word ^ mix(at[first] + U(width << 20) + (load.astype(U) << U(48))))
        if len(key) <= sent:  # so sparse that only empty words may be common
            empty = np.setdiff1d(np.arange(width, dtype=U), at[first])
            key = np.append(key, mix(mix(empty + U(width << 20))))
        elif len(key) > sent + 1:
            key = key[np.lexsort((key, -load))[: sent + 1]]
        out.append(key)
    return out


def _digest(s: np.ndarray) -> int:
    return int(mix(np.bitwise_xor.reduce(mix(s), keepdims=True) ^ (s.sum(dtype=U, keepdims=True) * U(31)) ^ U(len(s))).astype(np.int64)[0])


def _compact(s: np.ndarray) -> np.ndarray:
    """COMPACT 64-bit words of parity bits: their Hamming distance, too, is at most the symmetric difference."""
    bit = np.bincount((mix(s + U(1)) >> U(64 - 9)).astype(np.int64), minlength=64 * COMPACT)
    return np.packbits((bit & 1).astype(np.uint8)).view("<i8")


_PACKED = "bucket int, kind int, x binary, y binary"
_FIELDS = ["bucket", "kind", "x", "y"]
_KEYS, _EDGES, _MEMBERS, _DOCS = range(4)


def _row(bucket: int, kind: int, x: bytes, y: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([x], pa.binary()), pa.array([y], pa.binary())], _FIELDS)


def _runs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, doc) in order, with the bounds of each key's run."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key, doc, first, np.append(first[1:], len(key))


def _stars(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links of every run's members to its first, distinct."""
    n = b - a
    hub = np.repeat(doc[a], n)
    at = np.arange(n.sum()) + np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n)
    pairs = np.stack([hub, doc[at]], 1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _sender(buckets: int, doc_id: str, text: str):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, rows, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, owners, rows, held
            table = np.array(rows, np.int64).reshape(-1, 3 + COMPACT)
            deal = int(mix(np.array([table[:, 1].astype(U).sum()], U))[0] % U(buckets))
            yield _row(deal, _DOCS, table.tobytes(), b"")
            if keys:
                key, doc, a, b = _runs(np.concatenate(keys), np.repeat(table[:, 1][np.array([x for x, _ in owners])], [n for _, n in owners]))
                many = b - a > FEW
                if many.any():  # one row a key goes on; the members are kept for review
                    yield _row(deal, _EDGES, _stars(doc, a[many], b[many]).tobytes(), b"")
                    inside = np.repeat(many, b - a)
                    yield _row(deal, _MEMBERS, np.stack([key[inside].astype(np.int64), doc[inside]], 1).tobytes(), b"")
                    stay = ~inside
                    stay[a[many]] = True
                    reduced = np.zeros(len(key), bool)
                    reduced[a[many]] = True
                    key, doc, reduced = key[stay], doc[stay], reduced[stay]
                else:
                    reduced = np.zeros(len(key), bool)
                bounds = np.searchsorted(key, np.array([(k << 64) // buckets for k in range(1, buckets)], U)) if buckets > 1 else []
                x = np.append(0, bounds).astype(int)
                for k, (p, q) in enumerate(zip(x, np.append(x[1:], len(key)), strict=True)):
                    if q > p:
                        yield _row(k, _KEYS, key[p:q].tobytes() + doc[p:q].tobytes(), np.packbits(reduced[p:q]).tobytes() if reduced[p:q].any() else b"")
            keys, owners, rows, held = [], [], [], 0

        for whole in batches:
            for batch in pieces(whole, text):
                for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                    if not len(s) or doc is None:
                        rows.append([doc or 0, 0, -1 - len(s) if doc is None else 0, *[0] * COMPACT])
                        continue
                    for key in sketch_keys(s):
                        keys.append(key)
                        owners.append((len(rows), len(key)))
                        held += len(key)
                    rows.append([doc, _digest(s), len(s), *_compact(s).tolist()])
                if held >= HELD or len(rows) >= 1 << 16:
                    yield from flush()
        if rows:
            yield from flush()

    return run


_FOUND = f"kind int, a long, b long, n long, {', '.join(f's{k} long' for k in range(COMPACT))}"


def _found(kind: int, table: np.ndarray) -> pa.RecordBatch:
    """Rows a, b, n and the compact sketch; missing columns are null."""
    names = [x.split()[0] for x in _FOUND.split(", ")]
    columns = [pa.array(np.ascontiguousarray(table[:, k])) if k < table.shape[1] else pa.nulls(len(table), pa.int64()) for k in range(len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(table), kind, np.int32)), *columns], names)


@frugal
def _receiver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket of sketch words: links among the texts that share one."""
    keys, docs, marks = [], [], []
    for batch in batches:
        for kind, x, y in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            raw = np.frombuffer(x, np.int64)
            if kind == _KEYS:
                n = len(raw) // 2
                keys.append(raw[:n].view(U))
                docs.append(raw[n:])
                marks.append(np.unpackbits(np.frombuffer(y, np.uint8), count=n).astype(bool) if y else np.zeros(n, bool))
            else:
                yield _found(kind, raw.reshape(-1, 2 if kind != _DOCS else 3 + COMPACT))
    if not keys:
        return
    key, doc, mark = np.concatenate(keys), np.concatenate(docs), np.concatenate(marks)
    reduced = np.unique(key[mark])
    key, doc, a, b = _runs(key, doc)
    many = (b - a > FEW) | np.isin(key[a], reduced)
    few = (b - a > 1) & ~many
    edges = [_stars(doc, a[many], b[many])] if many.any() else []
    for size in range(2, FEW + 1):
        start = a[few & (b - a == size)]
        for p in range(size):
            edges += [np.stack([doc[start + p], doc[start + q]], 1) for q in range(p + 1, size)]
    if edges:
        yield _found(_EDGES, np.unique(np.concatenate(edges), axis=0))
    if many.any():
        inside = np.repeat(many, b - a)
        yield _found(_MEMBERS, np.stack([key[inside].astype(np.int64), doc[inside]], 1))


@frugal
def _set_maker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            sets = shingle_sets(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) if len(s) else 0 for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["digest", "shingles"])


def _near(x: str, y: str):
    """Whether sizes and compact sketches leave a pair possible."""
    distance = sum((F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(COMPACT)), F.lit(0))
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) & ((100 + PERCENT) * distance <= (100 - PERCENT) * (a + b))


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of digests, those at or above the similarity, as documents."""
    needed = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct().join(texts.select("digest", "rep"), "digest")
    sets = keep_ids(docs, needed.select(F.col("rep").alias("doc_id")), "doc_id").select("text").mapInArrow(_set_maker, "digest long, shingles array<long>").dropDuplicates(["digest"])
    side = lambda k: sets.select(F.col("digest").alias(k), F.col("shingles").alias(f"shingles_{k}"))
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - both
    linked = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= PERCENT * union).select("a", "b")
    rep = lambda k: texts.select(F.col("digest").alias(k), F.col("rep").alias(f"rep_{k}"))
    return linked.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def _across(members: DataFrame, texts: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that share a key whose texts lie in different components, and may link across them.

    Under such a key the texts outside its largest component are held against
    those of all its other components. Texts share many keys; a pair is made
    under the first only. A key's texts are dealt over tasks by ``SLICE``.
    """
    placed = members.join(texts.select("digest", "rep"), "digest").join(component.withColumnRenamed("node", "rep"), "rep", "left").select("key", "digest", F.coalesce("component", "rep").alias("component"))
    placed = stored(placed, "members")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("total"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mixed = stored(mixed, "mixed")
    few_keys = mixed.count() <= BROADCAST_IDS // 4
    held = placed.join(F.broadcast(mixed) if few_keys else mixed, "key").groupBy("digest", "component").agg(F.array_sort(F.collect_list(F.struct("key", "most", "total"))).alias("own"))
    held = held.join(texts.drop("rep"), "digest").select("*", F.posexplode("own").alias("at", "k"))
    slices = F.ceil(F.col("k.total") / SLICE).cast("int")
    rows = held.select("digest", "component", "n", *[f"s{k}" for k in range(COMPACT)], "k.key", "k.most", F.transform(F.slice("own", F.lit(1), F.col("at")), lambda x: x["key"]).alias("before"), slices.alias("slices"))
    x = rows.where("component <> most").select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).alias("x")
    y = rows.withColumn("slice", F.pmod("digest", F.col("slices")).cast("int")).alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.most")) | (F.col("x.digest") < F.col("y.digest")))
    once = ~F.arrays_overlap("x.before", "y.before")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.slice") == F.col("y.slice")) & apart & _near("x", "y") & once)
    return met.select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b"))


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Equal sets are one text. Texts that share a sketch word are compared: as
    pairs where few share it, else with the first of them; a word whose texts
    then still lie in different components is reviewed pair by pair across
    these, so no link is lost. Texts are known by 64-bit digests of their sets,
    shingles by 64-bit hashes of strongly hashed words. A null or word-less text has an empty set and
    its own id; a row with a null id takes no part and has a null component;
    repeated rows each get their row. Other columns are not returned.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    buckets = 2 * shuffles(docs.sparkSession)
    found = stored(own.mapInArrow(_sender(buckets, "doc_id", "text"), _PACKED).repartitionById(buckets, F.col("bucket")).mapInArrow(_receiver, _FOUND), "sketches")
    signed = found.where(F.col("kind") == _DOCS).select(F.when(F.col("n") >= 0, F.col("a")).alias("doc_id"), F.col("b").alias("digest"), F.when(F.col("n") >= 0, F.col("n")).otherwise(-1 - F.col("n")).alias("n"), *[f"s{k}" for k in range(COMPACT)])
    texts = signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *[F.first(f"s{k}").alias(f"s{k}") for k in range(COMPACT)])
    texts = stored(texts, "texts")
    numbered = own.where("doc_id is not null")
    edges = found.where(F.col("kind") == _EDGES).select("a", "b").distinct()
    pairs = stored(edges.join(texts.alias("x"), F.col("a") == F.col("x.digest")).join(texts.alias("y"), F.col("b") == F.col("y.digest")).where(_near("x", "y")).select("a", "b"), "pairs")
    links = stored(_verified(pairs, texts, numbered), "links")
    component = connected_components(links)
    members = found.where(F.col("kind") == _MEMBERS).select(F.col("a").alias("key"), F.col("b").alias("digest")).distinct()
    more = stored(_across(members, texts, component), "pairs")
    if more.limit(1).count():
        added = stored(_verified(more, texts, numbered), "links")
        component = connected_components(links.union(added))
    out = signed.join(texts.select("digest", "rep"), "digest", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id; of rows repeated with id and text, one.

    Rows with a null id, and texts without words, are linked with nothing and
    all stay.
    """
    seen = stored(classes(docs), "classes").where("doc_id is not null and n_shingles > 0")
    out = keep_ids(docs, seen.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    twice = seen.groupBy("doc_id").count().where("count > 1")
    if not twice.limit(1).count():
        return out
    return keep_ids(out, twice, "doc_id", "left_anti").unionByName(keep_ids(out, twice, "doc_id").dropDuplicates(["doc_id", "text"]))
