"""Token ids on disk: documents compressed one by one with a shared zstandard dictionary, in pages with an offset index.

Layout of a written folder, all Parquet, so that Spark's commit protocol
covers it on any file system:

``dictionary``  one row: ``sha256`` of the dictionary and its bytes (empty where there was too little to train on)
``pages``       rows in ascending document order: ``part``, ``page``, ``dictionary_sha256``, ``width`` (bytes of a stored id),
                ``doc_ids``, ``counts`` (ids of each), ``offsets`` (n+1, into ``payload``), ``payload`` (one frame a document)
``parts``       ``part``, ``base``: ids of all documents in earlier parts
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bytesops import pieces
from lectern.llm.common import drawn, frugal, shuffles
from lectern.llm.pretokens import Pretokens

#: The dictionary is trained on at most this many documents' first characters; it affects size only.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 4000, 1 << 16
LEVEL = 1
#: A page is closed at this many bytes of payload.
PAGE_BYTES = 1 << 20
#: Bytes of a Parquet row group, the least that is read to find a document.
GROUP_BYTES = 8 << 20
#: Up to this many documents are looked for by id in the files' statistics, more by least and greatest id.
LOOKED_UP = 64
STEP = 1 << 19


@cache
def _pretokens(path: str) -> Pretokens:
    return Pretokens(path)


def _dtype(path: str) -> np.dtype:
    return np.dtype("<u2" if len(_pretokens(path).names) <= 1 << 16 else "<u4")


def _train(docs: DataFrame, path: str, end_id: int, doc_id: str, text: str) -> bytes:
    rows = drawn(docs.select(doc_id, F.substring(text, 1, SAMPLE_CHARS).alias("t")), doc_id, SAMPLE_DOCS).collect()
    ids, o = _pretokens(path).encode([r.t for r in rows])
    kind = _dtype(path)
    samples = [np.append(ids[a:b], end_id).astype(kind).tobytes() for a, b in zip(o, o[1:], strict=False)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short
        return b""


def _frames(path: str, end_id: int, dictionary, cuts, text: str):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = dictionary.value
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        kind, edges = _dtype(path), np.asarray(cuts.value, np.int64)
        for whole in batches:
            for batch in pieces(whole, text, STEP):
                ids, o = _pretokens(path).encode(batch.column("text").to_pylist())
                made = [pack.compress(np.append(ids[a:b], end_id).astype(kind).tobytes()) for a, b in zip(o, o[1:], strict=False)]
                doc = batch.column("doc_id")
                part = np.where(doc.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(edges, doc.fill_null(0).to_numpy(), "left"))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc, pa.array(np.diff(o) + 1, pa.int64()), pa.array(made, pa.binary())], ["part", "doc_id", "n", "frame"])

    return run


_PAGE = "part int, page int, first_id long, last_id long, dictionary_sha256 string, width int, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"


def _pages(sha: str, width: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, size, part = 0, [], 0, None

        def closed() -> pa.RecordBatch:
            ids, counts, frames = zip(*held, strict=True)
            known = [k for k in ids if k is not None]
            row = [part, page, min(known, default=None), max(known, default=None), sha, width, list(ids), list(counts), [0, *np.cumsum([len(x) for x in frames]).tolist()], b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _PAGE.split(", ")])

        for batch in batches:
            for p, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (size >= PAGE_BYTES or p != part):
                    yield closed()
                    page, held, size = page + 1, [], 0
                part = p
                held.append(row)
                size += len(row[2])
        if held:
            yield closed()

    return run


def write_token_ids(docs: DataFrame, folder: str, path: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id`` and write ids in ascending ``doc_id`` order.

    Null and empty texts have the end id only; a null id comes first; rows with
    the same id are kept one by one, in an order that their ids decide.
    Other columns are not written. An empty table makes an empty file set.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    parts = shuffles(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cuts = own.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    dictionary = _train(own, path, end_id, "doc_id", "text")
    sha, width = hashlib.sha256(dictionary).hexdigest(), _dtype(path).itemsize
    spark.createDataFrame([(sha, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    frames = own.mapInArrow(_frames(path, end_id, sc.broadcast(dictionary), sc.broadcast(cuts), "text"), "part int, doc_id long, n long, frame binary")
    dealt = frames.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "n", "frame")
    dealt.mapInArrow(_pages(sha, width), _PAGE).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/pages")
    totals = spark.read.parquet(f"{folder}/pages").groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    before, rows = 0, []
    for part, n in sorted(totals.collect()):  # one row a partition
        rows.append((part, before))
        before += n
    spark.createDataFrame(rows, "part int, base long").coalesce(1).write.parquet(f"{folder}/parts")


def _unpack(dictionary, sha: str, wanted: frozenset[int] | None):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = dictionary.value
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError(f"page {row['part']}/{row['page']} was written with another dictionary")
                payload, o, kind = row["payload"], row["offsets"], np.dtype(f"<u{row['width']}")
                at = row["start"] + np.append(0, np.cumsum(row["counts"])[:-1])
                some = [k for k, d in enumerate(row["doc_ids"]) if wanted is None or d in wanted]
                ids = [np.frombuffer(unpack.decompress(payload[o[k] : o[k + 1]]), kind).astype("<u4").tobytes() for k in some]
                of = lambda values, some=some: pa.array([values[k] for k in some], pa.int64())
                yield pa.RecordBatch.from_arrays([of(row["doc_ids"]), of(at.tolist()), of(row["counts"]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_token_ids(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written documents: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit).

    With ``doc_ids``, only these: row groups without them are skipped by their
    statistics, and of a page only their frames are cut out and unpacked.
    """
    sha, data = spark.read.parquet(f"{folder}/dictionary").first()
    pages = spark.read.schema(_PAGE).parquet(f"{folder}/pages").withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pages.select("part", "page", before.alias("before"))
    base = F.broadcast(spark.read.schema("part int, base long").parquet(f"{folder}/parts"))  # a row a partition of the writer
    starts = starts.join(base, "part").select("part", "page", (F.col("base") + F.col("before")).alias("start"))
    pages = pages.drop("n")
    if doc_ids is not None:
        some = sorted(set(doc_ids))
        spans = [(k, k) for k in some] if len(some) <= LOOKED_UP else [(some[0], some[-1])]
        inside = F.lit(False)
        for low, high in spans:
            inside = inside | ((F.col("first_id") <= high) & (F.col("last_id") >= low))
        pages = pages.where(inside)
    wanted = None if doc_ids is None else frozenset(doc_ids)
    return pages.join(starts, ["part", "page"]).mapInArrow(_unpack(spark.sparkContext.broadcast(bytes(data)), sha, wanted), "doc_id long, start long, n_tokens long, ids binary")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """The row per document of the contract."""
    return read_token_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
