"""Counting and looking up 64-bit keys across a corpus, many keys a row.

Groups of documents send each different key once, packed by ranges of keys
("buckets"); a bucket adds up what all groups sent and answers each group in
the order it asked. So a key that every document holds costs one entry a
group, and no table of keys is ever in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytesops import U
from lectern.llm.common import shuffles

#: Bytes of text in a group of documents.
GROUP_BYTES = 12 << 20


def packed(keys: np.ndarray) -> bytes:
    """Ascending distinct keys, as 6-byte differences where these suffice."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=U(0))
    if len(keys) > 1 and steps[1:].max() < 1 << 48:
        return b"\x06" + keys[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\x08" + keys.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    if blob[0] == 8:
        return np.frombuffer(blob, U, offset=1)
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, 6)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[1:, :6] = raw
    steps = steps.reshape(-1).view(U)
    steps[0] = np.frombuffer(blob, U, 1, 1)[0]
    return np.cumsum(steps, dtype=U)


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unsqueezed(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds in ascending ``keys`` of each bucket's range."""
    edges = np.arange(1, buckets, dtype=U) * U((1 << 64) // buckets)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


REQUEST = "bucket int, g long, keys binary, said binary"
ANSWER = "g long, bucket int, answer binary"


def request(g: int, keys: np.ndarray, said: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket that holds any of the ascending ``keys``. ``said`` goes along, one value a key."""
    return rows_by_range(g, keys, buckets, lambda a, b: squeezed(said[a:b]))


def rows_by_range(g: int, keys: np.ndarray, buckets: int, said) -> pa.Table:
    """Rows of a request; ``said(a, b)`` is what goes along with the keys a to b."""
    x = ranges(keys, buckets)
    used = np.flatnonzero(x[1:] > x[:-1])
    spans = [*zip(x[used].tolist(), x[used + 1].tolist(), strict=True)]
    return pa.table({"bucket": pa.array(used, pa.int32()), "g": pa.array([g] * len(used), pa.int64()), "keys": pa.array([packed(keys[a:b]) for a, b in spans], pa.binary()), "said": pa.array([said(a, b) for a, b in spans], pa.binary())})


def answered(rows: pa.Table) -> bytes:
    """The answers that a group got, in the order of its keys, one after another (still as bytes)."""
    order = np.argsort(rows.column("bucket").to_numpy())
    blobs = rows.column("answer").to_pylist()
    return b"".join(zstandard.ZstdDecompressor().decompress(blobs[k]) for k in order)


def answer(request_row: dict, said: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([request_row["g"]], pa.int64()), pa.array([request_row["bucket"]], pa.int32()), pa.array([said], pa.binary())], ["g", "bucket", "answer"])


def ask(requests: DataFrame, buckets: int, kind: str, combine) -> DataFrame:
    """Deal requests to their buckets and answer.

    ``combine(keys, said, sender)`` gets the entries of all groups, where
    ``sender`` numbers them, and returns an answer for each entry.
    """

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        rows.sort(key=lambda r: r["g"])
        keys = [unpacked(r["keys"]) for r in rows]
        counts = [len(k) for k in keys]
        said = np.concatenate([unsqueezed(r["said"], kind) for r in rows])
        answers = combine(np.concatenate(keys), said, np.repeat(np.arange(len(rows)), counts))
        at = np.append(0, np.cumsum(counts))
        for k, r in enumerate(rows):
            yield answer(r, squeezed(answers[at[k] : at[k + 1]]))

    return requests.repartitionById(buckets, F.col("bucket")).mapInArrow(run, ANSWER)


def buckets_for(docs: DataFrame, size: int, range_bytes: int) -> int:
    """Ranges of keys for ``size`` bytes of text: as many as the bytes need, at least one a shuffle partition."""
    return max(shuffles(docs.sparkSession), -(-size // range_bytes))


def grouped(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``docs`` dealt into groups ``g`` of about ``GROUP_BYTES`` of text, and the bytes of text.

    One exchange serves every pass of a query that groups the result by ``g``.
    """
    n = shuffles(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(n, -(-size // GROUP_BYTES))
    return docs.withColumn("g", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text), F.lit(groups))).repartition(n, "g"), size
