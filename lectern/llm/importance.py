"""Importance resampling towards a target distribution: array-scored weights, then the k best by radix selection on key digits.

Words are lower-cased A-Z, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; features are
all runs of one and two consecutive words, joined by a space and counted as
often as they occur; a feature's bucket is its crc32 modulo ``BUCKETS``. The
log ratio of target and corpus counts is a bucket's gain, a document's weight
the floored mean over its features; with Gumbel noise from a hash of its id
added, the documents with the highest scores are a sample without replacement
in proportion to exp(weight / 1000).

Two passes over the texts (counts, then weights) are numpy over Arrow batches;
what tasks send are ``BUCKETS`` sums. The selection works on a written table of
scores: the histogram of one 16-bit digit of the composite key (score
descending, id ascending) at a time, at most 65536 rows, finds the digits of the
k-th key. Only rows up to that key are sorted by ranges and ranked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytesops import ALNUM_KEEP, Words, pieces
from lectern.llm.common import frugal, shuffles, small_batches, stored

BUCKETS = 10_000
#: Words of more bytes than this go through zlib one by one.
LONG = 64
#: Bits of a digit of the key.
DIGIT = 16


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, carried on from the crc32 ``before`` it."""
    c, length, taken = ~before, end - start, 0
    at = np.flatnonzero(length <= LONG)
    while len(at):
        at = at[length[at] > taken]
        c[at] = _CRC[(c[at] ^ data[start[at] + taken]) & 255] ^ (c[at] >> np.uint32(8))
        taken += 1
    out = ~c
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes(), int(before[k]))
    return out


def feature_buckets(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, of all pairs of neighbours (the first word's index kept) and those indices."""
    one = crcs(words.data, words.starts, words.ends, np.zeros(len(words.starts), np.uint32))
    document = words.document()
    pair = np.flatnonzero(document[:-1] == document[1:])
    joined = ~one[pair]
    spaced = ~(_CRC[(joined ^ 0x20) & 255] ^ (joined >> np.uint32(8)))
    two = crcs(words.data, words.starts[pair + 1], words.ends[pair + 1], spaced)
    return (one % np.uint32(buckets)).astype(np.int64), (two % np.uint32(buckets)).astype(np.int64), pair


def bucket_counts(docs: DataFrame, *, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch):
                one, two, _ = feature_buckets(Words(part.column(0), ALNUM_KEEP), buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    sums = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the corpus) of each bucket."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log(((target + 1.0) * (all_corpus + n)) / ((corpus + 1.0) * (all_target + n)))).astype(np.int64)


def noise(doc_id: str, seed: int = 7) -> Column:
    """floor(1000 * Gumbel noise) from the first 32 bits of a SHA-256 of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """Per row ``doc_id``, ``row`` (a hash of the text), ``n_words``, ``n_features``, ``weight`` and ``score``.

    Null texts are empty; rows without features weigh 0; the score of a null id
    is null. ``target`` needs a column named as ``text`` is. An empty corpus or target is one without
    counts. Repeated rows each count.
    """
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, text=text, buckets=buckets), bucket_counts(target, text=text, buckets=buckets))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column(2), ALNUM_KEEP)
                one, two, pair = feature_buckets(words, buckets)
                worth = gain[one]
                worth[pair] += gain[two]
                sums = np.append(0, np.cumsum(worth))
                n = words.counts
                features = n + np.maximum(n - 1, 0)
                total = sums[words.first[1:]] - sums[words.first[:-1]]
                weight = total // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (n, features, weight)]], ["doc_id", "row", "n_words", "n_features", "weight"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    out = own.mapInArrow(run, "doc_id long, row long, n_words long, n_features long, weight long")
    return stored(out.withColumn("score", F.col("weight") + noise("doc_id", seed)), "scored")


#: Digits of a long; the composite key is two longs, digits from the highest.
_LOW = 64 // DIGIT


def _digit(k: int) -> Column:
    """Digit ``k`` of a row's key: ~score, then id, both with the sign bit turned so that bits order as numbers."""
    word = F.bitwise_not(F.col("score")) if k < _LOW else F.col("doc_id")
    return F.shiftrightunsigned(word.bitwiseXOR(F.lit(-(1 << 63))), 64 - DIGIT * (k % _LOW + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def _best(rows: DataFrame, k: int) -> Column | None:
    """A test that the ``k`` rows of least keys pass, and of others only those whose key equals the last one's. None for no rows."""
    if k <= 0:
        return None
    same, passed, need = F.lit(True), F.lit(False), k
    for d in range(2 * _LOW):
        digit = _digit(d)
        counts = sorted((r["digit"], r["n"]) for r in rows.where(same).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
        for value, n in counts:
            if n >= need:
                break
            need -= n
        passed = passed | (same & (digit < value))
        same = same & (digit == value)
        if n == need:
            break
    return passed | same


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (with ``score``, ``doc_id`` and ``row``) with ``rank``, from 1 for the ``k`` highest scores, ties to the smaller id; null for others and for null scores.

    Rows with one score and id are ordered by the hash of the text; equal rows
    are told apart by chance, so that exactly ``k`` get a rank.
    """
    rows = rows.withColumn("rank", F.lit(None).cast("long"))
    test = _best(rows.where("fit"), k)
    if test is None:
        return rows
    drawn = F.coalesce(F.col("fit") & test, F.lit(False))
    spark = rows.sparkSession
    part = rows.where(drawn).repartitionByRange(shuffles(spark), F.desc("score"), "doc_id", "row").sortWithinPartitions(F.desc("score"), "doc_id", "row")
    part = stored(part.withColumn("at", F.monotonically_increasing_id()), "drawn").withColumn("part", F.shiftright("at", 33))
    before, starts = 0, []
    for r in sorted(part.groupBy("part").count().collect()):
        starts.append((r["part"], before))
        before += r["count"]
    part = part.join(F.broadcast(spark.createDataFrame(starts, "part long, before long")), "part")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    part = part.withColumn("rank", F.when(place <= k, place))
    return part.select(*rows.columns).unionByName(rows.where(~drawn))


def draw(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``docs`` ``doc_id``, ``row``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the N rows with an id and at least ``least_words`` words,
    floor(percent * N / 100) are drawn; ``rank`` is null for all others.
    """
    rows = scored(docs, target, doc_id=doc_id, text=text, seed=seed, buckets=buckets)
    rows = rows.withColumn("fit", F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words))
    return ranked(rows, percent * rows.where("fit").count() // 100).drop("fit")


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, whole, with ``rank`` (a column of that name is replaced). Equal rows share the least rank of theirs and stay as often as drawn."""
    ranks = draw(docs, target, doc_id=doc_id, text=text, **options).where("rank is not null")
    ranks = ranks.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.min("rank").alias("__rank"), F.count("*").alias("__times"))
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__own"), F.col(doc_id).cast("long").alias("__id"), F.xxhash64(text).alias("__row"))
    once = own.groupBy("__id", "__row").agg(F.first("__own").alias("__own")) if docs.count() > docs.select(doc_id).distinct().count() else own
    kept = once.join(ranks, ["__id", "__row"]).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return kept.select(*[F.col("__own")[c].alias(c) for c in docs.columns if c != "rank"], F.col("__rank").alias("rank"))


def digests(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document."""
    return draw(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
