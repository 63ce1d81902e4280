"""Hard negatives by product quantisation with stored residual norms.

Vectors are scaled and floored to integers, and scores are integer inner
products. A row is kept as one centroid a subspace (``codes``) and the length of
what these leave over (``residual``). For an anchor a, the sum of its lookup
tables at the codes is off the score by at most |a| * residual (the
Cauchy-Schwarz inequality), so score windows are searched by bounds that no row
can escape, and only rows whose bounds reach a window are scored exactly.

An anchor's positives are its first rows of the same label; each opens a window
of scores in which the first rows of other labels are its hard negatives.
Higher scores come first, then smaller ids.

Rows are coded once and written. Anchors, the stated query set, are sent in
blocks of a bounded size, for each of which the codes are read twice (positives,
then negatives); no pair of rows is ever shuffled, only each task's best few.
A task drops what cannot beat the best few of a bounded sample of rows, known
beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import drawn, frugal, keep_ids, scratch, stored

#: Dimensions of a subspace, centroids of each, rows that they are fitted on, rounds of fitting.
SUBSPACE, CENTROIDS, SAMPLE, ROUNDS = 4, 256, 8192, 8
#: Anchors sent at once, and held against a batch of rows at once.
ANCHORS, TOGETHER = 16_384, 64
#: Integer components reach this far; with up to 2^13 of them, scores are exact in doubles.
REACH = 1 << 20


def takes_part(vector: str, label: str, vec_id: str, scale: int) -> Column:
    """Rows with an id, a label and a vector of finite components whose scaled size is at most ``REACH``."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= REACH))
    return F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(good, F.lit(False))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if len(flat) == len(lengths) * dimensions and (lengths == dimensions).all():
        return flat.reshape(-1, dimensions)
    out = np.zeros((len(lengths), dimensions))
    out[np.arange(dimensions)[None] < lengths[:, None]] = flat
    return out


class Quantiser:
    """Centroids of each subspace."""

    def __init__(self, sample: np.ndarray, seed: int = 3) -> None:
        n, self.dimensions = sample.shape
        self.parts = -(-self.dimensions // SUBSPACE)
        rng = np.random.default_rng(seed)
        cut = self._cut(sample)
        self.centroids = np.zeros((self.parts, CENTROIDS, SUBSPACE))
        for m in range(self.parts):
            points = cut[:, m]
            if not n:
                continue
            c = points[rng.choice(n, CENTROIDS, replace=n < CENTROIDS)]
            for _ in range(ROUNDS):
                near = self._nearest(points, c)
                counts = np.bincount(near, minlength=CENTROIDS)
                sums = np.stack([np.bincount(near, points[:, j], CENTROIDS) for j in range(SUBSPACE)], 1)
                c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
            self.centroids[m] = c

    def _cut(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * SUBSPACE))
        padded[:, : self.dimensions] = x
        return padded.reshape(len(x), self.parts, SUBSPACE)

    @staticmethod
    def _nearest(points: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c**2).sum(1)[None] - 2 * points @ c.T, 1)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and lengths of the residuals, rounded up."""
        cut = self._cut(x)
        codes = np.stack([self._nearest(cut[:, m], self.centroids[m]) for m in range(self.parts)], 1).astype(np.uint8).reshape(len(x), self.parts)
        left = cut - self.centroids[np.arange(self.parts)[None], codes]
        return codes, np.sqrt((left**2).sum((1, 2))) * (1 + 1e-12) + 1e-9

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """For each part, anchor and centroid the inner product."""
        return np.einsum("amd,mcd->mac", self._cut(anchors), self.centroids)

    def estimates(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Anchors by rows."""
        out = np.zeros((tables.shape[1], len(codes)))
        for m in range(self.parts):
            out += tables[m][:, codes[:, m]]
        return out


class Search:
    """Windows of scores about anchors: of each, the first ``first`` rows of the same or of other labels.

    ``anchor``: the anchor's index; ``low``, ``high``: bounds of scores, both
    included; ``floor``: a score that the first rows reach at least.
    """

    def __init__(self, quantiser: Quantiser, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, first: int) -> None:
        self.quantiser, self.ids, self.labels, self.vectors, self.same, self.first = quantiser, ids, labels, vectors, same, first
        self.anchor, self.low, self.high, self.floor = anchor, low, high, np.full(len(anchor), -np.inf)
        self.reach = np.sqrt((vectors**2).sum(1))

    def _best(self, window: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -score, window))
        window, ids, score = window[order], ids[order], score[order]
        begin = np.searchsorted(window, window, "left")
        keep = np.arange(len(window)) - begin < self.first
        return window[keep], ids[keep], score[keep]

    def found(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows (ids, labels, vectors, codes, residuals): window, id and score of each window's first."""
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        floor = self.floor.copy()
        order = np.argsort(self.anchor, kind="stable")
        for ids, labels, vectors, codes, residuals in batches:
            got = [best]
            for k in range(0, len(self.ids), TOGETHER):
                a = slice(k, k + TOGETHER)
                middle = self.quantiser.estimates(self.quantiser.tables(self.vectors[a]), codes)
                off = self.reach[a, None] * residuals[None] * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle) / 1e3)
                fit = ((self.labels[a, None] == labels[None]) == self.same) & (self.ids[a, None] != ids[None])
                lo, hi = np.searchsorted(self.anchor[order], [k, k + TOGETHER])
                for w in order[lo:hi].tolist():
                    i = self.anchor[w] - k
                    most, least = middle[i] + off[i], middle[i] - off[i]
                    at = np.flatnonzero(fit[i] & (most >= max(self.low[w], floor[w])) & (least <= self.high[w]))
                    sure = least[at][(least[at] >= self.low[w]) & (most[at] <= self.high[w])]
                    if len(sure) > self.first:
                        at = at[most[at] >= np.partition(sure, -self.first)[-self.first]]
                    score = vectors[at] @ self.vectors[self.anchor[w]]
                    good = (score >= max(self.low[w], floor[w])) & (score <= self.high[w])
                    got.append((np.full(int(good.sum()), w), ids[at[good]], score[good]))
            best = self._best(*[np.concatenate(x) for x in zip(*got, strict=True)])
            full = np.bincount(best[0], minlength=len(self.anchor)) >= self.first
            last = np.full(len(self.anchor), -np.inf)
            last[best[0]] = best[2]
            floor = np.where(full, np.maximum(floor, last), floor)
        return best

    def foreseen(self, *rows: np.ndarray) -> Search:
        """With the floors that some of the rows give."""
        window, _, score = self.found(iter([rows]))
        full = np.bincount(window, minlength=len(self.anchor)) >= self.first
        last = np.full(len(self.anchor), -np.inf)
        last[window] = score
        self.floor = np.where(full, last, -np.inf)
        return self


_ROWS = "vec_id long, label long, vector array<int>, codes binary, residual double"
_FOUND = "window int, vec_id long, score long"


def _columns(batch: pa.RecordBatch, dimensions: int, parts: int) -> tuple[np.ndarray, ...]:
    ids, labels, vectors, codes, residuals = batch.columns
    joined = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(ids), parts)
    return ids.to_numpy(), labels.to_numpy(), matrix(vectors, dimensions), joined, residuals.to_numpy()


def _first(rows: DataFrame, search: Search, dimensions: int) -> DataFrame:
    """Each task's first rows of each window."""
    sent = rows.sparkSession.sparkContext.broadcast(search)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sent.value.quantiser.parts
        window, ids, score = sent.value.found(_columns(b, dimensions, parts) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(window, pa.int32()), pa.array(ids, pa.int64()), pa.array(score.astype(np.int64), pa.int64())], ["window", "vec_id", "score"])

    own = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return rows.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= search.first)


def _coded(rows: DataFrame, vector: str, scale: int) -> tuple[DataFrame, Quantiser, pa.Table]:
    """The rows with integer vectors, codes and residuals, written; the quantiser; and the coded sample."""
    ints = rows.select("vec_id", "label", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vector"))
    dimensions = ints.agg(F.max(F.size("vector"))).first()[0] or 1
    sample = drawn(ints, "vec_id", max(CENTROIDS, min(SAMPLE, (SAMPLE * 64) // dimensions))).toArrow()
    quantiser = Quantiser(matrix(sample.column("vector").combine_chunks(), dimensions))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, residuals = quantiser.code(matrix(b.column(2), dimensions))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residuals, pa.float64())], ["vec_id", "label", "vector", "codes", "residual"])

    return stored(ints.mapInArrow(run, _ROWS), "quantised"), quantiser, sample


def mine(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", anchor_each: int = 100, positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: int = 256) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows whose id is divisible by ``anchor_each``; a negative's
    score is at least ``low_percent`` of the positive's and at most that. Rows
    without id, label or vector, with null or non-finite components, or with
    components of more than ``REACH`` once scaled take no part. Of rows with one
    id the least by (label, vector) does. Vectors of other lengths are compared
    as if the shorter ended in zeros. A positive without a negative in its
    window has no row. Other columns are left out.
    """
    spark = rows.sparkSession
    own = rows.where(takes_part(vector, label, vec_id, scale)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    twice = own.groupBy("vec_id").count().where("count > 1")
    if twice.limit(1).count():
        once = keep_ids(own, twice, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.*")
        own = keep_ids(own, twice, "vec_id", "left_anti").unionByName(once)
    coded, quantiser, sample = _coded(own, "vector", scale)
    dimensions = quantiser.dimensions
    known = matrix(sample.column("vector").combine_chunks(), dimensions)
    known = (sample.column("vec_id").to_numpy(), sample.column("label").to_numpy(), known, *quantiser.code(known))
    asked = coded.where(F.col("vec_id") % anchor_each == 0)
    blocks = -(-asked.count() // ANCHORS)
    folder = scratch(spark, "hard-negatives")
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "label", "vector").toArrow().sort_by("vec_id")
        if not block.num_rows:
            continue
        ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        vectors, n = matrix(block.column("vector").combine_chunks(), dimensions), block.num_rows
        make = lambda anchor, low, high, same, first: Search(quantiser, ids, labels, vectors, anchor, low, high, same, first).foreseen(*known)  # noqa: B023, E731
        near = make(np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), True, positives)
        pos = sorted(tuple(r) for r in _first(coded, near, dimensions).select("window", "rank", "vec_id", "score").collect())
        if not pos:
            continue
        anchor, _, positive, score = (np.array(x) for x in zip(*pos, strict=True))
        # The least whole score that is low_percent of the positive's.
        low = -(-low_percent * score // 100)
        hard = make(anchor, low.astype(float), score.astype(float), False, negatives)
        named = spark.createDataFrame(pa.table({"window": pa.array(np.arange(len(anchor)), pa.int32()), "anchor_id": ids[anchor], "positive_id": positive, "positive_score": score}))
        found = _first(coded, hard, dimensions).join(F.broadcast(named), "window")
        found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{folder}/{b}")
    paths = [f"{folder}/{b}" for b in range(blocks)]
    exists = [p for p in paths if _written(spark, p)]
    return spark.read.schema(kind).parquet(*exists) if exists else spark.createDataFrame([], kind)


def _written(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
