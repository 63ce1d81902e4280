"""Near-duplicate embeddings: randomised-rotation binary codes whose error bounds decide which pairs are recomputed.

A unit vector is padded to ``BITS`` dimensions and rotated by a random
orthogonal matrix; its code is the sign of each coordinate, one bit. Stored
with it are its factor f = <code / sqrt(BITS), rotated vector> and, for its
part as the other side, the rotated coordinates rounded at random to
``PLANES`` bits. The product of the matrix of codes with that of those planes' numbers gives
<code, rounded> and, over f, an estimate of the inner product without bias. It
is off by more than ``SIGMAS`` / sqrt(BITS - 1) * sqrt((1 - f^2) / f^2) for the
code and ``SIGMAS`` * step / (2 f) for the rounding only with a probability of
about exp(-SIGMAS^2 / 2). Pairs whose estimate plus these bounds reaches the
threshold are recomputed exactly in double precision; no link is reported
without that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drawn, stored
from lectern.llm.components import connected_components

THRESHOLD = 0.9
#: Dimensions of the codes (at least; more if the vectors have more), bits of the other side, and the width of the confidence bounds.
BITS, PLANES, SIGMAS = 128, 4, 6.0
#: Vectors in a block; pairs of blocks are the units of work.
BLOCK = 4096
#: Most centres of the cells that blocks are cut from (one a block's worth of vectors till then), taken from a bounded
#: sample, and most strata by angle of a cell; strata of more than a block are dealt at random.
CENTRES, SAMPLE, STRATA = 64, 4096, 16


def rotation(dimensions: int, bits: int, seed: int = 11) -> np.ndarray:
    """``bits`` x ``dimensions``: columns of a random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dimensions)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Codes:
    """Of vectors: packed codes, factors and bounds, and the packed planes of their rounded coordinates."""

    def __init__(self, code: np.ndarray, planes: np.ndarray, factor: np.ndarray, low: np.ndarray, step: np.ndarray) -> None:
        self.code, self.planes, self.factor, self.low, self.step = code, planes, factor, low, step
        self.bits = 64 * code.shape[1]
        self.bound = SIGMAS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / np.sqrt(self.bits - 1)
        self.ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        self.total = low * self.bits + step * sum((np.bitwise_count(planes[:, j]).sum(1, dtype=np.int64) << j) for j in range(PLANES))

    @classmethod
    def of(cls, x: np.ndarray, turn: np.ndarray, seed: int = 5) -> Codes:
        """Of unit vectors."""
        bits = len(turn)
        turned = x @ turn.T
        factor = np.maximum(np.abs(turned).sum(1) / np.sqrt(bits), 1e-6)
        low, most = turned.min(1), (1 << PLANES) - 1
        step = np.maximum((turned.max(1) - low) / most, 1e-12)
        level = np.floor((turned - low[:, None]) / step[:, None] + np.random.default_rng(seed).random(turned.shape)).clip(0, most).astype(np.uint8)
        pack = lambda b: np.packbits(b, axis=1).view(np.uint64)
        return cls(pack(turned >= 0), np.stack([pack(level >> j & 1) for j in range(PLANES)], 1), factor, low, step)

    def of_rows(self, rows: slice | np.ndarray) -> Codes:
        return Codes(self.code[rows], self.planes[rows], self.factor[rows], self.low[rows], self.step[rows])

    def estimates(self, other: Codes) -> np.ndarray:
        """Unbiased inner products of the ``other`` vectors, rounded (rows), with these, coded (columns)."""
        common = np.zeros((len(other.low), len(self.low)), np.int32)
        for j in range(PLANES):
            for w in range(self.code.shape[1]):
                common += np.bitwise_count(other.planes[:, j, w, None] & self.code[None, :, w]).astype(np.int32) << j
        inner = 2 * (other.low[:, None] * self.ones[None] + other.step[:, None] * common) - other.total[:, None]
        return inner / (np.sqrt(self.bits) * self.factor[None])

    def levels(self) -> np.ndarray:
        """What stands for the rounded coordinates in ``may_reach``: a row a vector, to be multiplied with a row of ``signs``."""
        level = sum(np.unpackbits(np.ascontiguousarray(self.planes[:, j]).view(np.uint8), axis=1).astype(np.float32) * (1 << j) for j in range(PLANES))
        wide = (2 * self.low)[:, None], (SIGMAS / 2 * np.sqrt(self.bits) * self.step - self.total)[:, None]
        return np.hstack([level * (2 * self.step)[:, None], *wide]).astype(np.float32)

    def signs(self) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(self.code).view(np.uint8), axis=1)
        return np.hstack([bits, self.ones[:, None], np.ones((len(bits), 1))]).astype(np.float32)

    def may_reach(self, levels: np.ndarray, threshold: float) -> np.ndarray:
        """Where estimates and doubt add up to the threshold: one matrix product, in single precision with room for its rounding."""
        room = 1e-4 * np.sqrt(self.bits)
        least = np.sqrt(self.bits) * self.factor * (threshold - self.bound) - room
        return levels @ self.signs().T >= least.astype(np.float32)[None]

    def doubt(self, other: Codes) -> np.ndarray:
        """How far these estimates may be off."""
        return self.bound[None] + SIGMAS / 2 * other.step[:, None] / self.factor[None]


def linked_pairs(x: np.ndarray, cx: Codes, y: np.ndarray, cy: Codes, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows at or above the threshold by exact cosine, a bounded number at a time."""
    levels = cx.levels()
    for k in range(0, len(x), 1024):
        a, b = np.nonzero(cy.may_reach(levels[k : k + 1024], threshold))
        for p in range(0, len(a), 1 << 16):
            i, j = a[p : p + (1 << 16)] + k, b[p : p + (1 << 16)]
            exact = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
            yield i[exact], j[exact]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Star links that connect what the given links connect: (smallest node, other) rows."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    i, j = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return np.stack([nodes[label[own]], nodes[own]], 1)


def _read(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_CODED = "rep long, copies long, embedding array<double>, code binary, planes binary, factor double, low double, step double, cell int, angle double"
_DEALT = ["rep", "copies", "embedding", "code", "planes", "factor", "low", "step"]


def _coder(centres, dimensions: int):
    """Code, cell (the nearest centre) and angle to it of each vector, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, turn = centres.value, rotation(dimensions, max(BITS, -(-dimensions // 64) * 64))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(_read(batch.column(2)))
            cosine, codes = x @ c.T, Codes.of(x, turn)
            wide = lambda v: pa.array([r.tobytes() for r in v], pa.binary())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dimensions, pa.int32()), pa.array(x.reshape(-1)))
            made = [flat, wide(codes.code), wide(codes.planes), pa.array(codes.factor), pa.array(codes.low), pa.array(codes.step), pa.array(cosine.argmax(1), pa.int32()), pa.array(np.arccos(cosine.max(1).clip(-1, 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], [f.split()[0] for f in _CODED.split(", ")])

    return run


_OUT = "kind int, a long, b long"


def _tile(threshold: float):
    def run(own: pa.Table) -> pa.Table:
        """All rows of one pair of blocks: links counted by vector (kind 0), and links that connect what is linked (kind 1)."""
        own = own.combine_chunks()
        left, right = (own.column(k).to_numpy(zero_copy_only=False) for k in ("is_left", "is_right"))
        p, q = np.flatnonzero(left), np.flatnonzero(right)
        rep, copies = own.column("rep").to_numpy(), own.column("copies").to_numpy()
        counts, stars = np.zeros(len(rep), np.int64), np.zeros((0, 2), np.int64)
        if len(p) and len(q):
            x = _read(own.column("embedding").combine_chunks())
            packed = lambda k: np.frombuffer(b"".join(own.column(k).to_pylist()), np.uint64)
            code = packed("code").reshape(len(rep), -1)
            codes = Codes(code, packed("planes").reshape(len(rep), PLANES, -1), *(own.column(k).to_numpy() for k in ("factor", "low", "step")))
            for i, j in linked_pairs(x[p], codes.of_rows(p), x[q], codes.of_rows(q), threshold):
                a, b = p[i], q[j]
                if (left & right).any():
                    a, b = a[a < b], b[a < b]
                np.add.at(counts, a, copies[b])
                np.add.at(counts, b, copies[a])
                held = np.concatenate([stars, np.stack([rep[a], rep[b]], 1)])
                stars = forest(held[:, 0], held[:, 1])
        which = np.flatnonzero(counts)
        return pa.table({"kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(which), len(stars)])), "a": pa.array(np.append(rep[which], stars[:, 0])), "b": pa.array(np.append(counts[which], stars[:, 1]))})

    return run


def strata_to_compare(low: np.ndarray, high: np.ndarray, cell: np.ndarray, apart: np.ndarray, angle: float) -> list[np.ndarray]:
    """Of each stratum those at or after it that may hold vectors linked with its own.

    A stratum holds vectors of one cell between two angles to its centre. By the
    triangle inequality two vectors of one cell differ by at least the
    difference of their angles, and of two cells by at least the angle between
    the centres less both.
    """
    out = []
    for k in range(len(low)):
        nearest = np.where(cell == cell[k], np.maximum(low - high[k], low[k] - high), apart[cell[k], cell] - high - high[k])
        out.append(np.flatnonzero((nearest <= angle + 1e-6) & (np.arange(len(low)) >= k)))
    return out


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, as do vectors of different dimensions with each other
    and rows with a null id (whose component is null and which are kept).
    Repeated rows count as vectors of their own with the same id. Other
    columns are not returned.

    Equal vectors are folded into one that counts its copies. Each is coded
    once, and the codes are stored. Cells are cut by angle to their centres
    into at most ``STRATA`` strata, and these at random into blocks of about
    ``BLOCK`` vectors. Only pairs of blocks whose strata the triangle inequality
    cannot rule out are compared, each in one task, whose output is counts and
    a spanning forest, never all pairs. What the driver knows and broadcasts is
    bounded by the number of strata.
    """
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("embedding"))
    large = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double")))
    fit = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (large > 0)
    usable = own.where(F.coalesce(fit, F.lit(False)))
    hashes = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    if not single:  # so that no square over- or underflows
        usable = usable.withColumn("embedding", F.transform("embedding", lambda x: x / large))
    usable = usable.select("vec_id", *hashes, "embedding")
    folded = stored(usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vectors")
    sizes = [r[0] for r in folded.select(F.size("embedding")).distinct().collect()]
    found = None
    for dimensions in sorted(sizes):
        part = _one_size(folded.where(F.size("embedding") == dimensions), dimensions, threshold)
        found = part if found is None else found.union(part)
    if found is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "vector-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n_links"))
    component = connected_components(found.where("kind = 1")).withColumnRenamed("node", "rep")
    classes = folded.select("h1", "h2", "rep", "copies").join(counts, "rep", "left").join(component, "rep", "left")
    classes = classes.select("h1", "h2", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = own.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _one_size(folded: DataFrame, dimensions: int, threshold: float) -> DataFrame:
    spark = folded.sparkSession
    found = [r[0] for r in drawn(folded, "rep", SAMPLE).select("embedding").collect()]
    r = np.random.default_rng(3)
    sample = units(np.array(found, float))
    wanted = min(CENTRES, -(-folded.count() // BLOCK))
    centres = sample[r.permutation(len(sample))[:wanted]]
    coder = _coder(spark.sparkContext.broadcast(centres), dimensions)
    coded = stored(folded.select("rep", "copies", "embedding").mapInArrow(coder, _CODED), "vector-codes")
    n = {x["cell"]: x["n"] for x in coded.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CENTRES rows
    quantiles = F.percentile_approx("angle", [k / 64 for k in range(1, 64)], 10_000).alias("q")
    cuts = {x["cell"]: x["q"] for x in coded.groupBy("cell").agg(quantiles).collect()}
    strata = []  # cell, least and greatest angle
    edges = {}
    for c in sorted(n):
        parts = min(STRATA, -(-n[c] // BLOCK))
        edges[c] = sorted({cuts[c][max(0, round(64 * k / parts) - 1)] for k in range(1, parts)})
        strata += [(c, low, high) for low, high in zip([0.0, *edges[c]], [*edges[c], np.pi], strict=True)]
    first = {c: next(k for k, x in enumerate(strata) if x[0] == c) for c in n}
    index = spark.createDataFrame([(c, [float(x) for x in e], first[c]) for c, e in edges.items()], "cell int, edges array<double>, first int")
    stratum = F.col("first") + F.size(F.filter("edges", lambda e: e < F.col("angle")))
    placed = coded.join(F.broadcast(index), "cell").select(*_DEALT, stratum.alias("s"))
    held = {x["s"]: x["n"] for x in placed.groupBy("s").agg(F.count("*").alias("n")).collect()}  # at most CENTRES * STRATA rows
    blocks = [-(-held.get(k, 0) // BLOCK) for k in range(len(strata))]
    cell, low, high = (np.array(x) for x in zip(*strata, strict=True))
    apart = np.arccos((centres @ centres.T).clip(-1, 1))
    partners: list[list] = [[] for _ in strata]
    for k, others in enumerate(strata_to_compare(low, high, cell, apart, float(np.arccos(threshold)))):
        for m in others.tolist():
            partners[k].append((m, blocks[m], True))
            if m != k:
                partners[m].append((k, blocks[k], False))
    table = spark.createDataFrame([(k, blocks[k], x) for k, x in enumerate(partners)], "s int, blocks int, others array<struct<t:int,blocks:int,first:boolean>>")
    dealt = placed.join(F.broadcast(table), "s").withColumn("i", F.pmod(F.xxhash64("rep"), F.greatest("blocks", F.lit(1))).cast("int"))
    dealt = dealt.select(*_DEALT, "s", "i", F.explode("others").alias("o")).where("o.blocks > 0").select(*_DEALT, "s", "i", "o.t", "o.first", F.explode(F.expr("sequence(0, o.blocks - 1)")).alias("j"))
    same = F.col("s") == F.col("t")
    left = F.when(same, F.col("i") <= F.col("j")).otherwise(F.col("first"))
    right = F.when(same, F.col("i") >= F.col("j")).otherwise(~F.col("first"))
    one, other = F.struct(F.col("s").alias("s"), F.col("i").alias("i")), F.struct(F.col("t").alias("s"), F.col("j").alias("i"))
    tiles = dealt.withColumns({"is_left": left, "is_right": right, "x": F.least(one, other), "y": F.greatest(one, other)})
    return tiles.select(*_DEALT, "is_left", "is_right", "x.s", "x.i", F.col("y.s").alias("t"), F.col("y.i").alias("j")).groupBy("s", "i", "t", "j").applyInArrow(_tile(threshold), _OUT)
