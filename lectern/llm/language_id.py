"""Language identification by a byte convolutional network trained in numpy.

Bytes are folded to 64 symbols and embedded; filters of widths 2, 3 and 4
slide over windows of fixed length; each filter's maximum over the window
feeds a softmax. A text's score is the mean of its windows' probabilities,
weighted by their letters, so that a text of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytesops import buffers, pieces
from lectern.llm.common import frugal

UNKNOWN = "und"
SYMBOLS, WIDTHS, FILTERS, DIMENSIONS = 64, (2, 3, 4), 8, 8
#: Bytes in a window.
WINDOW = 128
#: The network is fitted on at most this many labelled documents a language, taken by a hash of the id, and their first windows.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 4
EPOCHS, BATCH, RATE = 5, 64, 0.01


def _fold() -> np.ndarray:
    """Byte -> symbol: letters without case, one symbol for digits, for white space and for other ASCII; bytes from 0x80 by their low five bits."""
    f = np.full(256, 27, np.uint8)
    f[48:58] = 28
    f[[0, 9, 10, 11, 12, 13, 32]] = 0
    f[97:123] = np.arange(1, 27)
    f[65:91] = np.arange(1, 27)
    f[128:] = 32 + np.arange(128) % 32
    return f


FOLD = _fold()


@dataclass
class ByteConvolution:
    labels: list[str]
    embedding: np.ndarray  # SYMBOLS x DIMENSIONS
    filters: list[np.ndarray]  # width x DIMENSIONS x FILTERS each
    biases: np.ndarray
    weights: np.ndarray  # filters x labels
    offsets: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 5) -> ByteConvolution:
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        f = lambda *shape: r.normal(0, 1 / np.sqrt(np.prod(shape[:-1])), shape).astype(np.float32)
        return cls(labels, r.normal(0, 1, (SYMBOLS, DIMENSIONS)).astype(np.float32), [f(w, DIMENSIONS, FILTERS) for w in WIDTHS], np.zeros(n, np.float32), f(n, len(labels)), np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.biases, self.weights, self.offsets]

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(x, w, axis=1)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients for windows ``x`` (n x WINDOW symbols) of labels ``y``."""
        n, pooled, kept = len(x), [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            cols = self._columns(x, w)
            e = self.embedding[cols].reshape(n, cols.shape[1], w * DIMENSIONS)
            z = e @ f.reshape(-1, FILTERS)
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
            kept.append((cols, e, at))
        pre = np.concatenate(pooled, 1) + self.biases
        h = np.maximum(pre, 0)
        logits = h @ self.weights + self.offsets
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        d = p.copy()
        d[np.arange(n), y] -= 1
        d /= n
        grad_h = (d @ self.weights.T) * (pre > 0)
        grads_f, grad_e = [], np.zeros_like(self.embedding)
        for k, (f, (cols, e, at)) in enumerate(zip(self.filters, kept, strict=True)):
            g = grad_h[:, k * FILTERS : (k + 1) * FILTERS]
            picked = np.take_along_axis(e, at[:, :, None], 1)  # n x FILTERS x w*D
            grads_f.append(np.einsum("nf,nfe->ef", g, picked).reshape(f.shape))
            back = (g[:, :, None] * f.reshape(-1, FILTERS).T[None]).reshape(-1, DIMENSIONS)
            symbols = np.take_along_axis(cols, at[:, :, None], 1).reshape(-1)
            np.add.at(grad_e, symbols, back)
        return loss, [grad_e, *grads_f, grad_h.sum(0), h.T @ d, d.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> list[float]:
        """Adam over shuffled batches."""
        r, losses, t = np.random.default_rng(seed), [], 0
        m = [np.zeros_like(p) for p in self.parameters()]
        v = [np.zeros_like(p) for p in self.parameters()]
        for _ in range(EPOCHS):
            order, total = r.permutation(len(x)), 0.0
            for k in range(0, len(x), BATCH):
                own = order[k : k + BATCH]
                loss, grads = self.step(x[own], y[own])
                t, total = t + 1, total + loss * len(own)
                for p, g, a, b in zip(self.parameters(), grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            losses.append(total / len(x))
        return losses

    def tables(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """What pairs of symbols add to each filter, so that scoring needs lookups and sums only.

        Filters of width 2 and the first two symbols of widths 3 and 4 come
        from one table of 4096 rows; the rest of widths 3 and 4 from others.
        """
        one = lambda f, k: self.embedding @ f[k]
        two = lambda f, k: (one(f, k)[:, None] + one(f, k + 1)[None]).reshape(SYMBOLS**2, FILTERS)
        return np.ascontiguousarray(np.concatenate([two(f, 0) for f in self.filters], 1)), [np.ascontiguousarray(one(self.filters[1], 2)), np.ascontiguousarray(two(self.filters[2], 2))]

    def windows(self, symbols: np.ndarray, tables: tuple[np.ndarray, list[np.ndarray]]) -> np.ndarray:
        """Label probabilities of windows (n x WINDOW symbols)."""
        first, (third, last) = tables
        s = symbols.astype(np.int32)
        pair = s[:, :-1] * SYMBOLS + s[:, 1:]
        z = first.take(pair, 0)
        n = WINDOW - 1
        z[:, : n - 1, FILTERS : 2 * FILTERS] += third.take(s[:, 2:], 0)
        z[:, : n - 2, 2 * FILTERS :] += last.take(pair[:, 2:], 0)
        top = np.concatenate([z[:, : n - k, k * FILTERS : (k + 1) * FILTERS].max(1) for k in range(3)], 1)
        logits = np.maximum(top + self.biases, 0) @ self.weights + self.offsets
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def cut(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each padded with symbol 0, and each window's text."""
    length = np.diff(offsets)
    counts = -(-length // WINDOW)
    text = np.repeat(np.arange(len(length)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[text] + within * WINDOW
    at = start[:, None] + np.arange(WINDOW)[None]
    out = symbols[np.minimum(at, len(symbols) - 1)] if len(symbols) else np.zeros((0, WINDOW), np.uint8)
    tail = start + WINDOW > offsets[text + 1]
    out[tail] = np.where(at[tail] < offsets[text[tail] + 1][:, None], out[tail], 0)
    return out, text


def train(labelled: DataFrame, *, text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> ByteConvolution | None:
    """Fit on a bounded sample of rows with text and label; ``None`` without any label.

    The sample is the ``SAMPLE_DOCS`` rows a label with the smallest hash of
    the id, the first ``SAMPLE_WINDOWS`` windows of each.
    """
    chars = WINDOW * SAMPLE_WINDOWS
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    key = F.struct(F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.substring(text, 1, chars).alias("t"))
    bound = rows.select(F.col(label).alias("label"), key.alias("k")).withColumn("share", F.pmod(F.col("k.h"), F.lit(1 << 20)))
    counts = {r["label"]: r["n"] for r in bound.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int((1 << 20) * min(1.0, 2 * SAMPLE_DOCS / n)))])
    drawn = bound.where(F.col("share") < limits[F.col("label")]).select("label", "k.h", "k.t").orderBy("share", "h").limit(3 * SAMPLE_DOCS * len(counts)).collect()
    labels = sorted(counts)
    x, y, taken = [], [], dict.fromkeys(labels, 0)
    for r in drawn:
        if taken[r.label] < SAMPLE_DOCS and lettered(r.t):
            taken[r.label] += 1
            raw = np.frombuffer(r.t.encode(), np.uint8)
            w, _ = cut(FOLD[raw], np.array([0, len(raw)]))
            w = w[: max(1, min(SAMPLE_WINDOWS, len(w) - 1))]
            x.append(w)
            y += [labels.index(r.label)] * len(w)
    net = ByteConvolution.fresh(labels)
    if x:
        net.fit(np.concatenate(x), np.array(y))
    return net


_NEARLY = re.compile(r"[^\W\d_]")


def lettered(text: str | None) -> bool:
    """Whether a text holds a letter (category L); numeric symbols such as ½ and ② are none."""
    found = _NEARLY.search(text) if text else None
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text[found.end() :])))


def _predictor(model, text: str, added: list[str]):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: ByteConvolution | None = model.value
        tables = net.tables() if net else None
        for whole in batches:
            for batch in pieces(whole, text, 1 << 19):
                column = batch.column(batch.schema.get_field_index(text))
                raw, o = buffers(column)
                total = np.zeros((len(o) - 1, len(net.labels) if net else 1))
                if net and len(raw):
                    symbols, owner = cut(FOLD[raw], o)
                    letters = ((symbols > 0) & ((symbols < 27) | (symbols >= 32))).sum(1)
                    for k in range(0, len(owner), 128):
                        p = net.windows(symbols[k : k + 128], tables) * letters[k : k + 128, None]
                        np.add.at(total, owner[k : k + 128], p)
                weight = total.sum(1)
                known = np.fromiter(map(lettered, column.to_pylist()), bool, len(column)) & (weight > 0)
                best = total.argmax(1)
                names = [net.labels[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)] if net else [UNKNOWN] * len(column)
                score = np.where(known, total.max(1) / np.maximum(weight, 1e-9), 0.0).clip(0, 1)
                kept = [k for k, name in enumerate(batch.schema.names) if name not in added]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(names, pa.string()), pa.array(score, pa.float64())], [batch.schema.names[k] for k in kept] + added)

    return run


def predict(docs: DataFrame, net: ByteConvolution | None, *, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row, from the text alone.

    A null text, one without any letter, and any text where nothing was
    learned get ``und`` and score 0. Columns named as the added ones are
    replaced; all others pass through; repeated rows each get their row.
    """
    added = ["lang_pred", "score"]
    own = docs.drop(*added)
    schema = own.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    return own.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(net), text, added), schema)


def identify(docs: DataFrame, held_out, *, doc_id: str = "doc_id") -> DataFrame:
    """Train on the rows where the condition ``held_out`` is false, predict all rows."""
    return predict(docs.withColumn("held_out", held_out), train(docs.where(~held_out), doc_id=doc_id))

