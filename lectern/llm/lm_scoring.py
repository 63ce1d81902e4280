"""Language-model scores from a weighted backoff automaton of smoothed word n-grams.

States are contexts: the root, the start of a document, and each word. A
state's arcs are the words seen after it, weighted with smoothed
log-probabilities; its failure arc leads to the root at the weight of the
probability left over. The root has an arc for every word, known or not. A
text is read once from left to right: the state goes along, and where it has
no arc for the next word, failure arcs are followed until a state has one.

With counts c and T(h) different words after h, and k = TYPES * T(h) + FLAT:

    p(w | h) = (c(h w) + k p(w)) / (c(h) + k),   p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

which sums to one over the V known words and one for all unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytesops import PLAIN_KEEP, U, Words, mix, pieces
from lectern.llm.exchange import GROUP_BYTES, REQUEST, answered, ask, buckets_for, grouped, request, unpacked, unsqueezed

#: Pseudo-counts of the backoff: for each different follower, and flat.
TYPES, FLAT = 2.0, 5.0
END, START = U(3), U(5)
#: Tokens that are read in a row; pieces of texts are read side by side, each from the state that the token before it leads to.
STRETCH = 256
ROOT = 0
#: Bytes of the corpus for each range of keys (at least one range a shuffle partition).
RANGE_BYTES = 16 << 20


@dataclass
class BackoffAutomaton:
    """Arcs by (state, label), ascending, with weights and targets; a failure arc with its weight for each state but the root.

    Labels are word numbers. ``after[label]`` is the state that the root's arc leads to.
    """

    arc: np.ndarray  # state * labels + label
    weight: np.ndarray
    target: np.ndarray
    failure: np.ndarray  # state
    failure_weight: np.ndarray
    after: np.ndarray
    start: int
    labels: int

    @classmethod
    def of(cls, words: np.ndarray, followers: np.ndarray, starts: int, start_followers: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: int, types: int) -> BackoffAutomaton:
        """From counts of words and of their different followers, and of pairs: (label before, -1 at the start; label; count)."""
        n = len(words)
        base = np.log10((words + 0.5) / (tokens + 0.5 * (types + 1)))
        state = np.where(followers > 0, np.arange(n) + 2, ROOT)  # a word that nothing follows leads to the root
        context = np.concatenate([[0.0, starts], words])
        left = TYPES * np.concatenate([[0.0, start_followers], followers]) + FLAT
        before, label, count = pairs
        origin = before + 2
        seen = np.log10((count + left[origin] * 10 ** base[label]) / (context[origin] + left[origin]))
        arc = np.concatenate([np.arange(n), origin * n + label])
        order = np.argsort(arc)
        weight, target = np.concatenate([base, seen])[order], np.concatenate([state, state[label]])[order]
        return cls(arc[order], weight, target, np.full(n + 2, ROOT), np.log10(left / (context + left)), state, 1, n)

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one token of each of many texts, and the log-probabilities."""
        to, weight = np.empty_like(state), np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] * self.labels + label[todo]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            has = self.arc[at] == key
            done = todo[has]
            to[done] = self.target[at[has]]
            weight[done] += self.weight[at[has]]
            todo = todo[~has]
            weight[todo] += self.failure_weight[state[todo]]
            state = state.copy()
            state[todo] = self.failure[state[todo]]
        return to, weight

    def traverse(self, labels: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-probability of each token of texts that begin at ``first`` (and end where the next begins)."""
        out = np.zeros(len(labels))
        sizes = np.diff(np.append(first, len(labels)))
        many = -(-sizes // STRETCH)
        begin = np.repeat(first - STRETCH * (np.cumsum(many) - many), many) + STRETCH * np.arange(many.sum())
        end = np.minimum(begin + STRETCH, np.repeat(first + sizes, many))
        state = np.where(np.isin(begin, first), self.start, self.after[labels[begin - 1]])
        order = np.argsort(begin - end, kind="stable")  # longest first
        begin, length, state = begin[order], (end - begin)[order], state[order]
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t))
            at = begin[:n] + t
            state, out[at] = self.step(state[:n], labels[at])
        return out


@dataclass
class Batch:
    """Tokens of a group of documents as numbers of its different words and pairs."""

    keys: np.ndarray  # different words (odd) and pairs (even), ascending
    word: np.ndarray  # of each token its word's place in keys
    pair: np.ndarray
    counts: np.ndarray  # tokens of each document

    @classmethod
    def of(cls, texts: pa.Table) -> Batch:
        tokens, counts = [], []
        for chunk in texts.select(["text"]).to_batches():
            for piece in pieces(chunk):
                w = Words(piece.column(0), PLAIN_KEEP)
                tokens.append(np.insert(w.hashes, w.first[1:], END))
                counts.append(w.counts + 1)
        t = np.concatenate(tokens) if tokens else np.zeros(0, U)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        before = np.empty_like(t)
        before[1:] = t[:-1]
        before[np.cumsum(n) - n] = START
        both = np.concatenate([t | U(1), mix(before * U(0x9E3779B97F4A7C15) + t) & ~U(1)])
        keys, at = np.unique(both, return_inverse=True)
        return cls(keys, at[: len(t)], at[len(t) :], n)

    def training(self, held_out: np.ndarray) -> np.ndarray:
        return np.repeat(~held_out, self.counts)

    def state(self) -> np.ndarray:
        """Of each token the place of the word before it, ``len(keys)`` at the start of a document."""
        out = np.empty_like(self.word)
        out[1:] = self.word[:-1]
        out[np.cumsum(self.counts) - self.counts] = len(self.keys)
        return out


def _held(docs: pa.Table) -> np.ndarray:
    return docs.column("held_out").to_numpy(zero_copy_only=False).astype(bool)


def _count_request(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        own = Batch.of(docs)
        train = own.training(_held(docs))
        said = np.bincount(own.word[train], minlength=len(own.keys)) + np.bincount(own.pair[train], minlength=len(own.keys))
        return request(docs.column("g")[0].as_py(), own.keys, said.astype(np.uint32), buckets)

    return run


def _add_counts(keys: np.ndarray, said: np.ndarray, sender: np.ndarray) -> np.ndarray:
    """Of each entry the count over all groups and whether this group is the first with any."""
    order = np.lexsort((sender, said == 0, keys))
    new = np.append(True, keys[order][1:] != keys[order][:-1]) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    totals = np.add.reduceat(said[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    answers = np.zeros(len(keys), np.dtype([("count", "<u8"), ("first", "u1")]))
    answers["count"][order] = np.repeat(totals, np.diff(np.append(first, len(keys))))
    answers["first"][order] = new & (said[order] > 0)
    return answers


_COUNTS = np.dtype([("count", "<u8"), ("first", "u1")])


def _followers_request(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Each different pair is reported by the first group that trains on it, under its context."""
        own = Batch.of(docs)
        first = np.frombuffer(answered(answers), _COUNTS)["first"]
        train = own.training(_held(docs))
        pairs, at = np.unique(own.pair[train], return_index=True)
        contexts = own.state()[train][at[first[pairs] == 1]]
        said = np.bincount(contexts, minlength=len(own.keys) + 1)
        asked = own.keys & U(1) == 1
        keys, said = np.append(START | U(1), own.keys[asked]), np.append(said[-1], said[:-1][asked])
        return request(docs.column("g")[0].as_py(), keys, said.astype(np.uint32), buckets)

    return run


def _add_followers(keys: np.ndarray, said: np.ndarray, sender: np.ndarray) -> np.ndarray:
    _, back = np.unique(keys, return_inverse=True)
    return np.bincount(back, weights=said).astype("<u8")[back] if len(keys) else np.zeros(0, "<u8")


def _scorer(starts: int, tokens: int, types: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = Batch.of(docs)
        step = answers.column("step").to_numpy()
        counted, followed = answers.filter(pa.array(step == 1)), answers.filter(pa.array(step == 2))
        counts = np.frombuffer(answered(counted), _COUNTS)["count"].astype(np.int64)
        known = np.frombuffer(answered(followed), "<u8").astype(np.int64)
        is_word = own.keys & U(1) == 1
        label = np.cumsum(is_word) - 1
        labels = label[own.word]
        first = np.cumsum(own.counts) - own.counts
        at = np.unique(own.pair, return_index=True)[1]
        at = at[counts[own.pair[at]] > 0]
        before = np.append(labels[at - 1], 0)[:-1]
        before[np.isin(at, first)] = -1
        model = BackoffAutomaton.of(counts[is_word], known[1:], starts, int(known[0]), (before, labels[at], counts[own.pair[at]]), tokens, types)
        base = model.weight[: model.labels]
        add = lambda x: np.add.reduceat(x, first)
        n = len(own.counts)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(own.counts, pa.int64()),
                "n_known": pa.array(add((counts[own.word] > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(n, tokens), pa.int64()),
                "base_score": pa.array(add(base[labels])),
                "score": pa.array(add(model.traverse(labels, first))),
            }
        )

    return run


def _word_sender(buckets: int):
    """Different words of the training texts with their counts, by bucket, for about ``GROUP_BYTES`` of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            yield from request(0, keys, np.bincount(counts, np.concatenate([n for _, n in held])).astype(np.uint64), buckets).to_batches()

        for whole in batches:
            for piece in pieces(whole):
                w = Words(piece.column(0), PLAIN_KEEP)
                held.append(np.unique(np.append(w.hashes | U(1), np.full(piece.num_rows, END | U(1))), return_counts=True))
                size += len(w.data)
                if size >= GROUP_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    keys = [unpacked(r["keys"]) for r in rows]
    tokens = sum(int(unsqueezed(r["said"], np.uint64).sum()) for r in rows)
    types = len(np.unique(np.concatenate(keys))) if keys else 0
    yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([types], pa.int64())], ["tokens", "types"])


def totals(own: DataFrame, buckets: int) -> tuple[int, int, int]:
    """Documents, tokens and different tokens to learn from."""
    train = own.where(~F.col("held_out"))
    sent = train.select("text").mapInArrow(_word_sender(buckets), REQUEST)
    tokens, types = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_word_totals, "tokens long, types long").agg(F.sum("tokens"), F.sum("types")).first()
    return train.count(), tokens or 0, types or 0


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``, learning from those where ``held_out`` is false.

    A null or word-less text is its end token alone; rows with a null id take
    part like others; repeated rows each count and each get their row; with
    nothing to learn from, every token has the base's probability of an unknown
    one. Other columns are not returned.

    The training tokens are counted first. Documents are then dealt into groups
    once; each group counts its different words and pairs and asks for their
    totals over the corpus, then for the number of followers of its words, and
    reads its documents through the automaton that the answers make. Words and
    pairs are known by 64-bit hashes.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    dealt, size = grouped(own, "text")
    buckets = buckets_for(own, size, RANGE_BYTES)
    starts, tokens, types = totals(own, buckets)
    counted = ask(dealt.groupBy("g").applyInArrow(_count_request(buckets), REQUEST), buckets, np.uint32, _add_counts)
    pairs = dealt.groupBy("g").cogroup(counted.groupBy("g")).applyInArrow(_followers_request(buckets), REQUEST)
    followed = ask(pairs, buckets, np.uint32, _add_followers)
    answers = counted.withColumn("step", F.lit(1)).union(followed.withColumn("step", F.lit(2)))
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_scorer(starts, tokens, types), SCORED)
