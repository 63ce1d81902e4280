"""Language identification, decontamination, LM scores, suffix dedup: brute force on small tables."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontamination, language_id, lm_scoring, suffix_dedup
from lectern.llm.bytesops import ALNUM_KEEP, PLAIN_KEEP, Words
from lectern.llm.common import bucket_of_id

from .frames import none, odd, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize(("keep", "pattern"), [(PLAIN_KEEP, r"[^\x20\x09-\x0D]+"), (ALNUM_KEEP, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(keep, pattern):
    import pyarrow as pa

    column = pa.array([t for _, t in texts()])
    w = Words(column, keep)
    for d, (_, text) in enumerate(texts()):
        own = range(w.first[d], w.first[d + 1])
        assert [w.data[w.starts[k] : w.ends[k]].tobytes().decode() for k in own] == re.findall(pattern, (text or "").translate(LOWER))
    assert len(set(w.hashes.tolist())) == len({w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)})


def test_language_by_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs, bucket_of_id("doc_id", 4) == 2).where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()


def test_language_odd_rows(spark):
    net = language_id.train(odd(spark))
    assert net.labels == ["en"]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd(spark), net).collect()}
    assert out[13] == out[14] == out[15] == out[-5] == ("und", 0.0) and out[10][0] == "en"
    assert language_id.train(none(spark)) is None
    assert {r.lang_pred for r in language_id.predict(odd(spark), None).collect()} == {"und"}
    assert language_id.predict(none(spark), net).count() == 0


def test_language_gradients():
    """Every parameter's steepest gradients against finite differences, in double precision."""
    net = language_id.ByteConvolution.fresh(["a", "b", "c"])
    net.embedding, net.filters = net.embedding.astype(float), [f.astype(float) for f in net.filters]
    net.biases, net.weights, net.offsets = (p.astype(float) + 0.01 for p in (net.biases, net.weights, net.offsets))
    x = np.random.default_rng(0).integers(0, 64, (6, language_id.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 0, 2, 1, 1])
    loss, grads = net.step(x, y)
    assert math.isclose(loss, float(-np.log(net.windows(x, net.tables())[np.arange(6), y]).mean()), rel_tol=1e-4)
    for p, g in zip(net.parameters(), grads, strict=True):
        assert p.shape == g.shape
        for at in np.argsort(-np.abs(g).ravel())[:6]:
            k = np.unravel_index(at, p.shape)
            was, side = p[k], []
            for step in (1e-6, -1e-6):
                p[k] = was + step
                side.append(net.step(x, y)[0])
            p[k] = was
            assert math.isclose((side[0] - side[1]) / 2e-6, g[k], rel_tol=1e-3, abs_tol=1e-7)


def naive_language(net, text):
    """Window by window, position by position."""
    s, total = language_id.FOLD[np.frombuffer(text.encode(), np.uint8)], 0.0
    for a in range(0, len(s), language_id.WINDOW):
        window = np.zeros(language_id.WINDOW, int)
        window[: len(s[a : a + language_id.WINDOW])] = s[a : a + language_id.WINDOW]
        e = net.embedding[window]
        top = [np.max([sum(e[p + k] @ f[k] for k in range(len(f))) for p in range(len(e) - len(f) + 1)], 0) for f in net.filters]
        logits = np.maximum(np.concatenate(top) + net.biases, 0) @ net.weights + net.offsets
        p = np.exp(logits - logits.max())
        total = total + p / p.sum() * sum(0 < c < 27 or c >= 32 for c in window)
    return net.labels[int(np.argmax(total))], float(np.max(total) / np.sum(total))


def test_language_against_naive_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and n_chars < 600").limit(30)
    net = language_id.train(docs)
    for r in language_id.predict(docs, net).collect():
        label, score = naive_language(net, r.text)
        assert math.isclose(r.score, score, rel_tol=1e-3) and (r.lang_pred == label or score < 0.51)


ITEMS = [(1, "fox jumps over the lazy dog and then some more words follow until"), (2, "One, TWO three!"), (3, None), (None, "quick"), (4, "..."), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18")]


def brute_contamination(n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for item, text in ITEMS:
        w = words(text)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if m and item is not None else 0):
            windows[tuple(w[k : k + m])].add(str(item))
    out = []
    for doc, text in texts():
        w, hit, items = words(text), set(), set()
        for window, owners in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    items |= owners
        out.append((str(doc), len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((str(r[0]), *r[1:]) for r in decontamination.query(odd(spark), items).collect()) == brute_contamination()
    kept = decontamination.decontaminate(odd(spark), items)
    bad = {r[0] for r in brute_contamination() if r[-1]}
    assert kept.columns == odd(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, _ in texts() if str(k) not in bad)
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(odd(spark), items, remove="spans").collect()}
    assert cut[20] == "" and cut[16] == "Re." and "lazy" not in cut[10] and "quick" in cut[10]
    assert decontamination.query(odd(spark), items.where("false")).where("n_hit > 0").count() == 0
    assert decontamination.query(none(spark), items).count() == 0


def test_lm_scores(spark):
    held = bucket_of_id("doc_id", 5) == 1
    found = lm_scoring.score(odd(spark), held).collect()
    is_held = {r.doc_id: bool(r.h) for r in odd(spark).select("doc_id", held.alias("h")).collect()}
    tokens = [(k, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]) for k, t in texts()]
    c, b, starts = collections.Counter(), collections.Counter(), 0
    for k, w in tokens:
        if not is_held[k]:
            c.update(w)
            b.update(zip(["<s>", *w], w, strict=False))
            starts += 1
    n, v, t = sum(c.values()), len(c), collections.Counter(h for h, _ in b)
    p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    expected = []
    for k, w in tokens:
        score = 0.0
        for h, x in zip(["<s>", *w], w, strict=False):
            rest = 2 * t[h] + 5
            score += math.log10((b[h, x] + rest * p(x)) / ((starts if h == "<s>" else c[h]) + rest))
        expected.append((str(k), is_held[k], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10(p(x)) for x in w), 6), round(score, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found) == sorted(expected)
    assert lm_scoring.score(none(spark), held).count() == 0
    nothing = lm_scoring.score(odd(spark), F.lit(True)).first()
    assert nothing.train_tokens == 0 and nothing.score == nothing.base_score == 0


def test_lm_automaton():
    """Three words after which two, one and none follow; the arcs and failure arcs of each state sum to one."""
    pairs = (np.array([-1, 0, 0, 1]), np.array([0, 0, 1, 0]), np.array([2, 1, 3, 2]))
    m = lm_scoring.BackoffAutomaton.of(np.array([4, 2, 0]), np.array([2, 1, 0]), 2, 1, pairs, 6, 2)
    assert m.after.tolist() == [2, 3, lm_scoring.ROOT]
    for state in (lm_scoring.ROOT, m.start, 2, 3):
        to, weight = m.step(np.full(3, state), np.arange(3))
        assert math.isclose((10**weight).sum(), 1, rel_tol=1e-9) and to.tolist() == m.after.tolist()
    labels = np.random.default_rng(1).integers(0, 3, 4000)
    first = np.array([0, 1, 700, 3990])
    state, expected = None, []
    for k, w in enumerate(labels):
        state = np.array([m.start]) if k in first else state
        state, weight = m.step(state, np.array([w]))
        expected.append(weight[0])
    assert np.allclose(m.traverse(labels, first), expected)


def morse(n, swap=False):
    """Two texts of 2^n letters that sums of powers modulo 2^64 take for one."""
    return "".join("ab"[(bin(k).count("1") + swap) % 2] for k in range(1 << n))


def test_words_of_a_simple_make_differ(spark):
    rows = [(k, f"{morse(n, s)} end") for k, (n, s) in enumerate([(10, 0), (10, 1), (11, 0), (11, 1), (9, 0), (9, 1)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (docs, docs.orderBy(F.desc("doc_id"))):
        found = {r.doc_id: r for r in lm_scoring.score(part.coalesce(1), F.col("doc_id") % 2 == 1).collect()}
        assert [found[k].n_known for k in range(6)] == [3, 2, 3, 2, 3, 2] and found[0].train_tokens == 9


def test_suffix_dedup(spark):
    length = suffix_dedup.LENGTH
    data = [(k, (t or "").encode()) for k, t in texts()]
    least = {}
    for k, raw in data:
        for i in range(len(raw) - length + 1 if k is not None else 0):
            s = raw[i : i + length]
            least[s] = min(k, least.get(s, k))
    expected = []
    for k, raw in data:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1 if k is not None else 0):
            if least[raw[i : i + length]] < k:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        expected.append((str(k), len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in suffix_dedup.digests(odd(spark)).collect()) == sorted(expected)
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd(spark)).collect()}
    assert cut[11].text == "" and cut[10].n_removed == 0
    assert suffix_dedup.digests(none(spark)).count() == 0


def test_letters_of_language_id():
    """Numeric symbols and marks alone are no letters."""
    for text in (None, "", "½ ² ① Ⅷ", "12 _ -", "\u0301\u0308", "² 3 🙂"):
        assert not language_id.lettered(text)
    for text in ("a", "½ é", "①漢", "ª", "\u01c5", "12 ² x"):
        assert language_id.lettered(text)


def test_texts_without_letters_are_of_no_language(spark):
    rows = [(k, "some words of a language here and there", "en") for k in range(8)] + [(50, "½ ² ① Ⅷ", "en"), (51, "½ word", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(docs, docs.doc_id < 0).collect()}
    assert (found[50].lang_pred, found[50].score) == ("und", 0.0) and found[51].lang_pred == "en"
