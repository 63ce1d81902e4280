"""Hard negatives, importance resampling and fingerprints against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprints, hard_negatives, importance

from .frames import none, odd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<double>, label int, codes string, window int, residual string"


def brute_negatives(rows, each):
    own = {}
    for i, v, c, *_ in rows:
        if i is None or c is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[i] = min(own.get(i, (c, v)), (c, v))
    own = {i: (c, [math.floor(256 * x) for x in v]) for i, (c, v) in own.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in own.items():
        if a % each:
            continue
        scores = sorted((-dot(v, w), b) for b, (_, w) in own.items() if b != a)
        for s, p in [x for x in scores if own[x[1]][0] == label][:5]:
            near = [x for x in scores if own[x[1]][0] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "sample"), [(16_384, 8192), (5, 300)])
def test_hard_negatives(spark, monkeypatch, anchors, sample):
    """Clusters, equal vectors, ties, negative scores and rows that take no part; in one block of anchors and in several."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "SAMPLE", sample)
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 10)) / 3
    rows = [(k, (centres[k % 6] + r.normal(size=10) / 12).tolist(), int(r.integers(4)), "x", 1, "y") for k in range(700)]
    rows += [(k, [0.25] * 10, k % 4, "x", 1, "y") for k in range(700, 900)]
    rows += [(k, [-0.5] * 9, k % 3, "x", 1, "y") for k in range(900, 940)]
    rows += [(1000, None, 1, "x", 1, "y"), (1010, [0.1, None], 1, "x", 1, "y"), (1020, [float("nan")], 1, "x", 1, "y"), (1030, [float("inf")], 1, "x", 1, "y"), (1040, [0.5] * 10, None, "x", 1, "y"), (None, [0.5] * 10, 1, "x", 1, "y"), (1050, [], 1, "x", 1, "y")]
    rows += [rows[10], (20, [0.3] * 10, 2, "x", 1, "y"), (-40, [0.2] * 10, 1, "x", 1, "y")]
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), anchor_each=20)
    got = sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    expected = brute_negatives(rows, 20)
    assert len(expected) > 300
    assert got == expected


def test_bounds_hold():
    """Lookup-table scores are never further off than the residual bound."""
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(500, 30)))
    q = hard_negatives.Quantiser(x[:200])
    codes, residuals = q.code(x)
    a = x[:40]
    off = np.abs(q.estimates(q.tables(a), codes) - a @ x.T)
    assert (off <= np.linalg.norm(a, axis=1)[:, None] * residuals[None] + 1e-3).all()


def test_hard_negatives_without_rows(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 3, "", 1, "")], VECTORS)
    assert hard_negatives.mine(one).count() == 0


def brute_draw(docs, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    features = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(words(text)):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    out, fit = [], []
    for k, (i, text) in enumerate(docs):
        w = words(text)
        f = features(w)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if i is not None and len(w) >= 20:
            fit.append((-score, i, k))
    for rank, (_, _, k) in enumerate(sorted(fit)[: 25 * len(fit) // 100]):
        out[k][4] = rank + 1
    return [tuple(x) for x in out]


def some_docs(n, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Über", "漢字", "É-x", "a" * 90, "b" * 64, "c" * 65]
    return [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 19, 20, 40, 200])))) for k in range(n)]


def test_importance(spark):
    docs = [*some_docs(400), (1000, None), (1001, ""), (-7, "a b " * 30), (None, "x y " * 30)]
    target = [t for _, t in some_docs(30, 9)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = importance.digests(df, spark.createDataFrame([(t,) for t in target], "text string"))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute_draw(docs, target), key=key)


def test_selection_among_ties(spark):
    """One score for all and repeated ids: exactly k rows get the ranks 1 to k, by id."""
    rows = spark.range(1000).select((F.col("id") % 500 - 250).alias("doc_id"), F.lit(5).cast("long").alias("score"), (F.col("id") % 3).alias("row"), F.lit(True).alias("fit"))
    for k in (0, 1, 333, 1000):
        got = importance.ranked(rows, k).where("rank is not null").orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, k + 1))
        assert [r["doc_id"] for r in got] == sorted([x % 500 - 250 for x in range(1000)])[:k]


def test_selection_of_far_scores(spark):
    r = random.Random(8)
    data = [(r.choice([-1, 1]) * r.randrange(1 << r.choice([3, 20, 62])), r.randrange(-(1 << 62), 1 << 62), 0, True) for _ in range(500)]
    df = spark.createDataFrame(data, "score long, doc_id long, row long, fit boolean")
    got = importance.ranked(df, 123).where("rank is not null").orderBy("rank").select("score", "doc_id").collect()
    assert [tuple(x) for x in got] == [(s, d) for s, d, *_ in sorted(data, key=lambda x: (-x[0], x[1]))[:123]]


def test_importance_of_odd_rows(spark):
    target = spark.createDataFrame([("the quick brown fox",)], "text string")
    whole = importance.draw(odd(spark), target)
    assert whole.count() == 14
    assert importance.draw(none(spark), target).count() == 0
    assert importance.draw(odd(spark), target.where("false")).count() == 14
    kept = importance.resample(odd(spark), target, percent=100)
    assert kept.columns == [*odd(spark).columns, "rank"]
    assert {r["doc_id"] for r in kept.collect()} == {10, 11, 12, 17}


def brute_fingerprint(h):
    """``h``: signed hashes of the k-grams."""
    w, out = min(fingerprints.WINDOW, len(h)), set()
    for a in range(len(h) - w + 1 if h else 0):
        least = min(h[a : a + w])
        out.add(max(i for i in range(a, a + w) if h[i] == least))
    return sorted(out)


def odd_texts():
    r = random.Random(1)
    lengths = (16, 17, 31, 46, 47, 48, 63, 64, 65, 100, 1000, 2 * 256 + 20, 2 * 256 + 47, 3000)
    texts = ["", "a", "x" * 15, "x" * 16, "x" * 17, "abc" * 40, "x" * 600, "".join(r.choice("ab") for _ in range(900))]
    return texts + ["".join(r.choice("abcdefgé漢🙂 ") for _ in range(n)) for n in lengths]


def grams(spark, rows, text):
    """Signed order of the 49 bits of each k-gram's hash."""
    n = F.greatest(F.length(text) - (fingerprints.K - 1), F.lit(1))
    h = F.transform(F.sequence(F.lit(1), n), lambda i: F.shiftleft(F.xxhash64(F.substring(text, i, F.lit(fingerprints.K))), fingerprints.POSITION_BITS))
    return rows.withColumn("h", F.when(F.col(text) == "", F.array().cast("array<bigint>")).otherwise(h))


@pytest.mark.parametrize(("piece", "long"), [(16384, 1 << 20), (256, 1 << 20), (256, 1024)])
def test_fingerprint(spark, monkeypatch, piece, long):
    monkeypatch.setattr(fingerprints, "PIECE", piece)
    monkeypatch.setattr(fingerprints, "LONG", long)
    df = spark.createDataFrame([(t,) for t in odd_texts()], "text string")
    for r in grams(spark, fingerprints.fingerprints(df), "text").collect():
        expected = [(p, (r["h"][p] & (1 << 64) - 1) >> fingerprints.POSITION_BITS) for p in brute_fingerprint(r["h"])]
        assert [(x["position"], x["hash"]) for x in r["fingerprint"]] == expected


def test_shared_passage_is_found(spark):
    """Any passage of K + WINDOW - 1 code points that two texts share gives a common hash at its places."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(fingerprints.K + fingerprints.WINDOW - 1)
    rows = [(k, word(50 + 7 * k) + passage + word(200)) for k in range(12)] + [(99, word(400)), (None, passage)]
    prints = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    found = fingerprints.shared_passages(prints).collect()
    assert {x["doc_id"] for x in found} == set(range(1, 12))
    assert {x["doc_id"] for x in found if x["first_id"] == 0 and 50 <= x["first_position"] < 50 + len(passage)} == set(range(1, 12))
    assert all(x["position"] - x["first_position"] == 7 * (x["doc_id"] - x["first_id"]) for x in found)


def test_spliced(spark, tmp_path):
    """Splicing equals the fingerprint of the whole."""
    r = random.Random(2)
    pairs = [(a, b, m, q) for a in odd_texts() for b in odd_texts() for m in (0, 1, 46, 47, 60, len(a) - len(a) // 2) for q in (0, 10, 46, 47, len(a) // 2) if m <= len(a) and q <= len(b)]
    r.shuffle(pairs)
    f = fingerprints
    df = spark.createDataFrame(pairs[:600], "a string, b string, m int, q int").withColumn("w", F.expr("concat(substring(a, 1, m), substring(b, 1, q))")).repartition(8)
    for name, text in (("fa", "a"), ("fb", "b"), ("fw", "w")):
        df = f.fingerprints(df, text=text, name=name)
    df = df.withColumn("fj", f.fingerprint(f.joint(F.col("w"), F.col("m"), F.col("q")))).withColumn("s", f.spliced(F.col("fa"), F.col("m"), F.col("fb"), F.col("q"), F.col("fj")))
    df.select("fw", "s").write.parquet(str(tmp_path / "x"))
    assert [x for x in spark.read.parquet(str(tmp_path / "x")).collect() if x["fw"] != x["s"]] == []


@pytest.mark.parametrize("size", [1 << 24, 2000])
def test_digests_of_fingerprints(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    r = random.Random(6)
    docs = [(k * k - 50, "".join(r.choice("abcdefgé漢🙂 ") for _ in range(r.choice([0, 1, 7, 50, 200, 500])))) for k in range(90)] + [(7777, None)]
    docs += [(5, docs[4][1])]
    found = {x["doc_id"]: x for x in fingerprints.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(((k, t or "") for k, t in docs), reverse=True)
    by_text = {}
    for (k, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        x = found[k]
        assert x["n_chars"] == len(t)
        assert x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, x["fingerprint"]) == x["fingerprint"]
        own, other = ({e.split(":")[1] for e in x[c].split()} for c in ("fingerprint", "edited_fingerprint"))
        assert x["near_edited"] == (len(own & other) / len(own | other) if own | other else 1.0)
        assert 0 <= x["near_next"] <= 1


def test_next_of_repeated_ids(spark, monkeypatch):
    """A third of all rows without id: every row has a next one, and the order is one cycle."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 500)
    rows = [(None if k % 3 == 0 else k % 40, f"text {k} " * 4) for k in range(150)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    follows = {x["text"]: x["next_text"] for x in got}
    assert len(got) == len(follows) == 150
    at, seen = rows[0][1], set()
    while at not in seen:
        seen.add(at)
        at = follows[at]
    assert len(seen) == 150


def test_fingerprints_of_odd_rows(spark):
    assert fingerprints.digests(odd(spark)).count() == 14
    assert fingerprints.digests(none(spark)).count() == 0
    one = fingerprints.digests(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert (one["near_next"], one["edited_sha256"]) == (1.0, hashlib.sha256(b"abab").hexdigest())
