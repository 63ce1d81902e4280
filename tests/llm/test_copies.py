"""Near-copies, lines, embeddings, components, shards, and the pipeline."""

import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import embedding_neardup, line_dedup, ngram_jaccard, sharding
from lectern.llm.components import connected_components

from .frames import components, none, odd, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    found = {x.node: x.component for x in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert found == components(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = {}
    for k, t in rows:
        sets.setdefault(k, shingles(t))
    ids = [k for k in sets if k is not None]
    linked = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, components(ids, linked)


def near_rows(n=160, seed=2):
    """Chains of edits of a few texts of many sizes, so that similarities lie around the threshold."""
    r = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"b{base}w{r.randrange(400)}" for _ in range(r.choice([4, 5, 6, 8, 12, 30, 90, 400]))]
        for _ in range(n // 12):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(r.choice([0, 1, 1, 2])):
                k = r.randrange(len(words))
                words[k : k + 1] = r.choice([["edit"], [], [words[k], f"n{r.randrange(9)}"]]) or ["gap"]
    return rows


@pytest.mark.parametrize("few", [8, 2])
def test_ngram_jaccard(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_jaccard, "FEW", few)
    rows = near_rows()
    sets, expected = brute_classes(rows)
    found = {r.doc_id: r for r in ngram_jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.component_id for k, r in found.items()} == expected
    assert {k: r.n_shingles for k, r in found.items()} == {k: len(s) for k, s in sets.items()}


def test_sketch_keys_meet():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 300))
        s = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        other = s[r.random(len(s)) < 0.9]
        other = np.unique(np.append(other, r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 10)), dtype=np.uint64)))
        both, union = len(np.intersect1d(s, other)), len(np.union1d(s, other))
        if len(other) and 100 * both >= 80 * union:
            assert set(np.concatenate(ngram_jaccard.sketch_keys(s)).tolist()) & set(np.concatenate(ngram_jaccard.sketch_keys(other)).tolist())


def test_ngram_jaccard_odd_rows(spark):
    sets, expected = brute_classes(texts())
    rows = ngram_jaccard.classes(odd(spark)).collect()
    assert len(rows) == len(texts())
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(k, len(sets[k]), expected.get(k)) for k, _ in texts()}
    kept = ngram_jaccard.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k in {k for k, _ in texts() if k is None or not sets[k] or expected[k] == k})
    assert ngram_jaccard.classes(none(spark)).count() == 0


def brute_links(x, threshold=0.9):
    out = []
    for (a, v), (b, w) in itertools.combinations(x, 2):
        if v is None or w is None or len(v) != len(w) or not len(v) or any(c is None or not math.isfinite(c) for c in [*v, *w]) or not any(v) or not any(w):
            continue
        v_, w_ = np.array(v, float), np.array(w, float)
        if v_ @ w_ / np.linalg.norm(v_) / np.linalg.norm(w_) >= threshold:
            out.append((a, b))
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_neardup, "BLOCK", block)
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 24))
    x = [(k, (centres[k % 12] + r.normal(size=24) * 0.35).tolist()) for k in range(150)]
    x += [(200, None), (201, [0.0] * 24), (202, [float("nan")] * 24), (203, [None] * 24), (204, []), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [1e300, 2e300]), (208, [float("inf"), 1.0])]
    linked = brute_links([(k, v if k != 207 else [1.0, 2.0]) for k, v in x])
    n = {k: 0 for k, _ in x}
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    expected = components(n, linked)
    found = embedding_neardup.near_duplicates(spark.createDataFrame(x, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found} == {(k, n[k], c, k == c) for k, c in expected.items()}
    assert embedding_neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(8)
    x, y = embedding_neardup.units(r.normal(size=(200, 48))), embedding_neardup.units(r.normal(size=(200, 48)))
    errors = []
    for seed in range(8):
        turn = embedding_neardup.rotation(48, 128, seed)
        a, b = embedding_neardup.Codes.of(x, turn), embedding_neardup.Codes.of(y, turn)
        assert a.code.shape == (200, 2) and a.planes.shape == (200, 4, 2) and a.code.dtype == np.uint64
        e = b.estimates(a) - x @ y.T
        assert (np.abs(e) <= b.doubt(a)).all()
        errors.append(e.mean())
    assert abs(np.mean(errors)) < 2e-3


def test_pairs_of_blocks_by_one_matrix_product():
    """What may link takes in all that estimates and doubt let through, hardly more, in less time than they take."""
    r = np.random.default_rng(4)
    for dimensions, bits in ((64, 128), (700, 704)):
        x, turn = embedding_neardup.units(r.normal(size=(1024, dimensions))), embedding_neardup.rotation(dimensions, bits)
        y = embedding_neardup.units(x + r.normal(size=x.shape) * r.choice([0.0, 0.4, 0.5, 1.0], len(x))[:, None] / np.sqrt(dimensions) * np.linalg.norm(x, axis=1, keepdims=True))
        a, b = (embedding_neardup.Codes.of(v, turn) for v in (x, y))
        start = time.process_time()
        let = b.estimates(a) + b.doubt(a) >= 0.9
        between = time.process_time()
        found = {p for i, j in embedding_neardup.linked_pairs(x, a, y, b, 0.9) for p in zip(i.tolist(), j.tolist(), strict=True)}
        took = time.process_time() - between
        may = b.may_reach(a.levels(), 0.9)
        assert not (let & ~may).any() and may.sum() <= 1.05 * let.sum() + 5
        assert found == {*zip(*(k.tolist() for k in np.nonzero(x @ y.T >= 0.9)), strict=True)} and len(found) > 200
        assert took < (between - start) / 2


def normal(line):
    return " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split())


def edits(a, b):
    """Edit distance of two lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def near_lines(x, y):
    most = min((max(len(x), len(y)) + 5) // 10, 3)
    return abs(len(x) - len(y)) <= most and edits(x, y) <= most


def brute_lines(rows):
    """The text that is left of each row, by holding every two lines against each other."""
    kinds = sorted({(k, t) for k, t in rows if k is not None and t is not None})
    at = {}
    for k, t in kinds:
        for i, line in enumerate(t.split("\n")):
            if n := normal(line):
                at.setdefault(n, []).append((k, t, i))
    linked = [(a, b) for a, b in itertools.combinations(at, 2) if near_lines(a.split(), b.split())]
    group = components(at, linked)
    first = {}
    for line, places in at.items():
        first[group[line]] = min([*places, *([first[group[line]]] if group[line] in first else [])])
    return at, group, first, len(linked)


def held_lines(spark, rows, schema="doc_id long, text string"):
    at, group, first, n = brute_lines(rows)
    ids = {k for k, _ in rows}
    assert all(len({t for j, t in rows if j == k}) == 1 for k in ids)
    expected = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for i, x in enumerate(lines) if not normal(x) or k is None or first[group[normal(x)]] == (k, t, i)]
        some = [x for x in lines if normal(x)]
        if t is None or k is None or not some or any(normal(x) for x in kept):
            expected.append((str(k), t if t is None else "\n".join(kept)))
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, schema))
    assert sorted((str(r.doc_id), r.text) for r in found.collect()) == sorted(expected, key=str)
    return n


def line_rows(seed=1):
    """Lines of many lengths, copies with up to four edits, shared short lines, ties and very long lines."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7)))
    bases = [[word() for _ in range(n)] for n in (1, 2, 4, 5, 5, 8, 12, 16, 24, 40, 126, 127, 128, 129, 300)]
    rows = []
    for k in range(90):
        text = []
        for _ in range(r.randint(0, 4)):
            line = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                i = r.randrange(len(line) + 1)
                line[i : i + r.choice([0, 1])] = r.choice([[word()], []])
            text.append(r.choice([" ", "  ", " - ", ", "]).join(x.upper() if r.random() < 0.1 else x for x in line))
        rows.append((k, "\n".join(text)))
    return [*rows, (900, None), (901, ""), (902, "--\n\n"), (None, rows[5][1]), rows[7]]


@pytest.mark.parametrize("hot", [16, 1])
def test_lines_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    assert held_lines(spark, line_rows()) > 80


def test_lines_of_one_family(spark):
    """One large group of near copies that share most blocks, not all of them near each other."""
    r = random.Random(6)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(70):
        line = list(base)
        for i in r.sample(range(30), r.choice([1, 2, 3])):
            line[i] = f"x{r.randrange(50)}"
        rows.append((k, " ".join(line)))
    assert held_lines(spark, rows) > 30


def test_lines_odd_rows(spark):
    docs = odd(spark)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert 11 not in kept and 12 not in kept and kept.count(20) == 2 and {10, 13, 14, 15, 17, 18, None} <= set(kept)
    assert line_dedup.dedup_lines(none(spark)).count() == 0
    assert line_dedup.digests(docs).count() == len(texts())
    clash = docs.withColumnsRenamed({"lang": "row", "source": "removed", "n_tokens": "id", "ids": "n_lines"})
    assert line_dedup.dedup_lines(clash).columns == clash.columns


def test_rows_with_one_id_keep_their_own_lines(spark):
    x, y = "a line that stands here alone", "another line that is somewhere else"
    out = line_dedup.dedup_lines(spark.createDataFrame([(0, y), (1, x), (1, y), (2, x)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(0, y), (1, x)]


def test_very_long_lines(spark):
    """One word more at the start and at the end of a line; a line of one word again and again."""
    words = [f"word{k}" for k in range(40_000)]
    texts_ = [" ".join(words), " ".join(["new", *words, "end"]), " ".join(["same"] * 70_000), " ".join(["same"] * 70_003), " ".join(["same"] * 70_007)]
    assert [r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")).orderBy("doc_id").collect()] == [0, 2, 4]


def edited_lines(seed, vocabulary, lengths, number):
    """Pairs of lines ``number`` edits apart (words put in, taken out, replaced, swapped for one of the line), as many as allowed for None."""
    r = random.Random(seed)
    for n in lengths:
        line = [r.choice(vocabulary) for _ in range(n)]
        most = min((n + 5) // 10, 3) if number is None else number
        other = list(line)
        for _ in range(most):
            i = r.randrange(len(other))
            other[i : i + 1] = r.choice([[], [r.choice(vocabulary)], [r.choice(vocabulary), other[i]], [r.choice(line)]]) or ([] if len(other) > 4 else ["new"])
        yield line, other


@pytest.mark.parametrize("number", [1, 2, 3, None])
@pytest.mark.parametrize("words", [40, 4000])
@pytest.mark.parametrize("hot", [2, 16])
def test_no_link_is_lost(spark, monkeypatch, number, words, hot):
    """Every two lines within the edits allowed share a group, from four words on, whatever blocks they share; with frequent words, so that blocks are common."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    vocabulary = [f"v{k}" * (1 + k % 3) for k in range(words)]
    r = random.Random(words)
    pairs = list(edited_lines(number, vocabulary, [r.choice([4, 5, 6, 8, 11, 14, 15, 24, 25, 40, 90]) for _ in range(90)], number))
    rows = [(k, " ".join(x)) for k, x in enumerate([x for p in pairs for x in p])]
    _, group, _, n = brute_lines(rows)
    found = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = {x["doc_id"] for x in found.collect() if x["removed"]}
    first = {}
    for k, t in rows:
        first.setdefault(group[normal(t)], k)
    assert gone == {k for k, t in rows if first[group[normal(t)]] != k}
    assert n >= 60 or number in (2, 3)


def test_lines_that_share_blocks_only(spark, monkeypatch):
    """Lines with four words in common and six at random: candidates do not grow with the square of the lines."""
    tried = []
    whole = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or whole(pairs, *rest))
    counts = []
    for n in (500, 1000, 2000):
        r = random.Random(n)
        rows = [(k, " ".join(["alpha", "beta", "gamma", "delta", *[f"x{r.randrange(10**6)}" for _ in range(6)]])) for k in range(n)]
        tried.clear()
        out = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        assert out.where("size(removed) > 0").count() == 0
        counts.append(sum(tried))
    assert counts[2] <= 2000, counts


def test_one_edit_always_goes(spark):
    """Every line of five words or more within one edited word of an earlier one goes."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    rows = []
    for k in range(150):
        line = [word() for _ in range(r.randint(5, 60))]
        i = r.randrange(len(line))
        rows += [(k, " ".join(line)), (1000 + k, " ".join(line[:i] + [[], [word()], [word(), line[i]]][k % 3] + line[i + 1 :]))]
    kept = {x.doc_id for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(150))


def test_lines_of_one_family_that_do_not_link(spark, monkeypatch):
    """Lines two words from one that is not there are four from each other: what meets does not grow with the square of the lines."""
    kept, made = line_dedup.stored, []
    monkeypatch.setattr(line_dedup, "stored", lambda df, what: (out := kept(df, what), made.append(out.count()) if what in ("line-pairs", "line-links") else None)[0])
    rows = []
    for k in range(150):
        line = [f"word{i}" for i in range(300)]
        line[2 * k : 2 * k + 2] = [f"x{k}", f"y{k}"]
        rows.append((k, " ".join(line)))
    rows += [(1000 + k, f"{t} more") for k, t in rows[:10]]
    out = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("size(removed) > 0")
    assert {x.doc_id for x in out.collect()} == {1000 + k for k in range(10)}
    assert sum(made) < 1000


def test_lines_with_dotted_columns(spark):
    rows = spark.createDataFrame([(1, "one two three four five six", "x"), (2, "one two three four five six", "y")], "doc_id long, text string, `a.b` string")
    out = line_dedup.dedup_lines(rows)
    assert out.columns == ["doc_id", "text", "a.b"] and [tuple(x) for x in out.collect()] == [(1, "one two three four five six", "x")]


def test_shards(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=1 << 20, lowest=1 << 10, fanout=3)
    assert store.manifest() == (0, [])
    docs = odd(spark)
    for _ in range(3):
        store.append(docs.coalesce(1))
    assert store.append(none(spark)) == 4
    before = store.manifest()[1]
    version = store.compact()
    assert version > 4 and len(store.manifest()[1]) < len(before)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(store.read()) == rows(docs.union(docs).union(docs)) == rows(store.read(4))
    with pytest.raises(sharding.ConflictError):
        store._commit(version, [], docs.schema)
    store.vacuum()
    assert store.versions() == [version] and store.read().count() == 3 * len(texts())
    assert store.append_each(docs.withColumn("arrival", F.col("bucket") % 2), "arrival") == version + 1


def test_shards_of_other_columns(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), fanout=2)
    store.append(spark.createDataFrame([(1,)], "a long").coalesce(1))
    store.append(spark.createDataFrame([(2, "x")], "a long, b string").coalesce(1))
    store.append(spark.createDataFrame([("y",)], "b string").coalesce(1))
    expected = [(1, None), (2, "x"), (None, "y")]
    rows = lambda: sorted(map(tuple, store.read().select("a", "b").collect()), key=str)
    assert rows() == expected
    store.compact()
    store.vacuum()
    assert rows() == expected and len(store.manifest()[1]) == 1
    for clash in ("a string", "A long"):
        with pytest.raises(ValueError, match="clashes"):
            store.append(spark.createDataFrame([], clash))
    assert rows() == expected


def test_shards_of_concurrent_writers(spark, tmp_path, monkeypatch):
    store, other = (sharding.ShardStore(spark, str(tmp_path / "store"), fanout=2) for _ in range(2))
    row = lambda k: spark.createDataFrame([(k,)], "a long").coalesce(1)
    ids = lambda: sorted(r.a for r in store.read().collect())
    store.append(row(1))
    real = sharding.ShardStore._write

    def between(self, rows, by=None):
        """Another writer vacuums and appends between this one's files and its commit, twice."""
        out = real(self, rows, by)
        if self is store and len(other.versions()) < 4:
            other.vacuum(keep=9)
            other.append(row(100 + len(ids())))
        return out

    monkeypatch.setattr(sharding.ShardStore, "_write", between)
    store.append(row(2))
    assert ids() == [1, 2, 101]
    store.compact()
    assert ids() == [1, 2, 101, 103]
    store.vacuum(grace=-1)
    assert ids() == [1, 2, 101, 103] and store.unlisted() == 0


def test_shards_of_a_lost_merge(spark, tmp_path, monkeypatch):
    """Of two compactions of the same shards one is given up."""
    store, other = (sharding.ShardStore(spark, str(tmp_path / "store"), fanout=2) for _ in range(2))
    for k in range(2):
        store.append(spark.createDataFrame([(k,)], "a long").coalesce(1))
    real = sharding.ShardStore._write

    def between(self, rows, by=None):
        out = real(self, rows, by)
        if self is store:
            other.compact()
        return out

    monkeypatch.setattr(sharding.ShardStore, "_write", between)
    store.compact()
    assert sorted(r.a for r in store.read().collect()) == [0, 1] and len(store.manifest()[1]) == 1


def test_shards_arrive_in_order(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), fanout=100)
    rows = spark.createDataFrame([(k, k) for k in (10, 2, None, 1)], "a long, b int")
    assert store.append_each(rows, "b") == 4 and store.read().columns == ["a"]
    assert [sorted((r.a for r in store.read(v).collect()), key=str) for v in (1, 2, 3)] == [[None], [1, None], [1, 2, None]]
    empty = sharding.ShardStore(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        empty.read()
    assert empty.append_each(rows.where("false"), "b") == 1 and empty.read().columns == ["a"] and empty.read().count() == 0
    assert empty.compact() == 1
    empty.vacuum()


def pipeline_tables(spark, path, rows, items):
    docs = spark.createDataFrame([(k, t, lang, "s", None if t is None else len(t)) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage's rows and texts against brute force on what the stage before kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    from lectern.llm.queries import tokenizer

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    line = lambda n: [word() for _ in range(n)]
    item = line(20)
    shared, texts_ = line(12), []
    for k in range(60):
        own = [line(r.randint(8, 30)) for _ in range(r.randint(1, 4))]
        if k % 4 == 1:
            own = [list(x) for x in near]  # a near copy of the document before: one line of each changed beyond recognition
            own[0] = own[0][:-1] + [word()]
        near = own
        text = [" ".join(x) for x in own] + ([" ".join(shared)] if k % 5 == 0 else []) + ([" ".join(item[: r.choice([12, 13, 20])])] if k % 7 == 0 else [])
        texts_.append("\n".join(text))
    rows = [(k, t, "en" if k % 2 else None) for k, t in enumerate(texts_)] + [(70, None, "en"), (71, "", None), (72, "12 -- 3", "en"), (73, "x", None)]
    docs = pipeline_tables(spark, tmp_path, rows, [(1, " ".join(item))])
    rows_of = lambda df: sorted((x.doc_id, x.text) for x in df.collect())

    kept = pipeline.language(spark, docs, str(tmp_path))
    assert rows_of(kept) == sorted((k, t) for k, t, _ in rows if t and any(c.isalpha() for c in t))
    assert {x.lang for x in kept.collect()} == {"en"}

    before = rows_of(kept)
    at, group, first, _ = brute_lines(before)
    cut = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if not normal(x) or first[group[normal(x)]] == (k, t, i))) for k, t in before]
    kept = pipeline.lines(spark, kept, str(tmp_path))
    assert rows_of(kept) == sorted((k, t) for k, t in cut if normal(t)) and all(x.n_chars == len(x.text) for x in kept.collect())

    before = rows_of(kept)
    sets, classes = brute_classes(before)
    kept = pipeline.near_copies(spark, kept, str(tmp_path))
    assert rows_of(kept) == [(k, t) for k, t in before if classes[k] == k]

    before = rows_of(kept)

    def clean(text):
        w, hit = re.findall(r"[a-z0-9]+", text.lower()), set()
        for k in range(len(w) - 12):
            if any(w[k : k + 13] == item[j : j + 13] for j in range(len(item) - 12)):
                hit |= set(range(k, k + 13))
        return not hit or 20 * len(hit) < len(w)

    kept = pipeline.benchmark(spark, kept, str(tmp_path))
    assert rows_of(kept) == [(k, t) for k, t in before if clean(t)] and len(before) > len(rows_of(kept))

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    out = {x.doc_id: x for x in pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [k for k, _ in rows_of(kept)]
    for k, t in rows_of(kept):
        assert out[k].ids == library.encode(t, add_special_tokens=False).ids and out[k].n_tokens == len(out[k].ids)


def test_pipeline_without_labels_or_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, rows in (("unlabelled", [(1, "some words here", None), (2, "other words there", None), (3, "--", None)]), ("empty", [])):
        path = tmp_path / name
        docs = pipeline_tables(spark, path, rows, [(1, "one two three")] if rows else [])
        kept = docs
        for _, stage in pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(path))
            assert kept.columns == docs.columns
        assert sorted(x.doc_id for x in kept.collect()) == [k for k, t, _ in rows if t != "--"]
        assert pipeline.run(spark, str(path)).count() == len([t for _, t, _ in rows if t != "--"])


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        seen.append({r.doc_id for r in kept.collect()})
    assert seen[0] == {10, 11, 12, 16, 17, 18, 19, 20, None}
    assert 11 not in seen[1] and 10 in seen[1]
    assert 20 not in seen[3] and {10, 16, 17, 18, 19} <= seen[3]
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == seen[3] and all(len(r.ids) == r.n_tokens for r in out)
