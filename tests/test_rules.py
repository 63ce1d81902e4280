"""Rules by automaton against the rules one after another, and recognisers asked only where needed."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import rules as sets
from lectern.functions import text as t
from lectern.functions.rules import RuleSet, folded, needle
from lectern.operators import lines, recognise, rules


def one_by_one(found, text):
    for find, replace, kind, case in found:
        pattern = find if kind == "regex" else re.escape(find)
        pattern = rf"\b{pattern}\b" if kind == "word" else pattern
        text = re.sub(pattern, lambda m, replace=replace: re.sub(r"\\(\d)", lambda g: m.group(int(g[1])) or "", replace), text, flags=0 if case else re.IGNORECASE)
    return text


LETTERS = st.text("abcA K\u212aſsıİß", min_size=1, max_size=3)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(LETTERS, st.text("abcs ", max_size=4), st.sampled_from(["exact", "word"]), st.booleans()), max_size=12), st.text("abcABCkK\u212aSſsıiİIß ", max_size=40))
def test_rules_in_order(found, text):
    """What one rule puts in or takes out decides what later ones find."""
    assert RuleSet(found).replaced(text) == one_by_one(found, text)


def test_patterns_in_order():
    found = [(r"(\w+)-(\w+)", r"\2 \1", "regex", False), ("cat", "a-b", "word", False), (r"a+", "", "regex", True), (r"(x)?y", r"[\1]", "regex", False), ("(", "", "regex", False), ("", "never", "exact", False), (r"b{0,1}c", "B", "regex", False), (r"(?:dog|cow)s", "pets", "regex", False), (r"^line", "LINE", "regex", True)]
    for text in ("one-two cat", "CAT xy y", "bc c dogs cows", "line of cat aaa", ""):
        assert RuleSet(found).replaced(text) == one_by_one([r for r in found if r[0] not in ("(", "")], text)
    assert RuleSet(found).replaced(None) is None


def test_needles():
    for pattern, text, expected in ((r"for use of \d+ only", "FOR USE OF 7 ONLY", "for use of "), (r"(?:ab|cd)", "ab", ""), (r"x(yz)+w", "xyzyzw", "yz"), (r"\bpage\b", "Page", "page"), (r"a*bcd?", "bc", "bc"), ("(?x) a b", "ab", "")):
        assert re.search(pattern, text, re.IGNORECASE) and needle(pattern) == expected and expected in folded(text)


def test_ten_thousand_rules(spark):
    """One scan of the text for 10,000 rules: the outcome is the ordered fold's, and few patterns are ever compiled."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    found = [(word(), word(), r.choice(["word", "exact"]), r.random() < 0.5) for _ in range(10_000)]
    texts = [" ".join(r.choice([word(), found[r.randrange(10_000)][0].upper()]) for _ in range(60)) for _ in range(6)]
    own = RuleSet(found)
    assert [own.replaced(x) for x in texts] == [one_by_one(found, x) for x in texts]
    assert len(own._compiled) < 1500
    table = rules.rule_table(spark, [{"find": f, "replace": b, "match_type": k, "case_sensitive": c} for f, b, k, c in found])
    df = spark.createDataFrame([(k, x, "s") for k, x in enumerate([*texts, None, ""])], "doc_id long, text string, find string")
    out = rules.replace_by_rules(df, table)
    assert out.columns == df.columns
    assert [x["text"] for x in out.orderBy("doc_id").collect()] == [*[own.replaced(x) for x in texts], None, ""]


def test_blocks_of_rules_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(rules, "BLOCK", 2)
    found = [{"find": "a", "replace": "b"}, {"find": "b", "replace": "c"}, {"find": "c", "replace": "d", "enabled": False}, {"find": "C", "replace": "e"}, {"find": "e", "replace": "f", "case_sensitive": True}, {"find": "", "replace": "z"}]
    df = spark.createDataFrame([("abcE",)], "text string")
    assert rules.replace_by_rules(df, rules.rule_table(spark, found)).first()["text"] == "fffE"
    assert rules.replace_by_rules(df, rules.rule_table(spark, [])).first()["text"] == "abcE"


def test_same_as_the_columns(spark):
    """On ASCII texts the table of rules does what ``apply_dictionary`` does."""
    found = [*t.DEFAULT_RULES, {"find": "kg", "replace": "kilo", "match_type": "word"}, {"find": r"(\d+)\s*x\s*(\d+)", "replace": r"\1 by \2 $", "match_type": "regex"}, {"find": "kilo", "replace": "K", "case_sensitive": True}]
    df = spark.createDataFrame([("IEC 5 kg, iec-5KG 3x4 and 10 X 20 Kilo kilo BIS",), (None,), ("",)], "text string")
    assert rules.replace_by_rules(df, rules.rule_table(spark, found)).collect() == df.select(t.apply_dictionary(F.col("text"), found).alias("text")).collect()


def test_drop_by_rules(spark):
    own = {"exact": ["drop me", "a.b"], "regex": ["(", r"^a\d", r"^(x)\1$", r"supplied by \w+ under"]}
    df = spark.createDataFrame([(x,) for x in (" drop me ", "a.b", "axb", "a1", "xx", "xy", "Supplied by ME under", "supplied by", "", " ", None, "Drop me")], "text string")
    table = rules.rule_table(spark, [*[{"find": x} for x in own["exact"]], *[{"find": x, "match_type": "regex", "case_sensitive": True} for x in own["regex"]], {"find": "axb", "enabled": False}])
    found = [r["text"] for r in rules.drop_by_rules(df, table).collect()]
    assert sorted(map(str, found)) == sorted(map(str, [r["text"] for r in lines.remove_by_rules(df, own).collect()]))
    assert "supplied by" in found and "Supplied by ME under" in found


def test_recognisers_are_asked_where_needed(spark, tmp_path):
    """Equal contents once, known ones never, later recognisers for what earlier ones failed on; a failing one loses no row."""
    sc = spark.sparkContext
    asked, made = {n: sc.accumulator(0) for n in ("first", "broken", "second", "unmade")}, sc.accumulator(0)

    def maker(name, answer):
        def make():
            made.add(1)

            def run(contents):
                asked[name].add(len(contents))
                return [answer(c) for c in contents]

            return run

        return make

    def unmade():
        raise RuntimeError("no model")

    def broken(c):
        if c == b"poison":
            raise ValueError("bad image")
        return "??"

    providers = [("first", maker("first", lambda c: "x = 1" if c.startswith(b"good") else "?")), ("unmade", unmade), ("broken", maker("broken", broken)), ("second", maker("second", lambda c: c.decode() if c.startswith(b"later") else None))]
    contents = [b"good 1", b"good 2", b"good 1", b"later 1", b"later 1", b"poison", b"bad", None]
    rows = spark.createDataFrame([(k, None if c is None else bytearray(c), "kept") for k, c in enumerate(contents)], "k long, image binary, error_code string").coalesce(1)
    out = {r["k"]: r for r in recognise.recognised(rows, providers, str(tmp_path / "cache")).collect()}
    assert [out[k]["latex"] for k in range(8)] == ["x = 1", "x = 1", "x = 1", "later 1", "later 1", None, None, None]
    assert [out[k]["provider"] for k in range(5)] == ["first", "first", "first", "second", "second"]
    assert "bad image" in out[5]["error"] and "no model" in out[6]["error"] and out[7]["error"] == "no content" and out[0]["error"] is None
    assert asked["first"].value == 5 and asked["second"].value == 3
    before = {n: a.value for n, a in asked.items()}
    again = {r["k"]: r for r in recognise.recognised(rows, providers, str(tmp_path / "cache")).collect()}
    assert {k: r["latex"] for k, r in again.items()} == {k: r["latex"] for k, r in out.items()}
    assert asked["first"].value - before["first"] == 2  # only what failed


def test_recogniser_of_many_rows_is_made_once(spark):
    """Batches of a worker share one recogniser; a wrong number of answers spoils no row."""
    made = spark.sparkContext.accumulator(0)

    def make():
        made.add(1)
        return lambda contents: ["abc"] * (len(contents) if len(contents) < 3 else 1)

    name = f"counted-{random.random()}"
    rows = spark.range(500).select("id", F.col("id").cast("string").cast("binary").alias("image"))
    out = recognise.with_readings(rows, recognise.readings(rows, [(name, make)], batch=50))
    assert out.where("latex = 'abc' and error is null").count() == 500
    assert 1 <= made.value <= 8


def test_texts_come_in_small_batches(spark):
    """Python holds 1000 texts at a time, not Spark's 10000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        df = spark.createDataFrame([("ab",)], "text string")
        out = rules.replace_by_rules(df, rules.rule_table(spark, [{"find": "a", "replace": "c"}]))
        assert spark.conf.get(key) == "1000" and [r.text for r in out.collect()] == ["cb"]
    finally:
        spark.conf.set(key, kept)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("abc-\u0301", min_size=1, max_size=3), st.text("abc1- ", max_size=3), st.sampled_from(["exact", "exact", "word"]), st.sampled_from([True, True, False])), max_size=12), st.lists(st.text("abcABC-1é\u0301 .", max_size=12), max_size=8), st.sampled_from([0, 2, 64]), st.sampled_from([0, 500, 10_000]), st.sampled_from([1, 2, 1000]))
def test_pieces_in_order(found, texts, short, kept, many):
    """Pieces on their own, short and long, kept and dropped: the outcome is that of the rules one after another on the whole text."""
    before = sets.SHORT, sets.KEPT, sets.MANY
    sets.SHORT, sets.KEPT, sets.MANY = short, kept, many
    try:
        own = RuleSet(found)
        for text in [*texts, " ".join(texts), "".join(texts)] * 2:
            assert own.replaced(text) == one_by_one(found, text)
    finally:
        sets.SHORT, sets.KEPT, sets.MANY = before


def test_words_that_come_again_are_looked_at_once():
    found = [("ab", "b1", "exact", True), ("b", "c", "exact", True), ("c", "", "word", False)]
    own, asked = RuleSet(found), []
    plainly = own._in_order
    own._in_order = lambda text: asked.append(text) or plainly(text)
    text = "abc, abc. c\nabc d " * 50
    assert own.replaced(text) == one_by_one(found, text)
    assert sorted(asked) == ["abc", "c", "d"]
