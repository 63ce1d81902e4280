"""Text functions: literal rows with expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import filters as f
from lectern.functions import text as t
from lectern.functions import tokens as k
from lectern.operators.blocks import reflow
from lectern.operators.chunks import packed, text_chunks
from lectern.plans import normalized_text, wide_text


def one(spark, make, *values):
    """``make`` applied to columns of one row."""
    names = [f"c{n}" for n in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(make(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(
    ("make", "text", "expected"),
    [
        (t.normalize_ws, " a \n b ", "a b"),
        (t.normalize_ws, None, ""),
        (t.strip_control_chars, "a\x00\tb\x7f", "ab"),
        (t.norm_unicode, "ﬁn­ “x” – ²", 'fin "x" - 2'),
        (t.fix_decimal_spacing, "3 . 14", "3.14"),
        (t.remove_dot_leaders, "Foreword........iv", "Foreword iv"),
        (t.normalize_decimal_commas, "1,2,3 a,b", "1.2.3 a,b"),
        (t.normalize_numeric_ranges, "3 – 4, 5-6", "3 to 4, 5 to 6"),
        (t.normalize_dots, "1.2.3 and ..", "1 point 2 point 3 and dot dot"),
        (t.normalize_slash_context, "a / b", "a per b"),
        (t.normalize_slash_context, "kg/m", "kg slash m"),
        (t.normalize_slash_context, "3 / 4", "3 upon 4"),
        (t.normalize_units, "a 250 ml vessel is used", "a 250 millilitres vessel is used"),
        (t.normalize_units, "0,261 mg/ml × 160 ml = 41,76 mg (1,305 mmol)", "0.261 milligrams/ml × 160 millilitres = 41.76 milligrams (1.305 mmol)"),
        (t.normalize_units, "28 °C and a relative humidity of 100 %", "28 degree celsius and a relative humidity of 100 %"),
        (t.normalize_units, "1 g, 22 g, 1.0 kg, 2.1 cm^3, 4 m2, 1 mol/l", "1 gram, 22 grams, 1.0 kilogram, 2.1 cubic centimetres, 4 square metres, 1 mole per litre"),
        (t.clean_for_tts, "<p>a <b>b</b></p>", "a b"),
        (t.latex_spoken, "$$a=b$$", "a equals b"),
        (t.spoken_ssml, "", "<speak></speak>"),
        (t.selection_ssml, "a\n\nb \"c\"\nd", '<speak><s>a</s><break time="250ms"/><s>b &quot;c&quot; d</s></speak>'),
        (t.normalize_selection, "exam-\n ple  a ,b", "example a, b"),
        (t.slug, "1 Scope & More!", "1_scope_more"),
        (t.slug, "!", "section"),
        (t.safe_name, "a b/ç", "a_bç"),
        (reflow, "text a)\nmore\n\n\n1.\nitem", "text\na) more\n\n1. item"),
        (reflow, "the first\nline goes on\nand on", "the first line goes on\nand on"),
        (normalized_text, "Contents.......4\npage 3\n\n\n\n5 ml", "Contents 4\n\n5 millilitres"),
    ],
)
def test_text(spark, make, text, expected):
    assert one(spark, make, text) == expected


def test_wide_text(spark):
    assert one(spark, wide_text, "10 - 20 kg at 5 % & more") == "10 to 20 kilograms at 5 percent and more"


def test_plural():
    assert [t.plural(x) for x in ("cubic metre", "milligrams", "century", "day")] == ["cubic metres", "milligrams", "centuries", "days"]


def test_sentences(spark):
    assert one(spark, t.split_sentences, "See e.g. Fig. 3.2 there. Is it? Yes!  No. 4 ends.") == ["See e.g. Fig. 3.2 there.", "Is it?", "Yes!", "No. 4 ends."]
    assert one(spark, t.split_sentences, None) == []


def test_ssml(spark):
    assert one(spark, t.text_ssml, "A & b. C.\n\nD") == '<speak>\nA &amp; b. C.<break time="350ms"/>\nD<break time="350ms"/>\n</speak>'
    assert one(spark, t.block_ssml, "heading", "Top").startswith('<break time="600ms"/><emphasis level="moderate">Top<')


def test_dictionary(spark):
    rules = [*t.DEFAULT_RULES, {"find": "a.b", "replace": "x"}, {"find": r"(\d+)x", "replace": r"\1 times", "match_type": "regex"}, {"find": "", "replace": "!"}]
    assert one(spark, lambda c: t.apply_dictionary(c, rules), "bis BISON a.b 3x $") == "B I S BISON x 3 times $"


@pytest.mark.parametrize(
    ("test", "yes", "no"),
    [
        (f.page_marker, ["12", "xiv", "Page 3", "3 of 7", "- 4 -", "12 BS", "BIS 3", "page"], ["hello", "12345", "3 apples"]),
        (f.boilerplate, ["All Rights Reserved."], ["rights"]),
        (f.stamp_text, ["Supplied by X"], ["supply"]),
        (f.section_heading, ["1 Scope", "2.1 Terms", "Annex B more", "Bibliography", "1\nScope x"], ["Scope", "1 Scope\nfoo"]),
        (f.toc_entry, ["Scope 4", "a.....b", "Foreword iv"], ["Scope", "text."]),
        (f.toc_index, ["1.2", "1.2.3"], ["1", "a"]),
        (f.topic_heading, ["SCOPE", "Terms And Names"], ["an ordinary line of words.", "ab"]),
        (f.formula_text, ["(12)", "x = 3", "sin of x", "(1+2)3"], ["plain words"]),
        (f.good_latex, ["a=b"], ["a", "??x"]),
        (f.ends_sentence, ["a. ", "b:"], ["a"]),
    ],
)
def test_predicates(spark, test, yes, no):
    for text in yes:
        assert one(spark, test, text), text
    for text in no:
        assert not one(spark, test, text), text


def test_outline_heading(spark):
    assert tuple(one(spark, f.outline_heading, "Annex b - Title:")) == ("annex", "annex_B", "Annex B Title")
    assert tuple(one(spark, f.outline_heading, "Normative references")) == ("named", "normative_references", "Normative references")
    assert tuple(one(spark, f.outline_heading, "6.2 Findings -")) == ("num", "6.2", "Findings")
    assert one(spark, f.outline_heading, "380 Findings") is None
    assert one(spark, lambda c: f.outline_heading(c, strict=True), "6.2 Findings of a mg") is None


def test_tokens(spark):
    text = "x [[TABLE|T1|Table 1]] y [[FORMULA|F1|]] [FORMULA:F2]"
    assert [tuple(r) for r in one(spark, k.table_tokens, text)] == [("T1", "Table 1")]
    told = F.create_map(F.lit("F1"), F.lit("a"))
    assert one(spark, lambda c: k.narrate_formulas(c, told), text) == "x [[TABLE|T1|Table 1]] y  Formula F1: a   Formula F2. "
    assert one(spark, lambda c: k.narrate_formulas(c, F.lit(None).cast("map<string,string>")), text) == text
    held = one(spark, k.held_tables, text)
    assert held == ["[[TABLE|T1|Table 1]]"]
    assert one(spark, lambda c: k.restored(k.marked_tables(c), k.held_tables(c)), text) == text
    assert one(spark, k.canonical_table_id, "t010", None) == "T10"
    assert one(spark, k.canonical_table_id, "x", "TABLE 3 a") == "T3"
    assert one(spark, k.canonical_table_id, " ", None) is None


def test_chunks(spark):
    assert one(spark, lambda c: text_chunks(c, 10), "aaaa\n\nbbbb\n\n" + "c" * 30 + "\n\n<i> </i>") == ["aaaa", "bbbb", "c" * 30]
    assert one(spark, lambda c: text_chunks(c, 100), "") == []
    assert one(spark, lambda c: packed(F.array(c, c), 3), "ab") == ["ab", "ab"]


def test_units_in_one_pass(spark):
    """All kinds of units at once give what one kind after another gives."""
    import random

    r = random.Random(3)
    parts = ["5", "1", "1.0", "2.5", "2", "3", "0", "10,5", " ", "  ", "m", "mm", "km", "M", "kg", "g", "mg", "l", "ML", "s", "min", "hr", "y", "^", "2", "3", "m2", "cm3", "m^3", "x", ".", "-", "mol / l", "½", "٣"]
    rows = spark.createDataFrame([("".join(r.choice(parts) for _ in range(r.choice([3, 5, 9]))),) for _ in range(3000)], "text string")
    for profile in ("main", "step3"):
        masses = {k: t.plural(v) for k, v in t.MASSES.items()} if profile == "step3" else t.MASSES
        c = F.col("text")
        for names, prefix, power in [(t.LENGTHS, "cubic ", "3"), (t.LENGTHS, "square ", "2"), (t.LENGTHS, "", ""), (masses, "", ""), (t.LIQUIDS, "", ""), *([(t.TIMES, "", "")] if profile == "step3" else [])]:
            c = t._units(c, {k: prefix + v for k, v in names.items()}, power)
        c = c if profile == "step3" else t._moles(c)
        assert rows.where(t._numbers(F.col("text"), profile) != c).collect() == []


def test_white_space_is_what_patterns_take_for_it(spark):
    """Trimmed characters are those of Java's ``(?U)\\s``, one by one, and no pattern runs over the text for them."""
    rows = spark.createDataFrame([(chr(k),) for k in [*range(1, 0x3400), *range(0xF000, 0x10000)]], "c string")
    white = rows.where(F.col("c").rlike(r"(?U)^\s\z")).collect()
    assert sorted(r.c for r in white) == sorted(t.WHITE)
    plan = rows.select(t.strip(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "trim" in plan


def test_guards_change_nothing(spark):
    """Texts that lack what a rule looks for pass its pattern by; all others come out as before."""
    texts = {"i.e.g. no. e.g. x": ["i.e.g.", "no. e.g. x"], "See no. 5 etc. Next. End": ["See no. 5 etc. Next.", "End"]}
    df = spark.createDataFrame([(k,) for k in texts], "s string")
    assert {r.s: r.p for r in df.select("s", t.split_sentences(F.col("s")).alias("p")).collect()} == texts
    df = spark.createDataFrame([("1 2\u20033  4",), ("1-2 a/b 3/4 \u338f 5 mol/l",), ("12  of   34",), ("12 of 34 of 56",)], "s string")
    out = df.select(t.normalize_ws(F.col("s")), t.normalize_slash_context(t.normalize_numeric_ranges(F.col("s"))), f.page_marker(F.col("s"))).collect()
    assert [r[0] for r in out] == ["1 2 3 4", "1-2 a/b 3/4 \u338f 5 mol/l", "12 of 34", "12 of 34 of 56"]
    assert out[1][1] == "1 to 2 a slash b 3 slash 4 \u338f 5 mol slash l" and [r[2] for r in out] == [False, False, True, False]
    plan = df.select(f.boilerplate(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan
