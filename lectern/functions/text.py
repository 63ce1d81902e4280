"""String functions on columns, all planned by Catalyst (NFKC, which Spark lacks, is one Arrow UDF)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: abbreviations whose dot does not end a sentence, without that dot
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "sr", "jr", "e.g", "i.e", "etc", "vs", "no", "fig", "eq", "inc", "ltd", "pvt", "co", "dept", "gov"]

#: Stands for a protected dot while sentences are split.
_DOT = "\ue000"

#: All that ``(?U)\\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"


def literal(pattern: str) -> str:
    """The pattern that matches ``pattern`` itself."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-/])", r"\\\1", pattern)


def replaced(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def strip(c: Column) -> Column:
    """Without white space (of all Unicode) at both ends."""
    return F.trim(c, F.lit(WHITE))


def stripped(c: Column) -> Column:
    """``strip`` of texts that are seldom white at their ends, which are looked at first; ``c`` may be computed more than once."""
    white = lambda x: F.instr(F.lit(WHITE), x) > 0
    return F.when(white(F.substring(c, 1, 1)) | white(F.substring(c, -1, 1)), strip(c)).otherwise(c)


def lines_of(c: Column) -> Column:
    """The lines of a text, at every Unicode line end."""
    return F.split(replaced(F.coalesce(c, F.lit("")), f"({LINE_END})\\z", ""), LINE_END, -1)


def normalize_ws(c: Column) -> Column:
    """Runs of white space to one space, none at the ends; null to ''."""
    runs = lambda x: F.when(x.contains("  ") | x.rlike(r"[\t\n\x0B\f\r\x85\xA0\u1680-\u3000]"), replaced(x, r"(?U)[\s&&[^ ]]\s*| \s+", " ")).otherwise(x)
    return F.trim(let(F.coalesce(c, F.lit("")), runs))


def normalize_lines(c: Column) -> Column:
    """``normalize_ws`` line by line."""
    return strip(F.array_join(F.transform(lines_of(c), normalize_ws), "\n"))


def strip_control_chars(c: Column) -> Column:
    """Without the characters U+0000-U+001F and U+007F, line ends and tabs included."""
    return replaced(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", "")


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    return F.pandas_udf(_nfkc, "string")(c)


def norm_unicode(c: Column, form: Callable[[Column], Column] = nfkc) -> Column:
    """NFKC; no soft hyphens; straight quotes; hyphens for dashes. Null to ''."""
    odd = "\u201c\u201d\u2019\u2018\u2013\u2014\u00ad"
    return let(form(F.coalesce(c, F.lit(""))), lambda x: F.when(x.rlike("[\u00ad\u2013-\u201d]"), F.translate(x, odd, "\"\"''--")).otherwise(x))


def fix_decimal_spacing(c: Column) -> Column:
    """``3 . 14`` to ``3.14``."""
    return replaced(F.coalesce(c, F.lit("")), r"(?U)(\d)\s*\.\s*(\d)", "$1.$2")


def remove_dot_leaders(c: Column) -> Column:
    """Five or more dots in a row to a space; then ``normalize_ws``."""
    return normalize_ws(replaced(F.coalesce(c, F.lit("")), r"\.\.\.\.\.\.*", " "))


def normalize_decimal_commas(c: Column) -> Column:
    return replaced(c, r"(?U),(?<=\d,)(?=\d)", ".")


def normalize_numeric_ranges(c: Column) -> Column:
    """A dash between digits to ' to '."""
    return let(c, lambda x: F.when(x.contains("-") | x.contains("\u2013") | x.contains("\u2014"), replaced(x, "(?U)(?<=\\d)\\s*[-\u2013\u2014]\\s*(?=\\d)", " to ")).otherwise(x))


def normalize_dots(c: Column) -> Column:
    """Dots between digits are spoken 'point', runs of dots 'dot' each."""
    c = replaced(c, r"(?U)\.(?<=\d\.)(?=\d)", " point ")
    return normalize_ws(replaced(c, r"\.(?:(?<=\.\.)|(?=\.))", " dot "))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def in_matches(c: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with ``change`` applied to each match of the pattern."""

    def changed(x: Column) -> Column:
        found = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), change)
        return F.array_join(F.zip_with(F.split(x, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(c, lambda x: F.when(x.rlike(pattern), changed(x)).otherwise(x))


def normalize_slash_context(c: Column) -> Column:
    """'slash' in addresses and paths, 'per' between words, 'upon' between digits."""
    spoken = lambda m: F.replace(m, F.lit("/"), F.lit(" slash "))

    def changed(c: Column) -> Column:
        c = in_matches(c, r"(?:https?://|www\.)\S+", spoken)
        c = in_matches(c, r"[A-Za-z]:\\\S+|/[A-Za-z0-9_\-/.]+", spoken)
        c = replaced(c, r"(?<=[A-Za-z])\s*/\s*(?=[A-Za-z]+\b)", " per ")
        return replaced(c, r"(?U)(?<=\d)\s*/\s*(?=\d)", " upon ")

    return let(F.coalesce(c, F.lit("")), lambda x: F.when(x.contains("/"), changed(x)).otherwise(x))


def plural(unit: str) -> str:
    """A unit's plural: of its last word, unless that ends with s."""
    if unit.endswith("s"):
        return unit
    if re.search(r"[^aeiou]y$", unit):
        return unit[:-1] + "ies"
    return unit + "s"


def is_plural_number(number: Column) -> Column:
    """Everything but 1 takes the plural, what is no number too."""
    return F.coalesce(F.abs(number.try_cast("double") - 1) > 1e-12, F.lit(True))


# fixed values: glyphs of units, spoken forms of symbols, and names of units
GLYPHS = {"㎜": "mm", "㎝": "cm", "㎞": "km", "㎡": "m2", "㎟": "mm2", "㎠": "cm2", "㎢": "km2", "㎥": "m3", "㎣": "mm3", "㎤": "cm3", "²": "2", "³": "3"}
SYMBOLS = {"°C": " degree celsius ", "°c": " degree celsius ", "°F": " degree fahrenheit ", "°f": " degree fahrenheit ", "μm": " micrometer ", "ppm": " parts per million ", "ppb": " parts per billion "}
WIDE_SYMBOLS = (
    {"@": " at the rate ", "&": " and ", "%": " percent ", "₹": " rupees ", "$": " dollars "}
    | SYMBOLS
    | {"mg/l": "milligrams per liter", "kg/l": "kilograms per liter", "°": " degree ", "rad": " radian ", "g/mol": "grams/mole"}
)
LENGTHS = {"mm": "millimetre", "cm": "centimetre", "m": "metre", "km": "kilometre"}
MASSES = {"mg": "milligram", "g": "gram", "kg": "kilogram"}
LIQUIDS = {"ml": "millilitre", "l": "litre"}
TIMES = {"sec": "second", "s": "second", "min": "minute", "hr": "hour", "h": "hour", "yr": "year", "y": "year"}


def _units(c: Column, names: dict[str, str], power: str = "") -> Column:
    """Numbers with one of the units (to ``power``) to the number and the unit's name."""
    pattern = rf"(?iU)(\d+(?:\.\d+)?)\s*({'|'.join(sorted(names, key=len, reverse=True))})" + (rf"\s*(?:\^?\s*{power})" if power else "") + r"\b"
    one = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    many = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, plural(v))])

    def change(m: Column) -> Column:
        number, unit = F.regexp_extract(m, pattern, 1), F.lower(F.regexp_extract(m, pattern, 2))
        return F.concat(number, F.lit(" "), F.when(is_plural_number(number), many[unit]).otherwise(one[unit]))

    return in_matches(c, pattern, change)


def normalize_units(c: Column, profile: str = "main") -> Column:
    """Symbols and units after numbers in words, singular for 1.

    ``main`` is the live form; ``step3`` speaks more symbols, keeps masses in
    the plural, and knows units of time.
    """
    c = normalize_decimal_commas(F.coalesce(c, F.lit("")))
    spoken = GLYPHS | (WIDE_SYMBOLS if profile == "step3" else SYMBOLS)
    one, many = {a[0] for a in spoken if not a[0].isascii() or len(a) == 1}, [a for a in spoken if a[0].isascii() and len(a) > 1]
    far = [a for a in one if a > "\xff"]
    there = f"[{''.join(map(literal, sorted(one.difference(far))))}{min(far)}-{max(far)}]"

    def said(x: Column) -> Column:
        for a, b in spoken.items():
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    c = let(c, lambda x: F.when(reduce(or_, [x.contains(a) for a in many], x.rlike(there)), said(x)).otherwise(x))
    return normalize_ws(let(c, lambda x: F.when(x.rlike(r"(?U)\d"), _numbers(x, profile)).otherwise(x if profile == "step3" else _moles(x))))


def _moles(c: Column) -> Column:
    return let(c, lambda x: F.when(x.contains("/"), replaced(x, r"(?iU)\bmol\s*/\s*l\b", " mole per litre ")).otherwise(x))


def _numbers(c: Column, profile: str) -> Column:
    """Powers of lengths first, where there are any; then all other units in one pass, since none is the beginning of another's match."""
    powers = "|".join(sorted(LENGTHS, key=len, reverse=True))

    def powered(x: Column) -> Column:
        out = x
        for prefix, power in (("cubic ", "3"), ("square ", "2")):
            out = _units(out, {k: prefix + v for k, v in LENGTHS.items()}, power)
        return F.when(x.rlike(rf"(?iU)\d\s*(?:{powers})\s*\^?\s*[23]\b"), out).otherwise(x)

    wide = profile == "step3"
    masses = {k: plural(v) for k, v in MASSES.items()} if wide else MASSES
    c = _units(let(c, powered), LENGTHS | masses | LIQUIDS | (TIMES if wide else {}))
    return c if wide else _moles(c)


def split_sentences(c: Column) -> Column:
    """Sentences as an array: cut after . ? ! and white space, not after abbreviations."""
    # the dot is looked for first; in i.e.g. the e belongs to i.e
    names = "|".join((r"(?<!\bi\.)" if a == "e.g" else "") + literal(a) for a in ABBREVIATIONS)
    c = replaced(F.coalesce(c, F.lit("")), rf"(?iU)\.(?<=\b(?:{names})\.)", _DOT)
    parts = F.transform(F.split(c, r"(?U)(?<=[.?!])\s+", -1), lambda s: normalize_ws(F.replace(s, F.lit(_DOT), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def clean_for_tts(c: Column) -> Column:
    """Tags to spaces, then ``normalize_ws``."""
    return normalize_ws(replaced(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))


def escape_ssml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def paragraphs(c: Column) -> Column:
    """Non-blank stretches between blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\n\s*\n", -1), strip), lambda p: p != "")


def sentences_ssml(c: Column) -> Column:
    return F.array_join(F.transform(split_sentences(c), escape_ssml), " ")


def block_ssml(kind: Column, text: Column) -> Column:
    """A block with pauses; headings are emphasised."""
    inner = sentences_ssml(text)
    heading = F.concat(F.lit('<break time="600ms"/><emphasis level="moderate">'), inner, F.lit('</emphasis><break time="400ms"/>'))
    return F.when(kind == "heading", heading).otherwise(F.concat(inner, F.lit('<break time="350ms"/>')))


def text_ssml(c: Column) -> Column:
    """A text's paragraphs as one spoken document."""
    parts = F.transform(paragraphs(c), lambda p: F.concat(sentences_ssml(p), F.lit('<break time="350ms"/>')))
    return F.concat(F.lit("<speak>\n"), F.array_join(parts, "\n"), F.lit("\n</speak>"))


def selection_ssml(c: Column, break_ms: int = 250) -> Column:
    """A selected passage as spoken document: blank lines to pauses, quotes escaped, too."""
    c = escape_ssml(c)
    c = F.replace(F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    c = replaced(c, r"(?U)(?:\n\s*\n)+", f'</s><break time="{break_ms}ms"/><s>')
    return F.concat(F.lit("<speak><s>"), F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("</s></speak>"))


def latex_spoken(c: Column) -> Column:
    c = F.translate(strip(F.coalesce(c, F.lit(""))), "$", "")
    return normalize_ws(F.replace(c, F.lit("="), F.lit(" equals ")))


def spoken_ssml(c: Column) -> Column:
    return F.concat(F.lit("<speak>"), escape_ssml(normalize_ws(c)), F.lit("</speak>"))


def apply_dictionary(c: Column, rules: Iterable[dict]) -> Column:
    """Apply rules in order: ``find``, ``replace``, ``match_type`` (exact, word, regex), ``case_sensitive``, ``enabled``.

    Rules that find nothing ('') are skipped. References in replacements may be
    written ``\\1``.
    """
    for rule in rules:
        find, kind = rule.get("find", ""), rule.get("match_type", "exact")
        if not rule.get("enabled", True) or not find:
            continue
        pattern = find if kind == "regex" else literal(find)
        if kind == "word":
            pattern = rf"\b{pattern}\b"
        by = re.sub(r"\\(\d)", r"$\1", rule.get("replace", "").replace("$", r"\$"))
        c = replaced(c, ("(?U)" if rule.get("case_sensitive") else "(?iuU)") + pattern, by)
    return c


# fixed values: the dictionary rules that are on from the start
DEFAULT_RULES = [{"find": "BIS", "replace": "B I S", "match_type": "word", "case_sensitive": False, "enabled": True}, {"find": "IEC", "replace": "I E C", "match_type": "word", "case_sensitive": False, "enabled": True}]


def normalize_selection(c: Column, *, fix_hyphens: bool = True, collapse: bool = True, punctuation: bool = True) -> Column:
    """A selected passage for speech: rejoined words, single spaces, tidy punctuation."""
    if fix_hyphens:
        c = replaced(c, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    if collapse:
        c = replaced(replaced(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    if punctuation:
        c = F.replace(c, F.lit("…"), F.lit("..."))
        c = replaced(replaced(c, r"(?U)\s+([,.;:!?])", "$1"), r"([,.;:!?])([A-Za-z])", "$1 $2")
    return strip(c)


def slug(c: Column, longest: int = 60) -> Column:
    """Lower-case a-z, digits and underscores; 'section' if empty."""
    c = replaced(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^a-z0-9\s_]+", "")
    c = F.substring(F.trim(replaced(c, r"(?U)\s+", "_"), F.lit("_")), 1, longest)
    return let(c, lambda x: F.when(x == "", "section").otherwise(x))


def file_slug(c: Column, longest: int = 70) -> Column:
    c = F.trim(replaced(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(c == "", "section").otherwise(F.substring(c, 1, longest))


def safe_name(c: Column, longest: int = 80) -> Column:
    """Unicode letters, numbers, '_' and '-'; spaces as '_'."""
    c = F.substring(replaced(F.translate(strip(F.coalesce(c, F.lit(""))), " ", "_"), r"[^\p{L}\p{N}_-]", ""), 1, longest)
    return F.when(c == "", "section").otherwise(c)


def word_count(c: Column) -> Column:
    return let(normalize_ws(c), lambda n: F.when(n == "", 0).otherwise(F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1))
