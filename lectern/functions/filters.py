"""Predicates on lines, spans, headings and formulas."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import let, literal, normalize_ws, replaced, strip

# fixed values: stamps, boilerplate, headings, units
STAMPS = ["supplied by", "under the license", "license from bis", "valid upto", "book supply bureau", "csir-national physical laboratory"]
STAMP_PATTERNS = [r"supplied by .*? under the license", "under the license from bis", "csir-?national physical laboratory", "valid upto", r"\(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\)"]
BOILERPLATE = ["for bis use only", "copyright protected document", "all rights reserved", "© iso", "published in switzerland"]
PAGE_MARKERS = [r"\d{1,4}", "[ivxlcdm]{1,8}", r"page\s*\d{1,4}", r"\d{1,4}\s*/\s*\d{1,4}", r"\d{1,4}\s+of\s+\d{1,4}", r"-\s*\d{1,4}\s*-", r"\d{1,4}\s*[|\-]\s*\d{1,4}", r"\d{1,4}\s*(?:bs|bis)\s*[^\w\s]?", r"(?:bs|bis)\s*\d{1,4}", r"\d{1,4}\s*[.\-|·:]?\s*(?:bs|bis)"]
KNOWN_HEADINGS = ["introduction", "scope", "normative references", "terms and definitions", "terms, definitions", "bibliography", "foreword", "national foreword"]
UNIT_WORDS = ["cm", "mm", "m", "hz", "khz", "mhz", "ghz", "cm2", "mm2", "m2", "cm3", "mm3", "m3", "kv", "v", "a", "ma", "kg", "g", "mg", "°c", "c", "%", "percent"]
TOC_TITLES = ["contents", "table of contents"]

NUMBERED = r"^\s*(\d+(?:\.\d+)*)\s+(.+)$"
ANNEX = r"(?i)^\s*annex\s+([A-Z])\b"
MARKER = r"(?:\([a-zA-Z0-9]+\)|[a-zA-Z]\)|\d+[.)]|[IVXLCDM]+[.)])"
LIST_MARKER = "^(?:" + MARKER + "|[\\-\u2022\u2023\u25E6\u2043\u2219]\\s+)\\s+"


def _low(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def contains_any(c: Column, words: list[str]) -> Column:
    return let(c, lambda x: reduce(or_, [x.contains(w) for w in words]))


def bold(font: Column) -> Column:
    return F.lower(F.coalesce(font, F.lit(""))).contains("bold")


def italic(font: Column) -> Column:
    return F.lower(F.coalesce(font, F.lit(""))).rlike("italic|oblique")


def stamp_text(c: Column, profile: str = "main") -> Column:
    """Printed stamps, by words or (``step3``) by patterns."""
    return contains_any(_low(c), STAMPS) if profile != "step3" else _low(c).rlike("|".join(STAMP_PATTERNS))


def header_or_footer(y0: Column, y1: Column, height: Column) -> Column:
    return (y1 <= height * 0.04) | (y0 >= height * 0.96)


def right_strip(x0: Column, x1: Column, width: Column) -> Column:
    return (x0 >= width * 0.95) | (x1 >= width * 0.98)


def corner_stamp(text: Column, x0: Column, y0: Column, width: Column, height: Column) -> Column:
    return F.upper(strip(text)).isin("BS", "BIS") & ((y0 >= height * 0.8) | (x0 >= width * 0.75))


def footer_number(text: Column, x0: Column, y0: Column, width: Column, height: Column) -> Column:
    return strip(text).rlike(r"^\d{1,4}$") & (y0 >= height * 0.85) & (x0 >= width * 0.7)


def margin_noise(x: Column, y: Column, size: Column) -> Column:
    """Small print near the edges, in points."""
    return (size <= 9) & ((y <= 35) | (y >= 805) | (x >= 540))


def boilerplate(c: Column) -> Column:
    return contains_any(F.lower(F.coalesce(c, F.lit(""))), BOILERPLATE)


def page_marker(c: Column, profile: str = "main") -> Column:
    """A line that only says which page it is on."""
    # a marker is short, or has white space in a row near its start
    if profile != "main":
        return let(strip(F.coalesce(c, F.lit(""))), lambda x: (F.length(x) <= 6) & F.lower(x).rlike(r"^(?:page|[ivxlcdm]{1,6}|\d{1,3})$"))
    short = lambda x: (F.length(x) <= 12) | F.substring(x, 1, 12).rlike(r"\s\s")
    return let(strip(F.coalesce(c, F.lit(""))), lambda x: short(x) & F.lower(x).rlike(r"^\s*(?:page|" + "|".join(PAGE_MARKERS) + r")\s*$"))


def section_heading(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return t.rlike(NUMBERED) | t.rlike(ANNEX) | t.rlike(r"(?i)^\s*bibliography\s*$")


def measurement_title(c: Column, strict: bool = False) -> Column:
    """Whether a title looks like a quantity; ``strict`` takes units as parts of words, too."""
    t = F.lower(c)
    found = t.rlike(r"\b\d+\s*(?:cm|mm|m|hz|kv|v|a|kg|g|%)\b") | t.rlike(r"\b(?:cm\d+|mm\d+|m\d+)\b")
    if strict:
        return found | contains_any(t, UNIT_WORDS)
    return found | t.rlike(r"(?U)(?<!\w)(?:" + "|".join(literal(u) for u in UNIT_WORDS if len(u) > 1) + r")(?!\w)")


def good_heading(c: Column, strict: bool = False) -> Column:
    return c.rlike("[A-Za-z]") & (F.length(c) <= 90) & (F.length(c) - F.length(F.translate(c, " ", "")) <= 14) & ~measurement_title(c, strict)


def outline_heading(c: Column, strict: bool = False) -> Column:
    """``struct(kind, key, title)`` of a strict section heading, else null."""
    t = strip(F.coalesce(c, F.lit("")))
    low = F.lower(t)
    annex = r"(?i)^\s*Annex\s+([A-Z])\b(.*)$"
    letter = F.upper(F.regexp_extract(t, annex, 1))
    rest = F.trim(F.regexp_extract(t, annex, 2), F.lit(" -\u2014:()"))
    number = F.regexp_extract(t, NUMBERED, 1)
    title = F.trim(F.regexp_extract(t, NUMBERED, 2), F.lit(" -\u2014:"))
    top = F.split(number, r"\.")[0].try_cast("int")
    made = lambda kind, key, title: F.struct(F.lit(kind).alias("kind"), key.alias("key"), title.alias("title"))
    return (
        F.when(low.isin(KNOWN_HEADINGS), made("named", F.translate(low, " ", "_"), t))
        .when(t.rlike(annex), made("annex", F.concat(F.lit("annex_"), letter), F.trim(F.concat(F.lit("Annex "), letter, F.when(rest == "", "").otherwise(F.concat(F.lit(" "), rest))))))
        .when(t.rlike(NUMBERED) & top.between(1, 30) & good_heading(title, strict), made("num", number, title))
    )


def topic_heading(c: Column) -> Column:
    """Short, without a full stop, in capitals or mostly capitalised words."""
    t = strip(c)
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    upper = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    capitals = (F.upper(t) == t) & (F.lower(t) != t)
    return (F.length(t).between(3, 70)) & ~t.endswith(".") & (capitals | ((F.size(words).between(1, 10)) & (upper / F.greatest(F.size(words), F.lit(1)) >= 0.6)))


def toc_index(c: Column) -> Column:
    return strip(c).rlike(r"^\d+(?:\.\d+)+$")


def toc_entry(c: Column, profile: str = "main") -> Column:
    """A line of a table of contents: ends with a page number, or has dot leaders."""
    t = strip(c)
    if profile != "main":
        return F.lower(t).rlike(r"(?U)\s(?:\d{1,3}|[ivxlcdm]{1,6})$")
    return t.rlike(r"\.{5,}") | F.lower(t).rlike(r"(?U)\s(?:\d{1,4}|[ivxlcdm]{1,8})\s*$")


def toc_title(c: Column) -> Column:
    return _low(c).isin(TOC_TITLES)


def paragraph_like(c: Column) -> Column:
    return (F.size(F.split(normalize_ws(c), " ")) >= 10) & c.rlike("[a-zA-Z]")


def ends_sentence(c: Column, profile: str = "main") -> Column:
    return c.rlike(r"(?U)[.?!;:]\s*$" if profile == "main" else r"(?U)[.?!;]\s*$")


def continuation(before: Column, line: Column, profile: str = "main") -> Column:
    """Whether ``line`` goes on with the line before."""
    first = F.substring(line, 1, 1)
    begins = ((F.lower(first) == first) & (F.upper(first) != first)) | first.rlike(r"(?U)^[(\[\"'\d]") | (F.length(line) <= 12)
    return (before != "") & (line != "") & ~ends_sentence(before, profile) & ~line.rlike(LIST_MARKER) & begins


# fixed values: mathematical characters and words
MATH = "[=±×*/^_∑∏√∫≈≠≤≥→←↔∞αβγΔμΩπθλ∈∉∩∪∂∇·•]"
MATH_WORDS = r"(?i)\b(?:sum|prod|sqrt|lim|log|ln|sin|cos|tan|exp|min|max)\b"
EQUATION_NUMBER, EQUATION_END = r"^\(\s*\d{1,4}\s*\)$", r"\(\s*\d{1,4}\s*\)\s*$"


def formula_text(c: Column) -> Column:
    """Text that looks like a formula (of normalised text)."""
    t = normalize_ws(F.translate(F.coalesce(c, F.lit("")), "\u2013\u2014\u00ad", "--"))
    operators = F.regexp_count(t, F.lit(r"[=+\-*/^_(){}\[\]]"))
    found = t.rlike(EQUATION_NUMBER) | t.rlike(MATH) | t.rlike(MATH_WORDS) | ((operators >= 2) & (F.regexp_count(t, F.lit(r"\d")) >= 2))
    return (t != "") & (F.length(t) <= 900) & found


def good_latex(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return (F.length(t) >= 3) & (F.length(t) - F.length(F.translate(t, "?", "")) < 2)


TABLE_CAPTION = "(?i)^\\s*Table\\s+(\\d+)\\s*(?:[\u2014\\-\u2013:]\\s*(.*))?$"
TABLE_CONTINUED = r"(?i)^\s*Table\s+(\d+)\s*\(\s*continued\s*\)\s*$"


def caption_number(c: Column) -> Column:
    """The number in a table's caption, or null."""
    found = F.when(c.rlike(TABLE_CAPTION), F.regexp_extract(c, TABLE_CAPTION, 1)).when(c.rlike(TABLE_CONTINUED), F.regexp_extract(c, TABLE_CONTINUED, 1))
    return found.try_cast("int")


def title_search(title: Column, wanted: str) -> Column:
    return F.lower(title).contains(wanted.lower())


def without(c: Column, pattern: str) -> Column:
    return replaced(c, pattern, "")
