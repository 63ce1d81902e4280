"""Tokens for tables and formulas inside text: ``[[TABLE|id|caption]]``, ``[TABLE:id] caption``, ``[[FORMULA|id|...]]``, ``[FORMULA:id]``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import in_matches, strip

TABLE, TABLE_OLD = r"\[\[TABLE\|([^|]+)\|([^\]]+)\]\]", r"(?i)^\s*\[TABLE:([^\]]+)\]\s*(.*)\s*$"
FORMULA, FORMULA_OLD = r"\[\[FORMULA\|([^|]+)\|([^\]]*)\]\]", r"\[FORMULA:([^\]]+)\]"
ANY_TABLE = r"\[\[TABLE\|[^\]]+\]\]"


def table_tokens(c: Column) -> Column:
    """Array of ``struct(table_id, caption)``."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TABLE), F.lit(0))
    return F.transform(found, lambda m: F.struct(strip(F.regexp_extract(m, TABLE, 1)).alias("table_id"), strip(F.regexp_extract(m, TABLE, 2)).alias("caption")))


def replace_tables(c: Column, explanations: Column) -> Column:
    """Tokens of either form to caption and explanation (from a map column), or to a request for one."""

    def spoken(pattern: str) -> Callable[[Column], Column]:
        def change(m: Column) -> Column:
            key, caption = strip(F.regexp_extract(m, pattern, 1)), strip(F.regexp_extract(m, pattern, 2))
            told = strip(F.coalesce(explanations[key], F.lit("")))
            asked = F.concat(F.lit("This is a table. Please provide a short explanation for table id "), key, F.lit("."))
            return F.concat(caption, F.lit(". "), F.when(told != "", told).otherwise(asked))

        return change

    c = in_matches(F.coalesce(c, F.lit("")), TABLE, spoken(TABLE))
    return in_matches(c, r"(?m)^\[TABLE:[^\]]+\][^\n]*$", spoken(r"^\[TABLE:([^\]]+)\]\s*(.*)$"))


def narrate_formulas(c: Column, narrations: Column) -> Column:
    """Tokens of either form to the formula's name and narration; unchanged where the map is empty or null."""

    def spoken(pattern: str) -> Callable[[Column], Column]:
        def change(m: Column) -> Column:
            key = strip(F.regexp_extract(m, pattern, 1))
            told = strip(F.coalesce(narrations[key], F.lit("")))
            return F.when(told != "", F.concat(F.lit(" Formula "), key, F.lit(": "), told, F.lit(" "))).otherwise(F.concat(F.lit(" Formula "), key, F.lit(". ")))

        return change

    done = in_matches(in_matches(F.coalesce(c, F.lit("")), FORMULA, spoken(FORMULA)), FORMULA_OLD, spoken(FORMULA_OLD))
    return F.when(F.coalesce(F.size(narrations), F.lit(0)) > 0, done).otherwise(c)


def held_tables(c: Column) -> Column:
    """The table tokens of a text, to be put back by ``restored``."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ANY_TABLE), F.lit(0))


def marked_tables(c: Column) -> Column:
    """The text with plain placeholders in place of its table tokens."""
    parts = F.split(F.coalesce(c, F.lit("")), ANY_TABLE, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("__TABLETOKEN_"), (i - 1).cast("string"), F.lit("__"), p))), "")


def restored(c: Column, held: Column) -> Column:
    return in_matches(c, r"__TABLETOKEN_\d+__", lambda m: F.coalesce(F.get(held, F.regexp_extract(m, r"(\d+)", 1).cast("int")), m))


def canonical_table_id(raw: Column, caption: Column) -> Column:
    """``T<n>`` from the caption or the raw id; else the raw id; null if there is none."""
    raw, caption = strip(F.coalesce(raw, F.lit(""))), strip(F.coalesce(caption, F.lit("")))
    named = r"(?i)\btable\s*([0-9]{1,4})\b"
    number = lambda c, p: F.when(c.rlike(p), F.concat(F.lit("T"), F.regexp_extract(c, p, 1).cast("int").cast("string")))
    return F.coalesce(number(caption, named), number(raw, r"(?i)\bT([0-9]{1,4})\b"), number(raw, named), F.nullif(raw, F.lit("")))
