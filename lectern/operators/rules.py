"""Tables of rules over tables of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.batches import small_batches
from lectern.functions.rules import RuleSet
from lectern.functions.text import strip

#: Rules that are sent at once; more are applied in blocks, in order.
BLOCK = 20_000


def _blocks(rules: DataFrame) -> Iterator[RuleSet]:
    """Rule sets of at most ``BLOCK`` rules by ``position``, from a table that may lack any column but ``find``."""
    defaults = {"position": "0", "replace": "''", "match_type": "'exact'", "case_sensitive": "false", "enabled": "true"}
    rows = rules.selectExpr("find", *[f"coalesce(`{c}`, {d}) as `{c}`" if c in rules.columns else f"{d} as `{c}`" for c, d in defaults.items()])
    rows = rows.where("enabled and find <> ''").orderBy("position", "find", "replace").select("find", "replace", "match_type", "case_sensitive")
    block = []
    for r in rows.toLocalIterator():
        block.append(tuple(r))
        if len(block) == BLOCK:
            yield RuleSet(block)
            block = []
    if block:
        yield RuleSet(block)


def replace_by_rules(rows: DataFrame, rules: DataFrame, *, text: str = "text") -> DataFrame:
    """``rows`` with the rules (``position, find, replace, match_type, case_sensitive, enabled``) applied to ``text`` in order.

    Words end where Python's ``\\b`` says. Null texts stay null. Rules are read
    once, when this is called.
    """
    small_batches(rows.sparkSession)
    context = rows.sparkSession.sparkContext
    for own in _blocks(rules):
        sent = context.broadcast(own)
        rows = rows.withColumn(text, F.pandas_udf(lambda s, sent=sent: s.map(sent.value.replaced, na_action="ignore"), "string")(F.col(text)))
    return rows


def drop_by_rules(rows: DataFrame, rules: DataFrame, *, text: str = "text") -> DataFrame:
    """``rows`` without those whose trimmed text is what an ``exact`` rule says or contains a match of a ``regex`` one; blank rows stay.

    Exact rules, which heed case here, are joined by hash and may be any number.
    """
    trimmed = strip(F.coalesce(F.col(text), F.lit("")))
    own = rules.where("enabled") if "enabled" in rules.columns else rules
    exact = own.where("match_type = 'exact' and find <> ''").select(F.col("find").alias("__text")).distinct()
    out = rows.withColumn("__text", trimmed).join(exact, "__text", "left_anti")
    small_batches(rows.sparkSession)
    context = rows.sparkSession.sparkContext
    for patterns in _blocks(own.where("match_type = 'regex'")):
        sent = context.broadcast(patterns)
        hit = F.pandas_udf(lambda s, sent=sent: s.map(lambda x: bool(x) and sent.value.matches(x)).astype(bool), "boolean")
        out = out.where(~hit(F.col("__text")))
    return out.select(*rows.columns)


def rule_table(spark, rules: list[dict]) -> DataFrame:
    """Rules as a table, in the order given."""
    frame = pd.DataFrame([{"position": k, "find": r.get("find") or "", "replace": r.get("replace") or "", "match_type": r.get("match_type") or "exact", "case_sensitive": bool(r.get("case_sensitive")), "enabled": bool(r.get("enabled", True))} for k, r in enumerate(rules)], columns=["position", "find", "replace", "match_type", "case_sensitive", "enabled"])
    return spark.createDataFrame(frame, "position long, find string, replace string, match_type string, case_sensitive boolean, enabled boolean")
