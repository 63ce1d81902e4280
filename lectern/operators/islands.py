"""Gaps and islands: runs of rows that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined(order: str | Column, text: str | Column, separator: str = "") -> Column:
    """Aggregate: texts in order, joined."""
    order = F.col(order) if isinstance(order, str) else order
    text = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def numbered(rows: DataFrame, starts: Column, *, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``name``: how many rows so far start an island."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` behind a barrier: later filters use the column and do not compute ``value`` anew."""
    kept = [c for c in rows.columns if c != name]
    return rows.select(*kept, F.explode(F.array(value)).alias(name))
