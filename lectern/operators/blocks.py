"""Blocks of lines: headings and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import filters as f
from lectern.functions.text import let, lines_of, normalize_lines, strip
from lectern.operators.islands import joined, settled
from lectern.operators.lines import reading_order

#: Largest steps inside a block, and the step from which lines are kept apart, in points.
STEP_Y, STEP_X, BREAK_Y = 18, {"main": 35, "step3": 25}, 10


def body_size(lines: DataFrame) -> DataFrame:
    """``doc_id, body_size``: mean size of lines between 9 and 13, 11 if there are none."""
    return lines.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("avg_size").between(9, 13), F.col("avg_size"))), F.lit(11.0)).alias("body_size"))


def is_heading(size: Column, bold_ratio: Column, body: Column) -> Column:
    return (size >= body * 1.5) | ((bold_ratio >= 0.6) & (size >= body * 1.25))


def classify(lines: DataFrame) -> DataFrame:
    """Adds ``body_size`` and ``type`` (heading or paragraph)."""
    w = Window.partitionBy("doc_id")
    body = F.coalesce(F.avg(F.when(F.col("avg_size").between(9, 13), F.col("avg_size"))).over(w), F.lit(11.0))
    return lines.withColumn("body_size", body).withColumn("type", F.when(is_heading(F.col("avg_size"), F.col("bold_ratio"), F.col("body_size")), "heading").otherwise("paragraph"))


def merge(lines: DataFrame, *, profile: str = "main", order: str = "line_no", reflowed: bool = True) -> DataFrame:
    """``doc_id, block_no, type, page, y, n_lines, text``: lines of one type, page and column, close together.

    ``lines`` needs ``doc_id, page, x, y, avg_size, bold_ratio, text`` and an
    ``order`` column that breaks ties of position.
    """
    w = Window.partitionBy("doc_id").orderBy(*reading_order(order))
    before = lambda c: F.lag(c).over(w)
    gap_y, gap_x = F.col("y") - before("y"), F.abs(F.col("x") - before("x"))
    starts = before("type").isNull() | (before("type") != F.col("type")) | (before("page") != F.col("page")) | (gap_y > STEP_Y) | (gap_x > STEP_X[profile])
    rows = classify(lines).withColumn("starts", starts).withColumn("apart", F.when(gap_y > BREAK_Y, "\n").otherwise(" ")).withColumn("at", F.row_number().over(w))
    rows = rows.withColumn("block_no", F.sum(F.col("starts").cast("int")).over(w)).withColumn("piece", F.when(F.col("starts"), F.col("text")).otherwise(F.concat("apart", "text")))
    out = rows.groupBy("doc_id", "block_no").agg(F.min_by("type", "at").alias("type"), F.min_by("page", "at").alias("page"), F.min_by("y", "at").alias("y"), F.count("*").alias("n_lines"), joined("at", "piece").alias("text"))
    if profile == "main":
        text = normalize_lines(F.col("text"))
        return settled(out, "text", reflow(text) if reflowed else text).where("text <> ''")
    return settled(out, "text", strip(F.col("text"))).where("text <> ''")


def scanned_blocks(rows: DataFrame) -> DataFrame:
    """``block_id, type, text`` for a page's blocks as they are (``doc_id, page, block_no, bbox, text``); blank ones go.

    The id ends in six hexadecimal digits of a hash of what the block is.
    """
    text = strip(F.coalesce("text", F.lit("")))
    made = F.substring(F.sha2(F.concat_ws("|", "doc_id", "page", "block_no", text), 256), 1, 6)
    out = rows.withColumn("block_id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), F.col("block_no").cast("string"), F.lit("_"), made))
    out = settled(out, "text", text).where("text <> ''")
    return out.withColumn("type", F.when(f.topic_heading(F.col("text")), "heading").otherwise("paragraph"))


def reflow(c: Column, profile: str = "main") -> Column:
    """Rejoin wrapped lines of a block.

    List markers at a line's end go to a line of their own, markers alone are
    joined with the next text, a line that goes on with the line before is
    joined with it (two at a time), and blank lines are not repeated.
    """
    end = r"(?U)\s((?:[a-zA-Z]\)|\(\w+\)|\d+[.)]|[IVXLCDM]+[.)]))\s*$"
    text = lambda x: F.array(x)

    def cut(line: Column) -> Column:
        base, marker = strip(F.regexp_replace(line, end, "")), F.regexp_extract(line, end, 1)
        return F.when((line.endswith(".") | line.endswith(")")) & line.rlike(end) & ~line.rlike(f.LIST_MARKER), F.filter(F.array(base, marker), lambda x: x != "")).otherwise(text(line))

    lines = F.flatten(F.transform(F.transform(lines_of(c), strip), cut))
    nothing = F.lit(None).cast("string")
    state = lambda out, held, blanks: F.struct(out.alias("out"), held.alias("held"), blanks.alias("blanks"))
    empty = F.array().cast("array<string>")

    def glue(a: Column, x: Column) -> Column:
        alone = x.rlike(f"^{f.MARKER}$")
        return (
            F.when(a["held"].isNotNull() & (x == ""), state(a["out"], a["held"], a["blanks"] + 1))
            .when(a["held"].isNotNull(), state(F.concat(a["out"], text(F.concat_ws(" ", a["held"], x))), nothing, F.lit(0)))
            .when(alone, state(a["out"], x, F.lit(0)))
            .otherwise(state(F.concat(a["out"], text(x)), nothing, F.lit(0)))
        )

    ended = lambda a: F.when(a["held"].isNull(), a["out"]).otherwise(F.concat(a["out"], text(a["held"]), F.array_repeat(F.lit(""), a["blanks"])))
    lines = F.aggregate(lines, state(empty, nothing, F.lit(0)), glue, ended)

    def pair(a: Column, x: Column) -> Column:
        held = a["held"]
        return (
            F.when(held.isNotNull() & f.continuation(held, x, profile), state(F.concat(a["out"], text(F.concat_ws(" ", held, x))), nothing, F.lit(0)))
            .when(x == "", state(F.concat(a["out"], F.when(held.isNull(), empty).otherwise(text(held)), text(x)), nothing, F.lit(0)))
            .otherwise(state(F.concat(a["out"], F.when(held.isNull(), empty).otherwise(text(held))), x, F.lit(0)))
        )

    lines = F.aggregate(lines, state(empty, nothing, F.lit(0)), pair, ended)
    kept = lambda made: F.filter(made, lambda x, i: ~((x == "") & (i > 0) & (F.coalesce(F.get(made, i - 1), F.lit("x")) == "")))
    return strip(F.array_join(let(lines, kept), "\n"))
