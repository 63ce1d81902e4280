"""Tables of contents, dropped from texts or from blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import filters as f
from lectern.functions.text import lines_of, replaced, strip
from lectern.operators.islands import joined, numbered

#: The title must be among the first lines, and the next ones must hold entries enough.
FIRST_LINES, NEXT_LINES, ENTRIES = 400, 119, 5


def drop_from_lines(lines: DataFrame, *, order: str = "line_no") -> DataFrame:
    """Lines (``doc_id, text``) without tables of contents.

    A table starts at its title and ends before the first line that is neither
    an entry nor a bare number and is, or is followed by, a paragraph.
    """
    w = Window.partitionBy("doc_id").orderBy(order)
    rest, whole = w.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("doc_id")
    t = F.col("text")
    rows = lines.withColumns({"__n": F.row_number().over(w) - 1, "__start": f.toc_title(t), "__entry": (strip(t) != "") & f.toc_entry(t), "__para": f.paragraph_like(t)})
    rows = rows.withColumn("__first", F.min(F.when(F.col("__start") & (F.col("__n") < FIRST_LINES), F.col("__n"))).over(whole))
    inside = F.col("__entry") & (F.col("__n") > F.col("__first")) & (F.col("__n") <= F.col("__first") + NEXT_LINES)
    rows = rows.withColumn("__gate", F.col("__first").isNotNull() & (F.sum(inside.cast("int")).over(whole) >= ENTRIES))
    following = F.first(F.when(strip(t) != "", F.col("__para")), ignorenulls=True).over(rest)
    ends = ~F.col("__start") & ~F.col("__entry") & ~f.toc_index(t) & (F.col("__para") | F.coalesce(following, F.lit(False)))
    rows = numbered(rows.withColumn("__ends", ends), F.col("__start"), by=["doc_id"], order=[F.col(order)], name="__part")
    left = F.max("__ends").over(Window.partitionBy("doc_id", "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("__left", left).where(~F.coalesce("__gate", F.lit(False)) | (~F.col("__start") & ((F.col("__part") == 0) | F.col("__left"))))
    return kept.select(*lines.columns)


def drop_from_text(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``doc_id, text`` with tables of contents dropped; lines lose trailing and the text outer white space."""
    lines = docs.select("doc_id", F.posexplode(F.transform(lines_of(F.col(text)), lambda x: replaced(x, r"(?U)\s+$", ""))).alias("line_no", "text"))
    kept = drop_from_lines(lines).groupBy("doc_id").agg(strip(joined("line_no", "text", "\n")).alias("text"))
    return docs.select("doc_id").join(kept, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def drop_from_blocks(blocks: DataFrame, *, order: str = "block_no") -> DataFrame:
    """Blocks (``doc_id, type, page, text``) without tables of contents: they end two pages on, or at a block of 12 words that is no entry."""
    t = strip(F.col("text"))
    start = (F.col("type") == "heading") & f.toc_title(t)
    rows = numbered(blocks.withColumn("__start", start), F.col("__start"), by=["doc_id"], order=[F.col(order)], name="__part")
    w = Window.partitionBy("doc_id", "__part").orderBy(order)
    began = F.first("page").over(w)
    words = F.size(F.split(t, r"(?U)\s+"))
    ends: Column = ~F.col("__start") & (F.coalesce(F.col("page") > began + 2, F.lit(False)) | (~f.toc_index(t) & ~f.toc_entry(t, "step4") & (words >= 12)))
    left = F.max("__ends").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__ends", ends).withColumn("__left", left).where(~F.col("__start") & ((F.col("__part") == 0) | F.col("__left"))).select(*blocks.columns)
