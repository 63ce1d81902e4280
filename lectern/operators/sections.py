"""Sections, their manifest, the outline, and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import filters as f
from lectern.functions.text import file_slug, slug, strip, stripped, word_count
from lectern.functions.tokens import TABLE_OLD
from lectern.operators.islands import joined, numbered, settled


def heading_names(c: Column) -> Column:
    """``struct(id, title)`` of a section heading."""
    t = strip(c)
    number, name = F.regexp_extract(t, f.NUMBERED, 1), strip(F.regexp_extract(t, f.NUMBERED, 2))
    letter = F.regexp_extract(t, f.ANNEX, 1)
    made = lambda key, title: F.struct(key.alias("id"), title.alias("title"))
    return (
        F.when(t.rlike(f.NUMBERED), made(F.concat_ws("_", number, slug(F.regexp_extract(t, f.NUMBERED, 2))), F.concat_ws(" ", number, name)))
        .when(t.rlike(f.ANNEX), made(F.concat(F.lit("annex_"), F.lower(letter)), F.concat(F.lit("Annex "), letter)))
        .otherwise(made(F.lit("bibliography"), F.lit("Bibliography")))
    )


def table_fields(blocks: DataFrame) -> DataFrame:
    """Fill ``table_id`` and ``caption`` of table blocks from their text or page, and put the token into ``text``."""
    t, page = F.col("text"), F.col("page").cast("string")
    own = lambda c: F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    inside = lambda k: F.nullif(strip(F.regexp_extract(t, TABLE_OLD, k)), F.lit(""))
    key = F.coalesce(own("table_id"), inside(1), F.concat(F.lit("p"), page, F.lit("_t_unknown")))
    caption = F.coalesce(own("caption"), inside(2), F.concat(F.lit("Table on page "), page))
    table = F.col("type") == "table"
    out = blocks.withColumn("__id", F.when(table, key).otherwise(F.col("table_id"))).withColumn("__caption", F.when(table, caption).otherwise(F.col("caption")))
    out = out.withColumn("text", F.when(table, F.concat(F.lit("[[TABLE|"), F.col("__id"), F.lit("|"), F.col("__caption"), F.lit("]]"))).otherwise(t))
    return out.drop("table_id", "caption").withColumnsRenamed({"__id": "table_id", "__caption": "caption"})


def build(blocks: DataFrame, *, texts: bool = True) -> DataFrame:
    """Sections from blocks (``doc_id, block_no, type, page, text`` and, for tables, ``table_id, caption, bbox``).

    ``doc_id, section_no`` (from 0), ``id, title, page_start, page_end, text,
    tables``. What precedes the first heading is front matter from page 1.
    Without ``texts``, ``word_count`` in place of ``text``: words are counted block by block, and only headings go on.
    """
    for name, kind in (("table_id", "string"), ("caption", "string"), ("bbox", "array<double>")):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    rows = table_fields(settled(blocks, "text", stripped(F.coalesce("text", F.lit("")))).where("text <> ''"))
    head = (F.col("type") == "heading") & f.section_heading(F.col("text"))
    rows = rows.withColumn("head", head)
    if not texts:
        rows = rows.withColumn("words", word_count(F.col("text"))).withColumn("text", F.when(F.col("head"), F.col("text")))
    rows = numbered(rows, F.col("head"), by=["doc_id"], order=[F.col("block_no")], name="seq")
    first = F.min_by("text", "block_no") if texts else F.min_by("text", F.when(F.col("head"), F.col("block_no")))
    body = joined("block_no", "text", "\n\n").alias("text") if texts else F.sum("words").cast("int").alias("word_count")
    table = F.struct("block_no", "table_id", "caption", "page", "bbox")
    out = rows.groupBy("doc_id", "seq").agg(
        first.alias("first"),
        F.min_by("page", "block_no").alias("page_start"),
        F.max("page").alias("page_end"),
        body,
        F.array_sort(F.collect_list(F.when(F.col("type") == "table", table))).alias("tables"),
    )
    front = F.col("seq") == 0
    out, names = settled(out, "names", F.when(~front, heading_names(F.col("first")))), F.col("names")
    out = out.withColumn("id", F.when(front, "00_front_matter").otherwise(names["id"])).withColumn("title", F.when(front, "Front matter").otherwise(names["title"]))
    out = out.withColumn("page_start", F.when(front, 1).otherwise(F.col("page_start"))).withColumn("page_end", F.greatest("page_start", "page_end"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    tables = F.transform("tables", lambda t: F.struct(t["table_id"].alias("table_id"), t["caption"].alias("caption"), t["page"].alias("page"), t["bbox"].alias("bbox")))
    return out.select("doc_id", order.alias("section_no"), "id", "title", "page_start", "page_end", "text" if texts else "word_count", tables.alias("tables"))


def manifest(sections: DataFrame) -> DataFrame:
    """A row per section without its text: file name, pages, words (as ``build`` counted them without texts, if so), tables."""
    words = F.col("word_count") if "word_count" in sections.columns else word_count(F.col("text"))
    return sections.select(
        "doc_id", F.col("section_no").alias("order"), "id", "title", F.format_string("%02d_%s.txt", "section_no", "id").alias("file"), "page_start", "page_end", words.alias("word_count"), "tables", F.size("tables").alias("table_count")
    )


def outline(lines: DataFrame, *, strict: bool = False, order: str = "line_no") -> DataFrame:
    """Sections of lines (``doc_id, page, text``): ``doc_id, section_no, file, key, title, kind, start_page, line_count, text``.

    Headings are not part of their section; sections without lines go.
    """
    rows = lines.withColumn("head", f.outline_heading(F.col("text"), strict))
    rows = numbered(rows, F.col("head").isNotNull(), by=["doc_id"], order=[F.col(order)], name="seq")
    inner = F.col("head").isNull()
    out = rows.groupBy("doc_id", "seq").agg(
        F.min_by("head", order).alias("head"), F.min_by("page", order).alias("start_page"), F.count(F.when(inner, 1)).alias("line_count"), joined(F.when(inner, F.col(order)), F.when(inner, F.col("text")), "\n").alias("text")
    )
    out = out.where("line_count > 0").withColumn("section_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")))
    front = F.col("head").isNull()
    field = lambda name, other: F.when(front, other).otherwise(F.col(f"head.{name}"))
    out = out.withColumns({"key": field("key", "front_matter"), "title": field("title", "Front matter"), "kind": field("kind", "meta")})
    number = F.when(F.col("kind") == "num", F.split("key", r"\.")[0].try_cast("int")).otherwise(F.col("section_no"))
    return out.select("doc_id", "section_no", F.when(front, "00_front_matter.txt").otherwise(F.format_string("%02d_%s.txt", number, file_slug(F.col("title")))).alias("file"), "key", "title", "kind", "start_page", "line_count", strip(F.col("text")).alias("text"))


def topics(blocks: DataFrame) -> DataFrame:
    """Blocks (``doc_id, block_no, block_id, page, text, type``) under their last heading; leading ones under a default topic."""
    head = F.col("type") == "heading"
    rows = numbered(blocks, head, by=["doc_id"], order=[F.col("block_no")], name="topic_no")
    inner = F.array_sort(F.collect_list(F.when(~head, F.struct("block_no", "block_id"))))
    out = rows.groupBy("doc_id", "topic_no").agg(F.min_by("block_id", "block_no").alias("first"), F.min_by("text", "block_no").alias("name"), F.min_by("page", "block_no").alias("at"), inner.alias("inner"))
    front = F.col("topic_no") == 0
    return out.select(
        "doc_id", "topic_no", F.when(front, "topic_default").otherwise(F.col("first")).alias("topic_id"), F.when(front, "Introduction / Unsorted").otherwise(F.col("name")).alias("title"), F.when(front, 1).otherwise(F.col("at")).alias("page"), F.transform("inner", lambda x: x["block_id"]).alias("block_ids")
    )
