"""From spans to lines, and lines that repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import filters as f
from lectern.functions.text import nfkc, normalize_ws, strip, strip_control_chars
from lectern.operators.islands import joined
from lectern.operators.spatial import touching


def clean_spans(spans: DataFrame, *, rules: dict | None = None) -> DataFrame:
    """Drop span-level furniture: blank text, stamps, margins, corner stamps and page numbers.

    Needs ``text``, ``bbox``, ``page_w``, ``page_h``; a span without a bbox
    only passes the text filters.
    """
    x0, y0, x1, y1 = (F.col("bbox")[k] for k in range(4))
    t, w, h = strip_control_chars(F.col("text")), F.col("page_w"), F.col("page_h")
    placed = f.header_or_footer(y0, y1, h) | f.right_strip(x0, x1, w) | f.corner_stamp(t, x0, y0, w, h) | f.footer_number(t, x0, y0, w, h)
    out = spans.where((strip(t) != "") & ~f.stamp_text(t) & ~F.coalesce(placed, F.lit(False)))
    return remove_by_rules(out, rules) if rules else out


def remove_by_rules(rows: DataFrame, rules: dict, text: str = "text") -> DataFrame:
    """Drop rows whose trimmed text is one of ``exact`` or matches one of ``regex``; blank rows stay. Invalid patterns are left out."""
    t = strip(F.coalesce(F.col(text), F.lit("")))
    exact, patterns = list(rules.get("exact") or []), valid_patterns(rows, rules.get("regex") or [])
    hit = F.lit(False)
    if exact:
        hit = hit | t.isin(exact)
    for p in patterns:  # one by one: back-references count groups within their own pattern
        hit = hit | t.rlike(p)
    return rows.where((t == "") | ~hit)


def valid_patterns(rows: DataFrame, patterns: list[str]) -> list[str]:
    compiler = rows.sparkSession._jvm.java.util.regex.Pattern
    out = []
    for p in patterns:
        try:
            compiler.compile(p)
            out.append(p)
        except Exception:  # a bad pattern must not switch the good ones off
            continue
    return out


def outside_regions(spans: DataFrame, regions: DataFrame, pad: float = 3) -> DataFrame:
    """Spans that touch none of the regions (``doc_id, page, bbox``) of their page; a span without a box touches none."""
    keys = ["doc_id", "page"]
    own = spans.where(F.col("bbox").isNotNull()).select(*keys, "bbox").distinct()
    hit = touching(own, regions.select(*keys, F.col("bbox").alias("region")), keys, pad=pad).select(*keys, "bbox").distinct()
    return spans.join(hit, [*keys, "bbox"], "left_anti").select(*spans.columns)


def assemble(spans: DataFrame, *, unicode: bool = False) -> DataFrame:
    """Lines from spans (``doc_id, page, block_no, line_no, span_no, text, size, bold, italic, bbox``).

    Text is joined without separator and normalised; sizes are averaged, bold
    and italic become ratios, x and y are the least corners. Lines that are
    blank go.
    """
    keys = ["doc_id", "page", "block_no", "line_no"]
    text = nfkc(F.col("text")) if unicode else F.col("text")
    box = F.col("bbox")
    out = spans.withColumn("text", text).groupBy(*keys).agg(
        joined("span_no", "text").alias("text"),
        F.min(box[0]).alias("x"),
        F.min(box[1]).alias("y"),
        F.max(box[2]).alias("x1"),
        F.max(box[3]).alias("y1"),
        F.avg("size").alias("avg_size"),
        F.avg(F.col("bold").cast("double")).alias("bold_ratio"),
        F.avg(F.col("italic").cast("double")).alias("italic_ratio"),
        F.first("page_w").alias("page_w"),
        F.first("page_h").alias("page_h"),
    )
    return out.withColumn("text", normalize_ws(strip_control_chars(F.col("text")))).where("text <> ''")


def boxed_lines(spans: DataFrame) -> DataFrame:
    """Lines with their box, by page, height and left edge, as ``line_no``; boxes and sizes are taken from blank spans, too.

    Lines without text or without any box go.
    """
    rows = assemble(spans).where("x is not null").withColumn("bbox", F.array("x", "y", "x1", "y1"))
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y", "x", "block_no", "line_no")).cast("long"))


def reading_order(*also: str) -> list[Column]:
    """Page, height in tenths, left edge."""
    return [F.col("page"), F.round("y", 1), F.col("x"), *map(F.col, also)]


def repeated(lines: DataFrame, *, share: float = 0.5, longest: int = 200, least: int = 25, profile: str = "main") -> DataFrame:
    """``doc_id, text`` of lines whose occurrences are at least ``share`` of the pages.

    In ``main``, shorter lines than ``least`` must be stamps; ``step3`` takes any of at most 80.
    """
    longest = 80 if profile == "step3" else longest
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    counted = lines.where(F.length("text") <= longest).groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    out = counted.join(pages, "doc_id").where(F.col("n") >= share * F.col("pages"))
    if profile != "step3":
        out = out.where((F.length("text") >= least) | f.stamp_text(F.col("text")))
    return out.select("doc_id", "text")


def without_repeated(lines: DataFrame, **options) -> DataFrame:
    return lines.join(repeated(lines, **options), ["doc_id", "text"], "left_anti")


def header_footer_candidates(lines: DataFrame, *, top: float = 0.08, bottom: float = 0.92, longest: int = 160, share: float = 0.6, samples: int = 6) -> DataFrame:
    """``doc_id, band, text, pages_count, pages_ratio, sample_pages`` of lines near the top or bottom of most pages."""
    band = F.when(F.col("y") <= F.col("page_h") * top, "TOP").when(F.col("y") >= F.col("page_h") * bottom, "BOTTOM")
    pages = lines.groupBy("doc_id").agg(F.max("page").alias("pages"))
    seen = lines.where(F.length("text").between(2, longest)).withColumn("band", band).where("band is not null")
    nth = F.row_number().over(Window.partitionBy("doc_id", "band", "text").orderBy("page"))
    sample = F.array_sort(F.collect_list(F.when(F.col("nth") <= samples, F.col("page"))))
    out = seen.withColumn("nth", nth).groupBy("doc_id", "band", "text").agg(F.count_distinct("page").alias("pages_count"), sample.alias("sample"))
    out = out.join(pages, "doc_id").where(F.col("pages_count") >= share * F.col("pages"))
    return out.select("doc_id", "band", "text", "pages_count", F.round(F.col("pages_count") / F.col("pages"), 2).alias("pages_ratio"), F.array_join(F.col("sample").cast("array<string>"), ", ").alias("sample_pages"))


def scanned(lines: DataFrame, least: int = 200) -> DataFrame:
    """``doc_id, chars, scanned``: documents with less text than ``least`` characters are taken for scans."""
    return lines.groupBy("doc_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).withColumn("scanned", F.col("chars") < least)
