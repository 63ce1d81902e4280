"""Formulas: where they stand on a page, their ids, narrations, and injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import filters as f
from lectern.functions.geometry import height, middle_y, overlap_x
from lectern.functions.text import latex_spoken, normalize_ws, spoken_ssml, strip
from lectern.operators.spatial import close_by, within_ranges

KEYS = ["doc_id", "page"]
#: Reach of a numbered equation to all lines and to lines of the main column; of an unnumbered one, at least and in line heights.
NEAR, COLUMN_NEAR, LAYOUT_NEAR, HEIGHTS = 90, 160, 120, 6


def _deduplicated(regions: DataFrame, grain: int) -> DataFrame:
    """The first of regions that are the same on a grid."""
    cell = [F.floor(F.col("bbox")[k] / grain) for k in range(4)]
    return regions.withColumn("rn", F.row_number().over(Window.partitionBy(*KEYS, *cell).orderBy("line_no"))).where("rn = 1").drop("rn")


def _around(anchors: DataFrame, lines: DataFrame, near: Column, reach: Column, *, bounded: bool) -> DataFrame:
    """Anchors with the corners of all lines near them; joined by strips of the page that ``reach`` covers, the rest of the condition after."""
    others = lines.select("doc_id", "page", F.col("bbox").alias("other"), F.col("text").alias("other_text"), F.col("line_no").alias("other_no"))
    both = close_by(anchors, others, KEYS, at=middle_y(F.col("bbox")), reach=reach, place=middle_y(F.col("other")), bounded=bounded).where(near)
    o = F.col("other")
    return both.groupBy(*KEYS, "line_no").agg(F.first("text").alias("text"), F.first("bbox").alias("anchor"), F.first("page_w").alias("page_w"), F.min(o[0]).alias("x0"), F.min(o[1]).alias("y0"), F.max(o[2]).alias("x1"), F.max(o[3]).alias("y1"))


def numbered_equations(lines: DataFrame) -> DataFrame:
    """Regions left of equation numbers at the right margin, from lines (``doc_id, page, line_no, text, bbox, page_w``)."""
    t, b, w = strip(F.col("text")), F.col("bbox"), F.col("page_w")
    alone = t.rlike(f.EQUATION_NUMBER) & (b[0] >= w * 0.72)
    ending = t.rlike(f.EQUATION_END) & (b[2] >= w * 0.92)
    anchors = lines.where(alone | ending).withColumn("text", F.when(alone, t).otherwise(strip(F.regexp_extract(t, f.EQUATION_END, 0))))
    away = F.abs(middle_y(F.col("other")) - middle_y(b))
    near = (away <= NEAR) | ((away <= COLUMN_NEAR) & (F.col("other")[0] >= w * 0.05) & (F.col("other")[2] <= w * 0.95))
    out = _around(anchors, lines, near, F.lit(float(COLUMN_NEAR)), bounded=True).select(*KEYS, "line_no", F.array("x0", "y0", F.col("anchor")[2], "y1").alias("bbox"), "text")
    return _deduplicated(out, 5)


def displayed_equations(lines: DataFrame) -> DataFrame:
    """Regions around wide lines that look like formulas, with what is stacked above and below."""
    t, b, w = strip(F.col("text")), F.col("bbox"), F.col("page_w")
    anchors = lines.where((b[2] - b[0] >= w * 0.18) & (b[0] >= w * 0.04) & (t.contains("=") | f.formula_text(t)))
    reach = F.greatest(F.lit(float(LAYOUT_NEAR)), HEIGHTS * height(b))
    close = F.abs(middle_y(F.col("other")) - middle_y(b)) <= reach
    near = (F.col("other_no") == F.col("line_no")) | (close & (overlap_x(b, F.col("other")) >= 0.35) & (F.length(strip(F.col("other_text"))) <= 120))
    out = _around(anchors, lines, near, reach, bounded=False).where(~((F.col("x1") - F.col("x0") > F.col("page_w") * 0.92) & (F.col("y1") - F.col("y0") > 160)))
    return _deduplicated(out.select(*KEYS, "line_no", F.array("x0", "y0", "x1", "y1").alias("bbox"), F.lit("").alias("text")), 8)


def formula_lines(lines: DataFrame) -> DataFrame:
    """Formula-like lines, merged while the next begins within 2.2 heights below the region so far."""
    b = F.col("bbox")
    own = lines.where(f.formula_text(F.col("text")) & (b[2] - b[0] >= F.col("page_w") * 0.18))
    rows = own.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("line_no", "bbox", strip(F.col("text")).alias("text")))).alias("lines"))
    region = lambda no, box, text: F.struct(no.alias("line_no"), box.alias("bbox"), text.alias("text"))
    kind = "array<struct<line_no:bigint,bbox:array<double>,text:string>>"

    def add(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        gap = x["bbox"][1] - last["bbox"][3]
        joined = (gap >= -2) & (gap <= height(last["bbox"]) * 2.2)
        box = F.array(F.least(last["bbox"][0], x["bbox"][0]), F.least(last["bbox"][1], x["bbox"][1]), F.greatest(last["bbox"][2], x["bbox"][2]), F.greatest(last["bbox"][3], x["bbox"][3]))
        grown = F.array(region(last["line_no"], box, normalize_ws(F.concat_ws(" ", last["text"], x["text"]))))
        new = F.array(region(x["line_no"].cast("long"), x["bbox"], x["text"]))
        return F.when(F.size(a) == 0, new).when(F.coalesce(joined, F.lit(False)), F.concat(F.slice(a, 1, F.size(a) - 1), grown)).otherwise(F.concat(a, new))

    return rows.select(*KEYS, F.explode(F.aggregate("lines", F.array().cast(kind), lambda a, x: add(a, x).cast(kind))).alias("r")).select(*KEYS, "r.*")


def first_tier(*tiers: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the first of several tables that has any, for each group."""
    rows = None
    for k, t in enumerate(tiers):
        own = t.withColumn("tier", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    return rows.withColumn("best", F.min("tier").over(Window.partitionBy(*by))).where("tier = best").drop("best")


def page_regions(lines: DataFrame) -> DataFrame:
    """Of each page the numbered equations, else the displayed ones, else merged formula lines, with ``tier``."""
    columns = [*KEYS, "line_no", "bbox", "text"]
    return first_tier(*[x.select(*columns) for x in (numbered_equations(lines), displayed_equations(lines), formula_lines(lines))], by=KEYS)


def regions(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Of each document its formula blocks, else formula-like blocks with a bbox, else what its pages show."""
    own = blocks.where("bbox is not null and page > 0").withColumn("line_no", F.col("block_no").cast("long"))
    columns = [*KEYS, "line_no", "bbox", "text"]
    explicit, like = own.where(F.lower("type") == "formula"), own.where(f.formula_text(F.col("text")))
    return first_tier(explicit.select(*columns), like.select(*columns), page_regions(lines).select(*columns), by=["doc_id"])


def with_ids(found: DataFrame) -> DataFrame:
    """Adds ``formula_id``: the equation's number or a running one, page, running number."""
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_no"))
    t = strip(F.coalesce("text", F.lit("")))
    number = F.regexp_extract(t, r"^\(\s*(\d{1,4})\s*\)$", 1)
    base = F.when(number != "", number).otherwise(F.col("seq").cast("string"))
    return found.withColumn("seq", seq).withColumn("formula_id", F.concat(F.lit("F"), base, F.lit("_p"), F.col("page").cast("string"), F.lit("_"), F.col("seq").cast("string")))


def recognised(found: DataFrame, *providers: str) -> DataFrame:
    """``latex`` and ``provider``: the first provider column with good latex, else the region's text."""
    out = F.coalesce(*[F.when(f.good_latex(F.col(p)), F.struct(F.col(p).alias("latex"), F.lit(p).alias("provider"))) for p in providers], F.struct(F.coalesce("text", F.lit("")).alias("latex"), F.lit("text").alias("provider")))
    return found.withColumn("__r", out).withColumns({"latex": F.col("__r.latex"), "provider": F.col("__r.provider")}).drop("__r").withColumn("spoken", latex_spoken(F.col("latex"))).withColumn("ssml", spoken_ssml(F.col("spoken")))


def inject(blocks: DataFrame, formulas: DataFrame) -> DataFrame:
    """Formula blocks with tokens, after all other blocks."""
    last = blocks.groupBy("doc_id").agg(F.max("block_no").alias("last"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "formula_id"))
    new = formulas.join(last, "doc_id", "left").select("doc_id", (F.coalesce("last", F.lit(0)) + seq).alias("block_no"), F.lit("formula").alias("type"), "page", "bbox", F.concat(F.lit("[[FORMULA|"), F.col("formula_id"), F.lit("|]]")).alias("text"))
    return blocks.unionByName(new, allowMissingColumns=True)


def narrations(formulas: DataFrame, told: DataFrame) -> DataFrame:
    """``doc_id, formula_id, page, text``: what the user says, else the spoken form; blank ones go."""
    own = told.select("doc_id", F.col("id").alias("formula_id"), F.col("text").alias("own"))
    text = F.coalesce(F.nullif(strip(F.coalesce("own", F.lit(""))), F.lit("")), strip(F.coalesce("spoken", F.lit(""))))
    return formulas.join(own, ["doc_id", "formula_id"], "left").select("doc_id", "formula_id", "page", text.alias("text")).where("text <> ''")


def append_to_sections(sections: DataFrame, told: DataFrame) -> DataFrame:
    """Sections with the narrations of their pages' formulas at the end, by page and id. Sections are known by ``doc_id, section_no``."""
    n = told.select("doc_id", F.col("page").alias("at"), "formula_id", F.col("text").alias("told"))
    met = within_ranges(sections.select("doc_id", "section_no", "page_start", "page_end").distinct(), n, "doc_id", low="page_start", high="page_end", at="at")
    said = F.transform(F.array_sort(F.collect_list(F.struct("at", "formula_id", "told"))), lambda x: F.concat(F.lit("- "), x["formula_id"], F.lit(" (page "), x["at"].cast("string"), F.lit("): "), x["told"]))
    out = sections.join(met.groupBy("doc_id", "section_no").agg(said.alias("said")), ["doc_id", "section_no"], "left")
    appended = strip(F.concat(F.col("text"), F.lit("\n\nFormulas in this section:\n"), F.array_join("said", "\n")))
    return out.withColumn("text", F.when((F.size("said") > 0) & (F.col("text") != ""), appended).otherwise(F.col("text"))).select(*sections.columns)
