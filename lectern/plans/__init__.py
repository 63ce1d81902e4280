"""Whole pipelines composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import filters as f
from lectern.functions import text as t
from lectern.functions.tokens import held_tables, marked_tables, narrate_formulas, replace_tables, restored
from lectern.operators import blocks as b
from lectern.operators import chunks, formulas, lines, sections, tables, toc
from lectern.operators.islands import settled
from lectern.operators.overlay import told_maps


def normalized_text(c: Column) -> Column:
    """A section's text for speech, line by line: leaders, decimals, units, white space; furniture dropped; at most one blank line. After ``norm_unicode`` and dropping of contents."""
    each = F.transform(t.lines_of(c), lambda x: t.normalize_ws(t.normalize_units(t.fix_decimal_spacing(t.remove_dot_leaders(x)))))
    kept = F.filter(each, lambda x: (x == "") | ~(f.page_marker(x) | f.boilerplate(x)))
    return t.strip(t.replaced(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def normalize_sections(found: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Sections with texts normalised; with narrations (``doc_id, formula_id, page, text``), tokens are spoken and formulas appended."""
    key = F.struct("doc_id", "section_no")
    own = found.withColumn("__key", key)
    texts = own.select(F.col("__key").alias("doc_id"), t.norm_unicode(F.col("text")).alias("text"))
    out = own.drop("text").join(toc.drop_from_text(texts).withColumnRenamed("doc_id", "__key"), "__key").drop("__key")
    if told is not None:
        said = told_maps(told, "formula_id").withColumnRenamed("told", "__told")
        out = out.join(said, "doc_id", "left").withColumn("text", narrate_formulas(F.col("text"), F.col("__told"))).drop("__told")
    out = settled(out, "text", normalized_text(F.col("text")))
    return formulas.append_to_sections(out, told) if told is not None else out


def wide_text(c: Column) -> Column:
    """A block's text after ``norm_unicode``, the wider form: ranges, slashes, dots and more symbols are spoken, lines rejoined."""
    c = t.fix_decimal_spacing(t.remove_dot_leaders(c))
    c = t.normalize_units(t.normalize_dots(t.normalize_slash_context(t.normalize_numeric_ranges(c))), "step3")
    return b.reflow(c, "step3")


def normalize_blocks(found: DataFrame) -> DataFrame:
    """Blocks in the wider form, table tokens kept, without page markers, boilerplate lines and remains of two characters."""
    out = found.withColumn("__held", held_tables(F.col("text"))).withColumn("text", t.norm_unicode(marked_tables(F.col("text"))))
    out = settled(out, "text", restored(wide_text(F.col("text")), F.col("__held"))).drop("__held")
    out = out.where(~((~F.col("text").contains("\n")) & f.page_marker(F.col("text"), "step3")))
    kept = F.filter(F.split("text", "\n"), lambda x: (t.strip(x) != "") & ~f.boilerplate(x))
    out = settled(out, "text", F.when(f.boilerplate(F.col("text")), t.strip(F.array_join(kept, "\n"))).otherwise(F.col("text")))
    contents = (F.col("type") == "heading") & (F.lower(t.strip(F.col("text"))) == "contents")
    return out.where((F.length(t.strip(F.translate("text", "\n", ""))) > 2) & ~contents)


def spoken_blocks(found: DataFrame, explanations: DataFrame, *, order: str | None = None) -> DataFrame:
    """Blocks with table tokens explained by their document's explanations (``doc_id, id, text``), normalised, without furniture and contents."""
    out = found.join(told_maps(explanations, order=order), "doc_id", "left")
    out = out.withColumn("text", replace_tables(F.col("text"), F.coalesce("told", F.create_map().cast("map<string,string>")))).drop("told")
    out = settled(out, "text", t.normalize_ws(t.fix_decimal_spacing(t.remove_dot_leaders(t.norm_unicode(F.col("text"))))))
    out = out.where((F.length("text") > 2) & ~f.page_marker(F.col("text"), "step4") & ~f.boilerplate(F.col("text")))
    return toc.drop_from_blocks(out)


def documents_to_sections(spans: DataFrame, drawings: DataFrame, rules: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Spans and drawings to (blocks, sections): regions of tables are left out of the text and stand as tokens."""
    whole = lines.assemble(spans.where(t.strip(F.col("text")) != "")).withColumn("bbox", F.array("x", "y", "x1", F.col("y") + F.col("avg_size")))
    found = tables.placed(tables.captions(whole), tables.ruled_regions(drawings))
    rows = lines.assemble(lines.outside_regions(lines.clean_spans(spans, rules=rules), found))
    rows = lines.without_repeated(rows)
    made = tables.add_to_blocks(b.merge(rows), found)
    return made, sections.build(made)


def spans_to_normalized_blocks(spans: DataFrame) -> DataFrame:
    """Spans to blocks in the wider form: lines without small print at the edges, stamps, repeated lines and boilerplate, merged and normalised."""
    rows = lines.assemble(spans, unicode=True)
    rows = rows.where(~f.margin_noise(F.col("x"), F.col("y"), F.col("avg_size")) & ~f.stamp_text(F.col("text"), "step3"))
    rows = lines.without_repeated(rows, profile="step3").where(~f.boilerplate(F.col("text")))
    return normalize_blocks(b.merge(rows, profile="step3"))


def narrated_formulas(found: DataFrame, rows: DataFrame, seen: DataFrame | None = None, told: DataFrame | None = None, *, providers: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks and lines to (formulas, blocks with formula tokens, narrations).

    ``seen`` holds what recognisers made of the regions: ``doc_id, formula_id``,
    a column of latex for each of ``providers``, best first, and ``error``. A
    formula whose recognition failed keeps its row with the error and gets no
    token and no narration; one without good latex is spoken from its text.
    """
    made = formulas.with_ids(formulas.regions(found, rows))
    if seen is None:
        made = made.withColumn("error", F.lit(None).cast("string"))
    else:
        made = made.join(seen.select("doc_id", "formula_id", "error", *providers), ["doc_id", "formula_id"], "left")
    made = formulas.recognised(made, *providers).select("doc_id", "formula_id", "page", "bbox", "latex", "provider", "spoken", "ssml", "error")
    good = made.where("error is null")
    nobody = made.sparkSession.createDataFrame([], "doc_id long, id string, text string")
    return made, formulas.inject(found, good), formulas.narrations(good, told if told is not None else nobody)


def speech_chunks(found: DataFrame, longest: int = chunks.TEXT_CHARS) -> DataFrame:
    """Sections to chunks for a voice."""
    return chunks.exploded(found, chunks.text_chunks(F.col("text"), longest), "doc_id", "section_no")
