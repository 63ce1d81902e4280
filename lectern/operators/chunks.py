"""Greedy packing of paragraphs and blocks into chunks of bounded size. A paragraph is never split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import block_ssml, clean_for_tts, paragraphs, strip, word_count

#: Characters of a text chunk and of a spoken one.
TEXT_CHARS, SSML_CHARS = 1800, 4000


def starts(lengths: Column, longest: int) -> Column:
    """Where chunks begin (from 0), if pieces of these lengths are packed in order while they fit, one at least.

    By cumulative lengths each piece points to the one after the last that fits
    with it; which pieces are reached from the first is found by pointer
    jumping, so time grows with n log n and nothing but numbers is copied.
    """
    let = lambda value, body: F.transform(F.array(value), body)[0]
    bits = lambda n: F.length(F.bin(n))
    power = lambda t: F.call_function("shiftleft", F.lit(1), t)

    def ends(n: Column) -> Column:
        add = lambda s, t: F.transform(s, lambda x, i: x + F.coalesce(F.get(s, i - power(t)), F.lit(0)))
        return F.aggregate(F.sequence(F.lit(0), bits(n) - 1), F.transform(lengths, lambda x: x.cast("long")), add)

    def after(n: Column) -> Column:
        def nexts(end: Column) -> Column:
            def fitting(most: Column) -> Column:
                step = lambda at, t: F.when((at + power(t) <= n) & (F.get(end, at + power(t) - 1) <= most), at + power(t)).otherwise(at)
                return F.aggregate(F.sequence(bits(n) - 1, F.lit(0), F.lit(-1)), F.lit(0), step)

            return F.transform(end, lambda e, i: F.greatest(i + 1, fitting(F.coalesce(F.get(end, i - 1), F.lit(0)) + longest)))

        return let(ends(n), nexts)

    def reached(n: Column) -> Column:
        jump = lambda js, _: F.concat(js, F.array(let(F.element_at(js, -1), lambda j: F.transform(j, lambda k: F.get(j, k)))))
        first = F.array(F.concat(after(n), F.array(n)))
        jumps = F.aggregate(F.sequence(F.lit(1), bits(n)), first, jump)
        both = lambda at, j: F.filter(F.flatten(F.transform(at, lambda k: F.array(k, F.get(j, k)))), lambda k: k < n)
        return F.aggregate(F.reverse(jumps), F.array(F.lit(0)), both)

    return F.when(F.size(lengths) > 0, let(F.size(lengths), reached)).otherwise(F.array().cast("array<int>"))


def grouped(pieces: Column, longest: int) -> Column:
    """Pieces in order, in groups whose lengths add up to at most ``longest``; a longer piece is a group of its own."""

    def cut(own: Column) -> Column:
        at = starts(F.transform(own, F.length), longest)
        return F.transform(F.array(at), lambda s: F.transform(s, lambda k, i: F.slice(own, k + 1, F.coalesce(F.get(s, i + 1), F.size(own)) - k)))[0]

    return F.transform(F.array(pieces), cut)[0]


def packed(pieces: Column, longest: int) -> Column:
    """Pieces that are not blank, each with its own separators, packed in order; chunks are stripped."""
    return F.transform(grouped(pieces, longest), lambda g: strip(F.array_join(g, "")))


def text_chunks(c: Column, longest: int = TEXT_CHARS, header: Column | None = None) -> Column:
    """A text's paragraphs, without tags, in chunks; ``header`` (a title) goes first as ``=== title ===``."""
    parts = paragraphs(c)
    if header is not None:
        parts = F.concat(F.array(F.concat(F.lit("=== "), header, F.lit(" ==="))), parts)
    parts = F.filter(F.transform(parts, clean_for_tts), lambda p: p != "")
    return packed(F.transform(parts, lambda p: F.concat(p, F.lit("\n\n"))), longest)


def line_chunks(c: Column, longest: int = TEXT_CHARS) -> Column:
    """An array of lines, each as a paragraph, in chunks."""
    parts = F.filter(F.transform(c, clean_for_tts), lambda p: p != "")
    return packed(F.transform(parts, lambda p: F.concat(p, F.lit("\n\n"))), longest)


def exploded(rows: DataFrame, chunks: Column, *keys: str) -> DataFrame:
    """``keys, chunk_no`` (from 1) ``, text, chars, words``."""
    out = rows.select(*keys, F.posexplode(chunks).alias("chunk_no", "text"))
    return out.select(*keys, (F.col("chunk_no") + 1).alias("chunk_no"), "text", F.length("text").alias("chars"), word_count(F.col("text")).alias("words"))


def _in_order(blocks: DataFrame, *fields: str, order: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *fields)))
    return blocks.groupBy("doc_id").agg(rows.alias("blocks"))


def block_chunks(blocks: DataFrame, *, longest: int = TEXT_CHARS, order: str = "block_no") -> DataFrame:
    """Blocks in chunks; blank lines around headings."""
    piece = lambda b: F.when(b["type"] == "heading", F.concat(F.lit("\n\n"), b["t"], F.lit("\n\n"))).otherwise(F.concat(b["t"], F.lit("\n\n")))
    rows = _in_order(blocks.withColumn("t", clean_for_tts(F.col("text"))).where("t <> ''"), "type", "t", order=order)
    return exploded(rows, packed(F.transform("blocks", piece), longest), "doc_id")


def ssml_chunks(blocks: DataFrame, *, longest: int = SSML_CHARS, order: str = "block_no") -> DataFrame:
    """``doc_id, chunk_no, ssml, n_blocks``: spoken blocks in documents whose parts' lengths add up to at most ``longest``."""
    rows = _in_order(blocks.withColumn("s", block_ssml(F.col("type"), F.col("text"))), "s", order=order).withColumn("parts", F.transform("blocks", lambda b: b["s"]))
    found = grouped(F.col("parts"), longest)
    out = rows.select("doc_id", F.posexplode(found).alias("chunk_no", "parts"))
    return out.select("doc_id", (F.col("chunk_no") + 1).alias("chunk_no"), F.concat(F.lit("<speak>\n"), F.array_join("parts", "\n"), F.lit("\n</speak>")).alias("ssml"), F.size("parts").alias("n_blocks"))


def chunk_manifest(sections: DataFrame, *, longest: int = TEXT_CHARS) -> DataFrame:
    """Chunks of sections (``doc_id, section_no, title, text``): numbers in the section and the document, sizes."""
    out = exploded(sections, text_chunks(F.col("text"), longest, F.col("title")), "doc_id", "section_no")
    piece = Window.partitionBy("doc_id", "section_no")
    every = Window.partitionBy("doc_id").orderBy("section_no", "chunk_no")
    return out.select("doc_id", F.format_string("chunk_%04d", F.row_number().over(every)).alias("chunk"), "section_no", F.col("chunk_no").alias("section_piece_index"), F.count("*").over(piece).alias("section_piece_total"), "chars", "words", "text")
