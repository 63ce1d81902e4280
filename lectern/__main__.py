"""The plans from a command line: ``python -m lectern <command> <input> <output>``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import plans, sources
from lectern.functions import text as t
from lectern.operators import chunks, sections, toc


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """A file is a document."""
    return sources.document_rows(spark, path, sources.BLOCK).withColumn("block_no", F.monotonically_increasing_id())


def _named(rows: DataFrame, out: DataFrame) -> DataFrame:
    """With the document's name in front."""
    return rows.select("doc_id", "doc").distinct().join(out, "doc_id")


def sections_command(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Blocks (JSON) to sections."""
    rows = _blocks(spark, args.input)
    return _named(rows, sections.manifest(sections.build(rows)))


def normalize_command(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Section files to normalised texts."""
    texts = toc.drop_from_text(sources.document_sections(spark, args.input).select(F.struct("doc", "section_no", "name").alias("doc_id"), t.norm_unicode(F.col("text")).alias("text")))
    return texts.select("doc_id.*", plans.normalized_text(F.col("text")).alias("text"))


def blocks_command(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Blocks (JSON) to normalised blocks in the wider form."""
    return plans.normalize_blocks(_blocks(spark, args.input)).select("doc", "block_no", "page", "type", "text")


def ssml_command(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Section files to SSML."""
    return sources.document_sections(spark, args.input).select("doc", "section_no", "name", t.text_ssml(F.col("text")).alias("ssml"))


def chunks_command(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Section files to chunks for a voice."""
    return chunks.exploded(sources.document_sections(spark, args.input), chunks.text_chunks(F.col("text"), args.chars), "doc", "section_no", "name")


COMMANDS = {"sections": sections_command, "normalize": normalize_command, "blocks": blocks_command, "ssml": ssml_command, "chunks": chunks_command}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lectern", description=__doc__)
    own = parser.add_subparsers(dest="command", required=True)
    for name, command in COMMANDS.items():
        p = own.add_parser(name, help=command.__doc__)
        p.add_argument("input")
        p.add_argument("output", help="folder of JSON lines, replaced if it exists")
        if name == "chunks":
            p.add_argument("--chars", type=int, default=chunks.TEXT_CHARS)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    sources.write_json(COMMANDS[args.command](spark, args), args.output)


if __name__ == "__main__":
    main()
