"""A training corpus from ``documents``: five stages, each a function (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontamination, language_id, line_dedup, ngram_jaccard
from lectern.llm.common import documents, stored
from lectern.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language (null, or without any letter); fills missing labels with the prediction.

    Where no document has a label, nothing can be learned or filled in, and
    documents with letters stay as they are.
    """
    net = language_id.train(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("__own"), "text")
    kept = language_id.predict(own, net).where(F.col("lang_pred") != language_id.UNKNOWN).select("lang_pred", "text", "__own.*")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines, and documents of which nothing else is left."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return ngram_jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents contaminated with benchmark items."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of their decoding."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmark),
    ("bpe", tokens),
]

#: Language identification and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
