"""Versions of texts, selections, lookups, caches, and ordered joins of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.functions.tokens import table_tokens


def overlay(original: DataFrame, *newer: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The last version of each text. ``newer`` goes from lowest to highest precedence; an empty newer text deletes, a missing one does not."""
    out, names = original.withColumnRenamed(text, "__0"), ["__0"]
    for k, version in enumerate(newer, 1):
        out = out.join(version.select(*keys, F.col(text).alias(f"__{k}")), keys, "left")
        names.insert(0, f"__{k}")
    return out.withColumn(text, F.coalesce(*names)).drop(*names).where(strip(F.coalesce(text, F.lit(""))) != "")


def selected(sections: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen sections that are not blank."""
    return sections.join(chosen.select(*keys), keys, "left_semi").where(strip(F.col("text")) != "")


def first_nonempty(*sources: DataFrame) -> DataFrame:
    """The first source with rows; an error if there is none."""
    for s in sources:
        if s.limit(1).count():
            return s
    raise ValueError("no source has rows")


def told_maps(told: DataFrame, key: str = "id", *, order: str | None = None) -> DataFrame:
    """``doc_id, told``: a map from ``key`` to text for each document. Of a key told twice the last by ``order`` counts, else the greatest text."""
    last = F.max_by("text", F.struct(order, "text")) if order else F.max("text")
    one = told.where(F.col(key).isNotNull()).groupBy("doc_id", key).agg(last.alias("text"))
    return one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "text"))).alias("told"))


def missing_explanations(blocks: DataFrame, explanations: DataFrame, *, order: str = "block_no") -> DataFrame:
    """``doc_id, table_id, caption`` of the first token of each table that its document's explanations (``doc_id, id, text``) lack."""
    found = blocks.select("doc_id", order, F.posexplode(table_tokens(F.col("text"))).alias("k", "t")).select("doc_id", order, "k", "t.*")
    first = F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy(order, "k"))
    known = explanations.where(strip(F.coalesce("text", F.lit(""))) != "").select("doc_id", F.col("id").alias("table_id"))
    return found.withColumn("rn", first).where("rn = 1").join(known, ["doc_id", "table_id"], "left_anti").select("doc_id", "table_id", "caption")


def cached(requests: DataFrame, cache: DataFrame, key: str = "sha256") -> DataFrame:
    """Requests with what a cache (``sha256, latex, provider``) knows; the provider of a bare entry is 'cache'."""
    known = cache.select(key, F.col("latex").alias("latex"), F.coalesce("provider", F.lit("cache")).alias("provider"))
    return requests.join(known, key, "left")


def upserted(cache: DataFrame, fresh: DataFrame, key: str = "sha256") -> DataFrame:
    """The cache with newer rows in place of older."""
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], least: int = 2000) -> DataFrame:
    """Parts still to make: those without an output of more than ``least`` bytes."""
    return wanted.join(done.where(F.col("bytes") > least).select(*keys), keys, "left_anti")


def merged_audio(parts: DataFrame, *, order: str = "part_no") -> DataFrame:
    """``doc_id, n_parts, frames`` of parts (``doc_id, params, frames``) in order; an error where parameters differ."""
    whole = F.expr(f"listagg(frames, X'') WITHIN GROUP (ORDER BY `{order}`)")
    out = parts.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.min("params").alias("low"), F.max("params").alias("high"), whole.alias("frames"))
    same = F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("parts have different parameters"))).otherwise(F.col("frames"))
    return out.select("doc_id", "n_parts", same.alias("frames"))


def section_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (``doc_id, file``) with the ``path`` of their file: the path as it is recorded where it exists, else that of the same name.

    ``files``: ``doc_id, path``. Rows without a file have a null path.
    """
    name = lambda c: F.regexp_extract(c, r"([^/\\]+)$", 1)
    exact = files.select("doc_id", F.col("path").alias("file"), F.col("path").alias("__exact")).distinct()
    named = files.groupBy("doc_id", name(F.col("path")).alias("__name")).agg(F.min("path").alias("__named"))
    out = manifest.withColumn("__name", name(F.col("file"))).join(exact, ["doc_id", "file"], "left").join(named, ["doc_id", "__name"], "left")
    return out.withColumn("path", F.coalesce("__exact", "__named")).drop("__name", "__exact", "__named")


def ordered_files(files: DataFrame, name: str = "name") -> DataFrame:
    """By leading number, then by name; names without number last."""
    return files.orderBy(F.coalesce(F.regexp_extract(name, r"^(\d+)_", 1).try_cast("int"), F.lit(999999)), name)


def newest_job(paths: DataFrame, name: str = "name") -> DataFrame:
    return paths.where(F.col(name).startswith("job_")).orderBy(F.desc(name)).limit(1)


def block_of(blocks: DataFrame, block_id: str) -> DataFrame:
    """One block; ``KeyError`` if it does not exist."""
    out = blocks.where(F.col("block_id") == block_id)
    if not out.limit(1).count():
        raise KeyError(block_id)
    return out
