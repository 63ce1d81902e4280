"""Recognisers one after another, each only for what those before it did not read well.

Equal contents are read once, and known ones not at all: rows are keyed by a
hash of the content and looked up in a cache first. What is left goes to
Python in batches; a recogniser is made once a worker and called with the rows
that all before it failed on. A recogniser that raises is asked again row by
row, so that one bad row spoils no other, and a row that it still fails on goes
on to the next with the error kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.overlay import upserted

#: What a recogniser is: called with contents, it gives a text or None for each.
Recogniser = Callable[[list[bytes]], Sequence[str | None]]
#: A name, and what makes the recogniser on the worker.
Provider = tuple[str, Callable[[], Recogniser]]

RESULT = "latex string, provider string, error string"

_MADE: dict[str, Recogniser] = {}


def good(text: str | None) -> bool:
    """The gate that a reading must pass: three characters at least, at most one '?'."""
    t = (text or "").strip()
    return len(t) >= 3 and t.count("?") < 2


def _asked(recogniser: Recogniser, contents: list[bytes]) -> list[tuple[str | None, str | None]]:
    """A reading or an error for each."""
    try:
        out = list(recogniser(contents))
        if len(out) != len(contents):
            raise ValueError(f"{len(out)} readings of {len(contents)} contents")
        return [(x, None) for x in out]
    except Exception as whole:  # a recogniser may fail in any way
        if len(contents) == 1:
            return [(None, f"{type(whole).__name__}: {whole}")]
        return [_asked(recogniser, [c])[0] for c in contents]


def read(contents: list[bytes], providers: Sequence[Provider], gate: Callable[[str | None], bool] = good) -> list[tuple[str | None, str | None, str | None]]:
    """Reading, provider and error of each content; the errors of all that failed, where none did well."""
    out: list[tuple[str | None, str | None, str | None]] = [(None, None, None)] * len(contents)
    errors: list[list[str]] = [[] for _ in contents]
    left = list(range(len(contents)))
    for name, make in providers:
        if not left:
            break
        try:
            if name not in _MADE:
                _MADE[name] = make()
            answers = _asked(_MADE[name], [contents[k] for k in left])
        except Exception as failed:  # it could not be made: nobody loses a row by that
            answers = [(None, f"{type(failed).__name__}: {failed}")] * len(left)
        still = []
        for k, (text, error) in zip(left, answers, strict=True):
            if error is None and gate(text):
                out[k] = (text, name, None)
                continue
            still.append(k)
            if error:
                errors[k].append(f"{name}: {error}")
        left = still
    for k in left:
        out[k] = (None, None, "; ".join(errors[k]) or None)
    return out


def readings(rows: DataFrame, providers: Sequence[Provider], *, content: str = "image", key: str = "sha256", gate: Callable[[str | None], bool] = good, batch: int = 64) -> DataFrame:
    """``key, latex, provider, error`` of each different content of ``rows``; ``batch`` contents go to a recogniser at once. Lazy."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                found = pd.DataFrame(read([bytes(c) for c in part["content"]], providers, gate), columns=["latex", "provider", "error"], dtype="object")
                yield pd.concat([part[[key]].reset_index(drop=True), found], axis=1)

    own = rows.where(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias(key), F.col(content).alias("content"))
    return own.groupBy(key).agg(F.first("content").alias("content")).mapInPandas(run, f"{key} string, {RESULT}")


def with_readings(rows: DataFrame, found: DataFrame, *, content: str = "image", key: str = "sha256") -> DataFrame:
    """``rows`` with ``key, latex, provider, error`` of their content; a row without content has the error 'no content'."""
    out = rows.withColumn(key, F.sha2(F.col(content), 256)).join(found, key, "left")
    error = F.when(F.col(content).isNull(), F.lit("no content")).otherwise(F.col("error"))
    return out.withColumn("error", error).select(*rows.columns, key, "latex", "provider", "error")


def recognised(rows: DataFrame, providers: Sequence[Provider], folder: str, *, content: str = "image", key: str = "sha256", **options) -> DataFrame:
    """``with_readings`` of contents that no earlier run read, and of the cache below ``folder`` for others.

    The cache is a Parquet table for each run, numbered; a run that was cut off
    left no success mark and is overwritten. Failures are kept with their
    errors and tried again by the next run; of a content read in several runs
    the last counts.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    kind = f"{key} string, {RESULT}"
    table = lambda n: spark.read.schema(kind).parquet(f"{folder}/{n}")
    cache, n = spark.createDataFrame([], kind), 0
    while fs.exists(path(f"{folder}/{n}/_SUCCESS")):
        cache = upserted(cache, table(n).where("latex is not null"), key)
        n += 1
    new = rows.withColumn(key, F.sha2(F.col(content), 256)).join(cache.select(key), key, "left_anti")
    readings(new, providers, content=content, key=key, **options).write.mode("overwrite").parquet(f"{folder}/{n}")
    return with_readings(rows, upserted(cache, table(n), key), content=content, key=key)
