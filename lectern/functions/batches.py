"""How many rows Python gets at once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python ``rows`` documents at a time, where the session has Spark's default of 10000: a batch of whole documents is held several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
