"""Output by document that is replaced as a whole or not at all.

A run writes its rows below ``runs/<run>`` and then a record of the documents
that it covers, put in place by one rename. Readers take each document from the
last run whose record covers it, so what an unfinished run left is never seen,
and the older output stays readable until the record is there. A run that is
repeated after its record was written does nothing; before that it starts anew.
``sweep`` removes what no record needs any more.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class CommittedOutput:
    """A folder of such output; ``key`` is the column that names a row's document."""

    def __init__(self, spark: SparkSession, folder: str, *, key: str = "doc_id") -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, sub: str) -> list[str]:
        at = self._path(f"{self.folder}/{sub}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def commits(self) -> list[tuple[int, str]]:
        """Number and run of every record, in order."""
        found = (re.fullmatch(r"(\d+)-(.+)", n) for n in self._names("commits"))
        return sorted((int(m[1]), m[2]) for m in found if m)

    def write(self, rows: DataFrame, run: str, *, covers: DataFrame | None = None) -> bool:
        """Replace the documents of ``rows``, and those of ``covers`` (a table with the key), by what ``rows`` has of them. Whether anything was done."""
        if not re.fullmatch(r"[\w.-]+", run):
            raise ValueError(f"not a name for a run: {run!r}")
        if any(r == run for _, r in self.commits()):
            return False
        data = f"{self.folder}/runs/{run}"
        rows.write.mode("overwrite").parquet(data)
        keys = self.spark.read.schema(rows.schema).parquet(data).select(self.key)
        if covers is not None:
            keys = keys.union(covers.select(self.key))
        staged = f"{self.folder}/commits/.{run}"
        keys.distinct().write.mode("overwrite").parquet(staged)
        self._put(staged, run)
        return True

    def _put(self, staged: str, run: str) -> None:
        """The record under the next number. Of two writers at once, the one whose run sorts last counts as the later."""
        n = max((k for k, _ in self.commits()), default=0) + 1
        if not self._fs.rename(self._path(staged), self._path(f"{self.folder}/commits/{n:012d}-{run}")):
            raise OSError(f"could not commit {run}")

    def owners(self) -> DataFrame:
        """``key, run``: the run that each document is taken from. Null keys are a document, too."""
        every = None
        for k, (n, run) in enumerate(self.commits()):
            own = self.spark.read.parquet(f"{self.folder}/commits/{n:012d}-{run}").select(self.key, F.lit(k).alias("__n"), F.lit(run).alias("run"))
            every = own if every is None else every.unionByName(own)
        if every is None:
            raise FileNotFoundError(f"nothing committed in {self.folder}")
        last = Window.partitionBy(self.key).orderBy(F.desc("__n"))
        return every.withColumn("__first", F.row_number().over(last)).where("__first = 1").select(self.key, "run")

    def read(self) -> DataFrame:
        """All documents, each from its last run; columns that a run lacks are null."""
        every, there = None, set(self._names("runs"))
        for run in [r for _, r in self.commits() if r in there]:
            own = self.spark.read.parquet(f"{self.folder}/runs/{run}").withColumn("__run", F.lit(run))
            every = own if every is None else every.unionByName(own, allowMissingColumns=True)
        owners = self.owners().withColumnsRenamed({self.key: "__key", "run": "__own"})
        if every is None:
            raise FileNotFoundError(f"nothing committed in {self.folder}")
        return every.join(owners, every[self.key].eqNullSafe(owners["__key"]) & (F.col("__run") == F.col("__own")), "left_semi").drop("__run")

    def sweep(self) -> list[str]:
        """Delete the data of runs that own no document and of unfinished ones; not while another run is being written."""
        live = {r["run"] for r in self.owners().select("run").distinct().collect()}
        gone = [f"runs/{n}" for n in self._names("runs") if n not in live] + [f"commits/{n}" for n in self._names("commits") if n.startswith(".")]
        for name in gone:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        return gone
