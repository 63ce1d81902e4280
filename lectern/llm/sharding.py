"""A store of immutable shards with size-tiered compaction and versioned manifests.

``data/<run>/``        Parquet files of one append or merge; never changed once written
``pending/<run>``      a mark made before a run's files and taken away after its commit
``manifests/v<n>.json`` version n: its shards with their sizes, and its columns; made by one atomic rename, which fails if n exists

Readers take the newest manifest and see only files that it lists, so a crash
leaves files that nothing refers to (``vacuum`` removes them, once their mark
is old) but never a partial version. A writer that finds its version taken
commits on top of the newer one. Rows move by Spark's readers and writers only.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NumericType, StructType

#: Bytes of a full shard, of the lowest tier, ratio of tiers, and shards of a tier that start a merge.
TARGET, LOWEST, RATIO, FANOUT = 128 << 20, 1 << 20, 4, 4
#: Commits tried on top of other writers' versions, and seconds after which a mark counts as that of a dead writer.
TRIES, GRACE = 50, 24 * 3600
_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Shard:
    path: str
    size: int

    def tier(self, lowest: int = LOWEST, ratio: int = RATIO) -> int:
        return 0 if self.size <= lowest else 1 + int(math.log(self.size / lowest, ratio))


class ConflictError(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target: int = TARGET, lowest: int = LOWEST, fanout: int = FANOUT) -> None:
        self.spark, self.root, self.target, self.lowest, self.fanout = spark, root.rstrip("/"), target, lowest, fanout
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, where: str):
        return self._jvm.org.apache.hadoop.fs.Path(where)

    def _list(self, where: str) -> list:
        return list(self._fs.listStatus(self._path(where))) if self._fs.exists(self._path(where)) else []

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._list(f"{self.root}/manifests") if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """The version, newest if not given, and its shards; (0, []) before the first commit."""
        version, shards, _ = self._state(version)
        return version, shards

    def _state(self, version: int | None = None) -> tuple[int, list[Shard], StructType]:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, [], StructType()
        content = json.loads(self.spark.read.text(f"{self.root}/manifests/v{version:08d}.json", wholetext=True).first()[0])
        return version, [Shard(**s) for s in content["shards"]], StructType.fromJson(content["columns"])

    def _commit(self, version: int, shards: list[Shard], columns: StructType) -> int:
        """Make ``version``; ``ConflictError`` if it exists."""
        content = json.dumps({"version": version, "columns": columns.jsonValue(), "shards": [vars(s) for s in sorted(shards, key=lambda s: s.path)]})
        temporary, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/v{version:08d}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(content.encode()))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        none[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, final, none)
        except Exception as e:
            self._fs.delete(temporary, False)
            raise ConflictError(f"version {version} exists") from e
        return version

    def _written(self, folder: str) -> list[Shard]:
        return [Shard(s.getPath().toString(), s.getLen()) for s in self._list(folder) if s.getPath().getName().startswith("part-")]

    def _update(self, change: Callable[[list[Shard], StructType], tuple[list[Shard], StructType] | None]) -> int | None:
        """Commit what ``change`` makes of the newest version, again on top of any version that comes between; None if it makes nothing."""
        for _ in range(TRIES):
            version, shards, columns = self._state()
            made = change(shards, columns)
            if made is None:
                return None
            try:
                return self._commit(version + 1, *made)
            except ConflictError:
                continue
        raise ConflictError(f"{TRIES} versions came between")

    def _write(self, rows: DataFrame, by: str | None = None) -> tuple[str, str]:
        """Write a run's files under a mark; the folder and the mark."""
        run = uuid.uuid4().hex
        mark, folder = f"{self.root}/pending/{run}", f"{self.root}/data/{run}"
        self._fs.create(self._path(mark), False).close()
        (rows.write.partitionBy(by) if by else rows.write).parquet(folder)
        return folder, mark

    @staticmethod
    def _widened(columns: StructType, new: StructType) -> StructType:
        """All columns of both by name, nullable; ``ValueError`` where one has two types or names differ by case only."""
        out = {f.name: f for f in columns}
        lower = {f.name.lower(): f.name for f in columns}
        for f in new:
            if lower.setdefault(f.name.lower(), f.name) != f.name or f.name in out and out[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} {f.dataType.simpleString()} clashes with the store's {lower[f.name.lower()]}")
            out.setdefault(f.name, f)
        return StructType([type(f)(f.name, f.dataType, True) for f in out.values()])

    def append(self, rows: DataFrame) -> int:
        """One arrival as small shards; rows keep their columns, nulls and repetitions. An empty arrival makes a version, too.

        New columns widen the store's (null in older rows), missing ones are
        null; a column of another type is an error, and nothing is written.
        """
        self._widened(self._state()[2], rows.schema)
        folder, mark = self._write(rows)
        new = self._written(folder)
        version = self._update(lambda shards, columns: (shards + new, self._widened(columns, rows.schema)))
        self._fs.delete(self._path(mark), False)
        return version

    def append_each(self, rows: DataFrame, arrival: str) -> int:
        """Many arrivals in one pass: the rows of each value of the column ``arrival`` (which is not stored) are one.

        They are committed in the order of the values, numbers as numbers, null
        first; without rows there is one empty arrival.
        """
        schema = StructType([f for f in rows.schema if f.name != arrival])
        self._widened(self._state()[2], schema)
        number = isinstance(rows.schema[arrival].dataType, NumericType)
        folder, mark = self._write(rows, arrival)
        parts = {}
        for s in self._list(folder):
            name, _, value = s.getPath().getName().partition("=")
            if unquote(name) == arrival:
                parts[s.getPath().toString()] = (0, 0) if value == _NULL else (1, float(value) if number else unquote(value))
        version = None
        for part in sorted(parts, key=parts.get) or [None]:
            new = self._written(part) if part else []
            version = self._update(lambda shards, columns, new=new: (shards + new, self._widened(columns, schema)))
        self._fs.delete(self._path(mark), False)
        return version

    def due(self, shards: list[Shard]) -> list[list[Shard]]:
        """The tiers, lowest first, with ``fanout`` or more shards below half the target size that fewer files can hold."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target / 2:
                tiers.setdefault(s.tier(self.lowest), []).append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout and self._files(tiers[t]) < len(tiers[t])]

    def _files(self, shards: list[Shard]) -> int:
        return max(1, round(sum(s.size for s in shards) / self.target))

    def compact(self) -> int:
        """Merge tiers from the lowest up while any is due; the newest version.

        Each merge reads the tier's shards and writes them as files of the
        target size without a shuffle (whole input splits go to an output
        file), commits, and leaves the old files to ``vacuum``. A merge whose
        shards another writer has merged meanwhile is given up.
        """
        while True:
            version, shards, columns = self._state()
            tiers = self.due(shards)
            if not tiers:
                return version
            folder, mark = self._write(self._read(tiers[0], columns).coalesce(self._files(tiers[0])))
            gone, new = {s.path for s in tiers[0]}, self._written(folder)

            def merged(shards: list[Shard], columns: StructType, gone: set[str] = gone, new: list[Shard] = new):
                return ([s for s in shards if s.path not in gone] + new, columns) if gone <= {s.path for s in shards} else None

            self._update(merged)
            self._fs.delete(self._path(mark), False)

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Delete files that none of the newest ``keep`` versions lists, and older manifests.

        Files of runs under a mark that is no older than ``grace`` seconds stay:
        files are listed before marks and marks before manifests, so a run that
        is being written or committed is seen as one or the other.
        """
        files, found = self._fs.listFiles(self._path(f"{self.root}/data"), True), []
        while files.hasNext():
            found.append(files.next().getPath())
        marks = {s.getPath().getName(): s for s in self._list(f"{self.root}/pending")}
        writing = {run for run, s in marks.items() if time.time() - s.getModificationTime() / 1000 <= grace}
        versions = self.versions()
        live = {s.path for v in versions[-keep:] for s in self.manifest(v)[1]}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:08d}.json"), False)
        start = len(self._path(f"{self.root}/data").toUri().getPath()) + 1
        for path in found:
            run = path.toUri().getPath()[start:].split("/")[0]
            if path.toString() not in live and path.getName().startswith("part-") and run not in writing:
                self._fs.delete(path, False)
        for run in marks.keys() - writing:
            self._fs.delete(marks[run].getPath(), False)

    def unlisted(self) -> int:
        """Data files that the newest version does not list."""
        _, shards = self.manifest()
        live, files, n = {s.path for s in shards}, self._fs.listFiles(self._path(f"{self.root}/data"), True), 0
        while files.hasNext():
            path = files.next().getPath()
            n += path.getName().startswith("part-") and path.toString() not in live
        return n

    def _read(self, shards: list[Shard], columns: StructType) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; ``ValueError`` before the first."""
        number, shards, columns = self._state(version)
        if not number:
            raise ValueError("the store has no version")
        return self._read(shards, columns)
