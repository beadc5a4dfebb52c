"""Table lifecycle: schema evolution, soft deletes, and versions with staged commits and time travel.

A versioned table is a folder with one Parquet folder for each version and a log of JSON files, one a version. Paths go through
Hadoop's file system, so any store that Spark reads will do. A version becomes visible when its log file is
created; creation fails if the file exists, so of two writers of the same version one loses with an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def evolve(df: DataFrame, target: T.StructType) -> DataFrame:
    """The columns of ``target`` in its order: by name, missing ones null, others left out; values are cast to the target's types."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target])


class Tombstones:
    """Rows deleted by key without rewriting the table: a small table of row ids beside it."""

    def __init__(self, deleted: DataFrame, row_id: str = "row_id"):
        self.row_id = row_id
        self.deleted = deleted.select(F.col(row_id)).filter(F.col(row_id).isNotNull()).distinct()

    @classmethod
    def none(cls, spark: SparkSession, row_id: str = "row_id") -> "Tombstones":
        return cls(spark.createDataFrame([], f"{row_id} long"), row_id)

    @classmethod
    def load(cls, spark: SparkSession, path: str, row_id: str = "row_id") -> "Tombstones":
        return cls(spark.read.parquet(path), row_id)

    def save(self, path: str) -> None:
        self.deleted.write.mode("overwrite").parquet(path)

    def delete(self, rows: DataFrame) -> "Tombstones":
        """Also these rows; deleting a row again changes nothing."""
        return Tombstones(self.deleted.unionByName(rows.select(self.row_id)), self.row_id)

    def active(self, df: DataFrame) -> DataFrame:
        """The rows that are not deleted; ids that the table lacks are ignored."""
        return df.join(self.deleted, self.row_id, "left_anti")

    def active_count(self, df: DataFrame) -> DataFrame:
        return self.active(df).agg(F.count("*").alias("n_active"))


def _instant(text: str) -> datetime:
    """A moment as text, in any form of ISO 8601; without a zone it is UTC."""
    moment = datetime.fromisoformat(text)
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


@dataclass(frozen=True)
class Version:
    version: int
    timestamp: str
    message: str
    path: str
    rows: int

    def line(self) -> str:
        return f"v{self.version} {self.timestamp} {self.message}"


class VersionedTable:
    """A table with a version log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self, version: int) -> str:
        return f"{self.path}/_log/{version:08d}.json"

    def versions(self) -> list[Version]:
        """All versions, oldest first; files that are no log entries are passed over."""
        folder = self._path(f"{self.path}/_log")
        if not self._fs.exists(folder):
            return []
        found = []
        for status in self._fs.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit():
                stream = self._fs.open(status.getPath())
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                try:
                    found.append(Version(**json.loads(text)))
                except (ValueError, TypeError):
                    continue
        return sorted(found, key=lambda v: v.version)

    def _next(self) -> int:
        """After the largest number that any log file has: an entry that its writer did not finish keeps its number, and blocks nobody."""
        folder = self._path(f"{self.path}/_log")
        if not self._fs.exists(folder):
            return 1
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return 1 + max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def latest(self) -> Version | None:
        found = self.versions()
        return found[-1] if found else None

    def history(self) -> list[str]:
        return [v.line() for v in self.versions()]

    def begin(self, df: DataFrame) -> "Staged":
        """Write the data of the next version where no reader looks."""
        version = self._next()
        staged = f"{self.path}/data/v{version:08d}-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        return Staged(self, version, staged)

    def commit(self, df: DataFrame, message: str = "") -> Version:
        return self.begin(df).commit(message)

    def checkout(self, version: int) -> DataFrame:
        """The table as of a version; an unknown one is an error."""
        for v in self.versions():
            if v.version == version:
                return self.spark.read.parquet(v.path)
        raise ValueError(f"{self.path} has no version {version}")

    def as_of(self, moment: str) -> DataFrame:
        """The table as it was at a moment (ISO 8601; UTC unless it says otherwise): the last version that is not later."""
        found = [v for v in self.versions() if _instant(v.timestamp) <= _instant(moment)]
        if not found:
            raise ValueError(f"{self.path} has no version at {moment}")
        return self.spark.read.parquet(found[-1].path)

    def current(self) -> DataFrame:
        last = self.latest()
        if last is None:
            raise ValueError(f"{self.path} has no version")
        return self.spark.read.parquet(last.path)


class Staged:
    """A version that is written but not visible."""

    def __init__(self, table: VersionedTable, version: int, path: str):
        self.table, self.version, self.path = table, version, path

    def commit(self, message: str = "", timestamp: str | None = None) -> Version:
        """Publish it. If another writer has published this version meanwhile, that is an error and the staged data stay for a retry."""
        t = self.table
        if timestamp is not None:
            _instant(timestamp)
        rows = t.spark.read.parquet(self.path).count()
        entry = Version(self.version, timestamp or datetime.now(timezone.utc).isoformat(timespec="microseconds"), message, self.path, rows)
        # create without overwriting: the store itself decides which of two writers wins
        try:
            stream = t._fs.create(t._path(t._log(self.version)), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise RuntimeError(f"version {self.version} was committed by another writer") from None
            raise
        stream.write(bytearray(json.dumps(asdict(entry)).encode()))
        stream.close()
        return entry

    def abort(self) -> None:
        """Delete the staged data."""
        self.table._fs.delete(self.table._path(self.path), True)
