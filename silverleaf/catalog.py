"""A library: a folder of Parquet tables, each replaced as a whole by a staged write."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import schema


#: Seconds after which a number that was claimed without a snapshot counts as left by a writer that died.
CLAIM = 600


class Stale(RuntimeError):
    """Someone else has written a table since it was read."""


class Library:
    """Tables under one folder of any file system that Spark reads.

    A table is a folder of snapshots and of empty marker files, each named with a number
    and the snapshot that it put in force; the highest number counts. A write makes a new
    snapshot and then its marker, in one step that is done or not, so readers see the old
    table or the new one, a failed job leaves the old one, and a plan may read the table
    that it rewrites. A write takes the number after the one that was in force when this
    object last read the table; if that is taken, another's rows would be lost, so the
    write fails as Stale, and the job can read again. A table that this object has not
    read since it last wrote it is replaced as it stands.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.listeners: list[Callable[[str], None]] = []
        self._seen: dict[str, int] = {}
        stored = self._current("_schema")
        if stored is None:
            self._mark("_schema", str(schema.SCHEMA_VERSION))
        elif int(stored) != schema.SCHEMA_VERSION:
            names = [t for t in schema.TABLES if self._current(t)]
            for name, df in schema.migrate({t: self._stored(t) for t in names}, int(stored)).items():
                self.write(name, df)
            self._mark("_schema", str(schema.SCHEMA_VERSION))

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _markers(self, name: str) -> list[tuple[int, str]]:
        """(number, snapshot) of every marker in order; the snapshot is empty where a number was only claimed."""
        fs, path = self._path(f"{name}/_markers")
        found = [s.getPath().getName().partition(".") for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(n), snapshot) for n, _, snapshot in found)

    def _current(self, name: str) -> str | None:
        return next((snapshot for _, snapshot in reversed(self._markers(name)) if snapshot), None)

    def _version(self, name: str) -> int:
        """The number in force, or that of a later claim whose writer died."""
        markers = self._markers(name)
        version = max((n for n, snapshot in markers if snapshot), default=0)
        for n in sorted({n for n, _ in markers if n > version}):
            fs, claim = self._path(f"{name}/_markers/{n:012d}")
            if time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 < CLAIM:
                break
            version = n
        return version

    def _mark(self, name: str, snapshot: str, after: int | None = None) -> None:
        number = (self._version(name) if after is None else after) + 1
        fs, claim = self._path(f"{name}/_markers/{number:012d}")
        if not fs.createNewFile(claim):
            raise Stale(f"{name} has been written by someone else since it was read")
        fs.createNewFile(self._path(f"{name}/_markers/{number:012d}.{snapshot}")[1])

    def _stored(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/{self._current(table)}")

    def read(self, table: str) -> DataFrame:
        self._seen[table] = self._version(table)  # before the snapshot: a write in between is noticed
        current = self._current(table)
        if current is None:
            return self.spark.createDataFrame([], schema.struct(table))
        return self.spark.read.schema(schema.struct(table)).parquet(f"{self.root}/{table}/{current}")

    def write(self, table: str, df: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        writer = schema.conform(table, df).write
        if table in schema.PARTITIONS:
            writer = writer.partitionBy(*schema.PARTITIONS[table])
        writer.parquet(f"{self.root}/{table}/{name}")
        self._mark(table, name, self._seen.pop(table, None))
        for tell in self.listeners:  # caches built from the table are stale now
            tell(table)

    def vacuum(self, table: str) -> None:
        """Remove the snapshots that are no longer in force, and their markers."""
        fs, path = self._path(table)
        markers = [m for m in self._markers(table) if m[1]]
        if not markers:
            return
        for status in fs.listStatus(path):
            if status.getPath().getName() not in (markers[-1][1], "_markers"):
                fs.delete(status.getPath(), True)
        for number, snapshot in markers[:-1]:
            fs.delete(self._path(f"{table}/_markers/{number:012d}.{snapshot}")[1], False)
