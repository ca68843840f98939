"""Versioned tables. A version is a small manifest that lists immutable Parquet files; a commit makes it the current one.

Readers keep the version they began with. A writer that finds another version current than it began with fails, and
nothing of it is seen. Commands touch only files that hold matching rows: an insert adds a file, a delete or an update
rewrites those files and carries all others over by name. `compacted` puts many small files into few.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.kinds import Kind
from lamella.sources.files import Files
from lamella.sources.log import Conflict, Log

__all__ = ["Conflict", "Table", "Version"]


@dataclass(frozen=True)
class Version:
    """name: that of the manifest this version was read from, or made from; none for a new table."""

    name: str | None
    fields: tuple[tuple[str, Kind], ...]
    files: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, k.spark) for n, k in self.fields])

    def to_json(self) -> dict:
        return {"fields": [[n, k.length] for n, k in self.fields], "files": list(self.files)}


class Table:
    def __init__(self, spark: SparkSession, path: str, name: str, log: Log | None = None):
        self.spark, self.name, self.path = spark, name.lower(), f"{path}/tables/{name.lower()}"
        self.files = Files(spark)
        self.log = log or Log(self.files, path)

    def version(self, name: str) -> Version:
        got = self.files.read_json(f"{self.path}/versions/{name}.json")
        return Version(name, tuple((n, Kind(k)) for n, k in got["fields"]), tuple(f"{self.path}/{f}" for f in got["files"]))

    def latest(self) -> Version | None:
        name = self.log.latest().tables.get(self.name)
        return self.version(name) if name else None

    def written(self, v: Version) -> str:
        """Writes a manifest, which counts once a commit names it."""
        name = uuid.uuid4().hex
        out = v.to_json()
        out["files"] = [f.removeprefix(f"{self.path}/") for f in out["files"]]
        if not self.files.create_json(f"{self.path}/versions/{name}.json", out):
            raise Conflict(name)
        return name

    def publish(self, v: Version) -> Version:
        """A commit of this table alone."""
        name = self.written(v)
        self.log.commit({self.name: name}, {self.name: v.name})
        return replace(v, name=name)

    def read(self, v: Version) -> DataFrame:
        if not v.files:
            return self.spark.createDataFrame([], v.schema)
        return self.spark.read.schema(v.schema).parquet(*v.files)

    def read_files(self, v: Version, first: int, end: int) -> DataFrame:
        """A chunk of a table: the rows of files first to end - 1 of a version."""
        return self.read(replace(v, files=v.files[first:end]))

    def write_files(self, df: DataFrame, sort: tuple[str, ...] = ()) -> tuple[str, ...]:
        """New files with the rows of df, sorted within each file by indexed fields."""
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
        return tuple(f"{path}/{n}" for n in self.files.names(path) if n.endswith(".parquet"))

    # new versions; nothing is seen before publish

    def insert(self, v: Version, rows: DataFrame, sort: tuple[str, ...] = ()) -> Version:
        return replace(v, files=v.files + self.write_files(rows, sort))

    def _touched(self, v: Version, hit: Column) -> tuple[list[str], int]:
        """Files with rows that match, and how many match. Files come to the driver by name, as a manifest does."""
        if not v.files:
            return [], 0
        rows = self.read(v).where(hit).groupBy(F.col("_metadata.file_path").alias("file")).count().collect()
        by_name = {f.rpartition("/data/")[2]: f for f in v.files}
        return [by_name[r["file"].rpartition("/data/")[2]] for r in rows], sum(r["count"] for r in rows)

    def _rewritten(self, v: Version, touched: list[str], rows: DataFrame, sort: tuple[str, ...]) -> Version:
        gone = set(touched)
        return replace(v, files=tuple(f for f in v.files if f not in gone) + self.write_files(rows, sort))

    def delete(self, v: Version, hit: Column, sort: tuple[str, ...] = ()) -> tuple[Version, int]:
        """Rows for which the predicate is null stay."""
        touched, n = self._touched(v, hit)
        if not n:
            return v, 0
        old = self.spark.read.schema(v.schema).parquet(*touched)
        return self._rewritten(v, touched, old.where(~F.coalesce(hit, F.lit(False))), sort), n

    def update(self, v: Version, hit: Column, name: str, value: Column, sort: tuple[str, ...] = ()) -> tuple[Version, int]:
        """Counts the rows that match, whether or not their value changes."""
        touched, n = self._touched(v, hit)
        if not n:
            return v, 0
        old = self.spark.read.schema(v.schema).parquet(*touched)
        new = F.when(F.coalesce(hit, F.lit(False)), value).otherwise(F.col(f"`{name}`"))
        rows = old.select(*((new if c == name else F.col(f"`{c}`")).alias(c) for c in old.columns))
        return self._rewritten(v, touched, rows, sort), n

    def compacted(self, v: Version, files: int = 1, sort: tuple[str, ...] = ()) -> Version:
        """The same rows in so many files."""
        return replace(v, files=self.write_files(self.read(v).repartition(files), sort)) if len(v.files) > files else v

    def vacuum(self, kept: list[Version], older: float) -> int:
        """Deletes manifests and data files that no kept version names and that are older than so many seconds; returns how many."""
        names, data, gone = {v.name for v in kept}, {f.split("/data/")[1].split("/")[0] for v in kept for f in v.files}, 0
        for folder, wanted in (("versions", lambda n: n.removesuffix(".json") in names), ("data", data.__contains__)):
            for n in self.files.names(f"{self.path}/{folder}"):
                at = f"{self.path}/{folder}/{n}"
                if not wanted(n) and self.files.age(at) >= older:
                    self.files.delete(at)
                    gone += 1
        return gone
