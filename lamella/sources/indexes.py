"""Indexes as physical layout: a covering copy of a table's rows, arranged by one field.

`hash` deals rows into folders by the hash of the key, so a lookup lists one folder (partition pruning), and a join on the
key lists those that the other side needs (dynamic pruning). `btree` keeps rows in key order, so a lookup reads row groups
whose least and greatest keys enclose it (Parquet statistics).

One job builds the entries of all data files that have none: a build. Each entry names its data file, so what a command
rewrites is left out by name. Builds are recorded when they are whole; where there are more than MOST_BUILDS, or most
entries are stale, all are built anew as one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.kinds import family
from lamella.sources.files import Files
from lamella.sources.store import Table, Version

BUCKETS, MOST_BUILDS = 100, 12
BUCKET, FILE, BUILD = "bucket_of_key", "data_file", "build"


def short(file: str) -> str:
    return file.rpartition("/data/")[2]


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    field: str
    kind: str
    path: str
    buckets: int = BUCKETS

    def bucket(self, column: Column, kind: T.DataType) -> Column:
        """The bucket of a key; a value that the field's type cannot hold has none."""
        return F.pmod(F.xxhash64(column.try_cast(kind)), F.lit(self.buckets)).cast("int")

    def _builds(self, files: Files) -> list[tuple[str, set[str]]]:
        """Whole builds and the data files of each, newest first."""
        got = [files.read_json(f"{self.path}/builds/{n}") for n in files.names(f"{self.path}/builds") if n.endswith(".json")]
        return [(b["build"], set(b["files"])) for b in sorted(got, key=lambda b: -b["order"])]

    def _cover(self, builds: list[tuple[str, set[str]]], v: Version) -> tuple[dict[str, set[str]], list[str]]:
        """Which build gives the entries of which files, and the files that none has."""
        left, out = {short(f): f for f in v.files}, {}
        for build, has in builds:
            if mine := has & left.keys():
                out[build] = mine
                for f in mine:
                    del left[f]
        return out, list(left.values())

    def refresh(self, spark: SparkSession, v: Version) -> int:
        """Builds entries of files that have none, in one job; returns for how many."""
        files = Files(spark)
        builds = self._builds(files)
        cover, missing = self._cover(builds, v)
        if not missing:
            return 0
        entries = sum(len(has) for _, has in builds)
        if len(cover) >= MOST_BUILDS or entries - sum(map(len, cover.values())) > max(MOST_BUILDS, len(v.files)):
            missing = list(v.files)
        build = uuid.uuid4().hex
        rows = spark.read.schema(v.schema).parquet(*missing).withColumn(FILE, F.substring_index(F.col("_metadata.file_path"), "/data/", -1))
        at = f"{self.path}/{BUILD}={build}"
        if self.kind == "hash":
            rows.withColumn(BUCKET, self.bucket(F.col(self.field), v.schema[self.field].dataType)).repartition(BUCKET).sortWithinPartitions(BUCKET, self.field).write.partitionBy(BUCKET).parquet(at)
        else:
            rows.repartitionByRange(self.field).sortWithinPartitions(self.field).write.parquet(at)
        files.create_json(f"{self.path}/builds/{build}.json", {"build": build, "order": len(builds) and 1 + max(self._orders(files)), "files": [short(f) for f in missing]})
        return len(missing)

    def _orders(self, files: Files) -> list[int]:
        return [files.read_json(f"{self.path}/builds/{n}")["order"] for n in files.names(f"{self.path}/builds") if n.endswith(".json")]

    def prune(self, spark: SparkSession, kept: list[Version], older: float = 0) -> int:
        """Deletes builds that none of the versions needs and that are older than so many seconds; returns how many."""
        files = Files(spark)
        builds, needed, gone = self._builds(files), set(), 0
        for v in kept:
            needed |= self._cover(builds, v)[0].keys()
        for n in files.names(self.path):
            if n.startswith(f"{BUILD}=") and (b := n.partition("=")[2]) not in needed and files.age(f"{self.path}/{n}") >= older:
                files.delete(f"{self.path}/builds/{b}.json")
                files.delete(f"{self.path}/{n}")
                gone += 1
        return gone

    def rows(self, spark: SparkSession, table: Table, v: Version) -> DataFrame:
        """All rows of a version, in one scan of the index, with BUCKET where it is a hash index."""
        self.refresh(spark, v)
        own = T.StructType([*v.schema.fields, *([T.StructField(BUCKET, T.IntegerType())] if self.kind == "hash" else [])])
        if not v.files:
            return spark.createDataFrame([], own)
        builds = dict(self._builds(Files(spark)))
        cover, _ = self._cover(list(builds.items()), v)
        schema = T.StructType([*v.schema.fields, T.StructField(FILE, T.StringType()), T.StructField(BUILD, T.StringType()), *own.fields[len(v.fields) :]])
        out = spark.read.schema(schema).option("basePath", self.path).parquet(*(f"{self.path}/{BUILD}={b}" for b in cover))
        stale = [(b, f) for b, mine in cover.items() for f in sorted(builds[b] - mine)]
        for b, mine in cover.items():
            gone = [f for x, f in stale if x == b]
            if gone:
                entry = F.col(FILE).isin(sorted(mine)) if len(mine) < len(gone) else ~F.col(FILE).isin(gone)
                out = out.where((F.col(BUILD) != b) | entry)
        return out.select(*own.names)

    def fits(self, v: Version, value: int | str) -> bool:
        return family(v.schema[self.field].dataType) == ("text" if isinstance(value, str) else "number")

    def lookup(self, spark: SparkSession, table: Table, v: Version, value: int | str) -> DataFrame:
        """Rows whose field equals the value; a value of the other family matches none."""
        if not self.fits(v, value):
            return table.read(v).where(F.lit(False))
        hit = F.col(self.field) == F.lit(value)
        if self.kind == "hash":  # Catalyst folds the right side into a partition filter
            hit = hit & (F.col(BUCKET) == self.bucket(F.lit(value), v.schema[self.field].dataType))
        return self.rows(spark, table, v).where(hit).select(*v.schema.names)


@dataclass(frozen=True)
class Indexed:
    """A version of a table, read through an index of it: the inner side of an index join."""

    spark: SparkSession
    index: Index
    table: Table
    version: Version

    @property
    def columns(self) -> list[str]:
        return self.version.schema.names

    def rows(self) -> DataFrame:
        return self.index.rows(self.spark, self.table, self.version)

    def lookup(self, value: int | str) -> DataFrame:
        return self.index.lookup(self.spark, self.table, self.version, value)

    def bucket(self, column: Column) -> Column:
        return self.index.bucket(column, self.version.schema[self.index.field].dataType)
