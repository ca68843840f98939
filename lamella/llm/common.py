"""What the operators share: the folder that all executors see, written tables, and words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset, a temporary one, but only where driver and executors share a machine."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        folder = tempfile.mkdtemp(prefix="lamella-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own.append("file://" + folder)
    return _own[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Spark deletes it when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def write_table(df: DataFrame, name: str) -> str:
    """Writes df to the shared folder and returns the path."""
    path = f"{scratch(df.sparkSession, name)}/t"
    df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: short lineage that outlives lost executors."""
    path = write_table(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(df.written_path.rpartition("/")[0])
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def tune(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as rows, so that very long texts do not make a huge batch. What the user has set stays."""
    for key, value, default in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "4194304", None)):
        now = spark.conf.get(key, None)
        if now is None or now == default or (default is None and int(now) > 64 << 20):
            spark.conf.set(key, value)


def lean(batches):
    """Batches as they come; after each one Arrow gives memory that it holds in reserve back to the system."""
    import pyarrow as pa

    for b in batches:
        yield b
        pa.default_memory_pool().release_unused()


def as_bytes(column) -> list:
    """UTF-8 bytes of an Arrow string column; null becomes empty."""
    import pyarrow as pa

    large = pa.types.is_large_string(column.type)
    return [x or b"" for x in column.cast(pa.large_binary() if large else pa.binary()).to_pylist()]
