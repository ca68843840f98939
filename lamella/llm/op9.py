"""Query of operator 9: all documents in 40 shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import common
from lamella.llm.sharding import row_bytes, shard

SHARDS = 40


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return shard(common.table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        row_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
