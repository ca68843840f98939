"""Query of operator 8: all documents packed into sequences of at most 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import common
from lamella.llm.op3 import vocabulary
from lamella.llm.packing import pack

CAPACITY, END_ID = 2048, 0


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, vocabulary(), CAPACITY, END_ID)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return packed(common.table(spark, sf_dir, "documents"))
