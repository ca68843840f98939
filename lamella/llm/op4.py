"""Query of operator 4: greedy word-piece counts of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import common
from lamella.llm.op3 import vocabulary
from lamella.llm.wordpiece import count_tokens


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return count_tokens(common.table(spark, sf_dir, "documents"), vocabulary())
