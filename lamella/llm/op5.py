"""Query of operator 5: statistics and verdict of the quality rules for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import common
from lamella.llm.rules import judged, learn_rules
from lamella.llm.stats import COUNTS


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    rows, stats, failed, kept = judged(docs.select("doc_id", "text"), learn_rules(docs, labels))
    return rows.select("doc_id", *(F.col(stats)[k].alias(k) for k in COUNTS), failed.alias("base_failed"), kept.alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep."""
    rows, _, _, kept = judged(docs, learn_rules(docs, labels))
    return rows.where(kept).select(docs.columns)
