"""Query of operator 1: a quality score for every document, learned from four fifths of the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import common
from lamella.llm.classifier import fit, with_score

THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned. A null doc_id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score at least THRESHOLD, in a model learned from all labels but the held-out ones."""
    name = next(x for x in ("score", *(f"score_{k}" for k in range(99))) if x not in {c.lower() for c in docs.columns})
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return with_score(docs, model, name).where(F.col(name) >= THRESHOLD).select(docs.columns)
