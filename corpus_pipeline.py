"""Documents to packed training sequences: STAGES in order, each a function of (spark, docs, sf_dir).

Null and empty texts fail the base rule and go in the first stage. Rows that repeat are judged each by itself; near_dedup
keeps one row of a doc_id, that with the least text, and rows without a doc_id. Columns with clashing names pass through
all stages but the last, which gives doc_id, piece and place alone. Tables without rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import common, neardup, op1, op5, op8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    common.tune(spark)
    return op5.drop_rejected(docs, common.table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low score go."""
    common.tune(spark)
    return op1.drop_low_quality(spark, docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: five-word shingles, similarity of 0.8 or more."""
    common.tune(spark)
    return neardup.drop_near_duplicates(docs, 5, 80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    common.tune(spark)
    return op8.packed(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]
#: SQL has no words for learned rules, a fitted model or best fit. Tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied to documents. A stage's result is written as Parquet and read again for the next one."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name)
    return docs
