"""Query of operator 3: every text encoded and decoded, with digests of both and the number of joins of its tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import common
from lamella.llm.bpe import encode_decode


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(encoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and decoded text, in SQL functions."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_joins",
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return digest(encode_decode(common.table(spark, sf_dir, "documents"), vocabulary()))
