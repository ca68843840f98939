"""Query of operator 7: ids of all documents written to plane files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import common
from lamella.llm.op3 import vocabulary
from lamella.llm.planes import read_ids, write_ids

END_ID = 1


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    back = read_ids(write_ids(common.table(spark, sf_dir, "documents"), vocabulary(), END_ID))
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
