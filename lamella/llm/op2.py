"""Query of operator 2: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import common
from lamella.llm.neardup import near_duplicates

SHINGLE, PERCENT = 3, 85
#: The same by comparing all pairs that share a shingle, and a recursive closure of the links.
SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) end as s
  from words
), each as (select doc_id, unnest(s) as g from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from each a join each b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), both_ways as (select a, b from links union all select b, a from links),
reached(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reached r join both_ways l on r.b = l.a)
select d.doc_id, len(s.s)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join sets s using (doc_id) join (select a as doc_id, min(b) as component_id from reached group by a) c using (doc_id)
"""


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    found = near_duplicates(common.table(spark, sf_dir, "documents"), SHINGLE, PERCENT)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
