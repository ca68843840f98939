"""The operators of the algebra. Each states what it computes; Catalyst and adaptive execution choose how."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.aggregates import Aggregate
from lamella.functions.kinds import compare, family
from lamella.plans.ast import Predicate
from lamella.plans.lower import condition
from lamella.plans.parser import parse_predicate
from lamella.sources.indexes import BUCKET, Indexed

#: Of a merge join: tasks at most, pairs for each row read from which groups multiply, and key types whose equal values hash alike.
MOST_TASKS, MULTIPLIED = 2048, 8
HASHED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "string", "binary", "date", "timestamp", "timestamp_ntz"}


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named fields, in this order."""
    return df.select(*(F.col(f"`{f}`") for f in fields))


def select_rows(df: DataFrame, predicate: str | Predicate) -> DataFrame:
    """Rows that satisfy the predicate."""
    p = parse_predicate(predicate) if isinstance(predicate, str) else predicate
    return df.where(condition(df, p))


def _apart(left: DataFrame, right: DataFrame, first: str = "left") -> tuple[DataFrame, DataFrame, list]:
    """Both inputs with own column names, and the output columns. Of two columns of one name, `first` keeps it alone."""
    own = [df.select(*(F.col(f"`{c}`").alias(f"{side}{k}") for k, c in enumerate(df.columns))) for side, df in (("l", left), ("r", right))]
    names = [(c, f"l{k}") for k, c in enumerate(left.columns)] + [(c, f"r{k}") for k, c in enumerate(right.columns)]
    keep = {c.lower(): o for c, o in (reversed(names) if first == "left" else names)}
    return *own, [F.col(o).alias(c) for c, o in names if keep[c.lower()] == o]


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows. Of two columns of one name the left one is seen."""
    a, b, out = _apart(left, right)
    return a.crossJoin(b).select(*out)


def _equal(left: DataFrame, right: DataFrame, left_field: str, right_field: str):
    names = [c.lower() for c in left.columns].index(left_field.lower()), [c.lower() for c in right.columns].index(right_field.lower())
    a, b = (df.schema.fields[k].dataType for df, k in zip((left, right), names, strict=True))
    return compare("=", F.col(f"l{names[0]}"), F.col(f"r{names[1]}"), family(a), family(b))


def merge_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str, pairs: int = 4_000_000, rows: int = 100_000) -> DataFrame:
    """Inner equi-join by sorting both sides; groups of equal keys on both sides multiply. The left name wins.

    The rows of each key are counted first, of a smaller right side those alone unless keys recur there. Where groups
    multiply, tasks are as many as the pairs ask for, `pairs` to each until there are MOST_TASKS: Spark sizes tasks by the
    bytes they read, which say nothing of the pairs. A key with more than a task's share, or more than `rows` right rows (a
    left row's pairs are held at once), is dealt in blocks: parts of its left rows by parts of its right ones. Each pair of
    rows meets in one block; each block is sorted and merged.
    """
    a, b, out = _apart(left, right)
    plain = a.join(b.hint("merge"), _equal(left, right, left_field, right_field))
    kind = _compared_as(plain)
    if kind is None:
        return plain.select(*out)
    keyed = []
    for side, df, columns, field in (("l", a, left.columns, left_field), ("r", b, right.columns, right_field)):
        key = F.col(f"{side}{[c.lower() for c in columns].index(field.lower())}").cast(kind)
        keyed.append(df.withColumn("key", key).where(F.col("key").isNotNull()))
    if _bytes(right) <= _bytes(left):
        recur = keyed[1].groupBy(F.xxhash64("key").alias("h")).count().agg(F.max("count")).first()[0]
        if (recur or 0) <= MULTIPLIED:
            return plain.select(*out)
    ones = [df.select(F.xxhash64("key").alias("h"), F.lit(n).alias("l"), F.lit(1 - n).alias("r")) for n, df in zip((1, 0), keyed, strict=True)]
    groups = ones[0].unionAll(ones[1]).groupBy("h").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).withColumn("pairs", F.col("l").cast("double") * F.col("r"))
    read, total, most, widest = groups.agg(F.sum(F.col("l") + F.col("r")), F.sum("pairs"), F.max("pairs"), F.max(F.when(F.col("l") > 0, F.col("r")))).first()
    share = max(pairs, (total or 0) / MOST_TASKS)
    if (most or 0) <= share and (widest or 0) <= rows and (total or 0) <= max(pairs, MULTIPLIED * (read or 0)):
        return plain.select(*out)
    large = groups.where((F.col("l") > 0) & ((F.col("pairs") > share) | (F.col("r") > rows))).collect()
    tasks = max(math.ceil(total / share), math.ceil(MULTIPLIED * read / pairs), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _dealt(*keyed, [(g["h"], *_parts(g["l"], g["r"], share, rows)) for g in large])
    on = ["key", "part", "other"] if large else ["key"]
    x, y = (df.withColumnsRenamed({c: f"{side}_{c}" for c in on}).repartition(tasks, *(f"{side}_{c}" for c in on)) for side, df in zip("lr", dealt, strict=True))
    return x.join(y.hint("merge"), [F.col(f"l_{c}") == F.col(f"r_{c}") for c in on]).select(*out)


def _compared_as(joined: DataFrame) -> str | None:
    """The type in which Spark compares the two fields of an equi-join; None where no equality, or no hash of it, is sure."""
    on = joined._jdf.queryExecution().analyzed().condition().get()
    kind = on.left().dataType().simpleString() if on.nodeName() == "EqualTo" else ""
    return kind if kind.partition("(")[0] in HASHED else None


def _parts(left: int, right: int, share: float, rows: int) -> tuple[int, int]:
    """Parts of a group's left rows and of its right ones: blocks of about a share of the pairs, and few rows repeated."""
    blocks = left * right / share
    q = min(right, max(1, math.ceil(right / rows), round(math.sqrt(blocks * right / left))))
    return min(left, max(1, math.ceil(blocks / q))), q


def _dealt(a: DataFrame, b: DataFrame, plan: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys in the plan (hash, left parts, right parts) by block: in one part of their side, with all of the other.

    Hashes that clash share a plan, which harms no result. Places are hashed, since keys may recur at even distances.
    """
    if not plan:
        return a, b
    of = a.sparkSession.createDataFrame(pa.table(dict(zip(("h", "p", "q"), map(list, zip(*plan, strict=True)), strict=True))))
    sides = []
    for df, own, other in ((a, "p", "q"), (b, "q", "p")):
        df = df.withColumns({"h": F.xxhash64("key"), "place": F.xxhash64(F.monotonically_increasing_id())}).join(of, "h", "left")
        one, all_ = F.pmod("place", F.coalesce(own, F.lit(1))), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))
        part, repeated = ("part", "other") if own == "p" else ("other", "part")
        sides.append(df.withColumn(part, one).withColumn(repeated, all_).drop("h", "place", "p", "q"))
    return tuple(sides)


def index_join(left: DataFrame, right: DataFrame | Indexed, left_field: str, right_field: str | None = None) -> DataFrame:
    """Inner equi-join by lookups in the right side. The right name wins.

    Of an Indexed right side, a hash index is joined bucket by bucket: where the left side is selective, Spark finds the
    buckets of its keys first and reads only those (dynamic pruning). Without an index, the lookup table is a hash table
    of the right side: of all of it where Spark finds it small enough to send to everyone, else of one partition at a time.
    """
    if not isinstance(right, Indexed):
        a, b, out = _apart(left, right, "right")
        return a.join(b.hint("shuffle_hash") if _large(right) else b, _equal(left, right, left_field, right_field)).select(*out)
    field = right.index.field
    if right_field is not None and right_field.lower() != field.lower():
        raise ValueError(f"the index is on {field}, not on {right_field}")
    rows = right.rows()
    plain = rows.select(*right.columns)
    a, _, out = _apart(left, plain, "right")
    b = rows.select(*(F.col(f"`{c}`").alias(f"r{k}") for k, c in enumerate(right.columns)), *((F.col(BUCKET),) if right.index.kind == "hash" else ()))
    on = _equal(left, plain, left_field, field)
    if right.index.kind == "hash":
        own = F.col(f"l{[c.lower() for c in left.columns].index(left_field.lower())}")
        on = on & (F.col(BUCKET) == right.bucket(own))
    return a.join(b, on).select(*out)


def block_product(left: DataFrame, right: DataFrame, rows: int = 100_000) -> DataFrame:
    """Every pair of rows, the right side in blocks of about so many rows.

    Each left row goes to every block, and a block's rows are held as one table in memory; so what a task holds of the
    right side has a bound, and blocks are tasks of their own. Of two columns of one name the left one is seen.
    """
    a, b, out = _apart(left, right)
    blocks = max(1, -(-b.count() // rows))
    dealt = b.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    each = a.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return each.join(dealt.hint("shuffle_hash"), "block").select(*out)


def _bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _large(df: DataFrame) -> bool:
    """Whether Spark's estimate exceeds its limit for sending a table to all executors."""
    spark = df.sparkSession
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return _bytes(df) > int(limit)


def join(left: DataFrame, right: DataFrame, on: str, kind: str = "inner", aliases: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Joins on a predicate over both aliases; kind: inner, left, right or full. All columns, left ones first."""
    from lamella.plans.ast import Item, Join, Select, TableRef
    from lamella.plans.lower import lower

    frames = dict(zip(aliases, (left, right), strict=True))
    q = Select((Item(None),), (TableRef(aliases[0]),), (Join(kind, TableRef(aliases[1]), parse_predicate(on)),))
    return lower(q, frames.__getitem__)


def group_by(df: DataFrame, fields: list[str], aggregates: list[Aggregate] | None = None) -> DataFrame:
    """One row for each distinct key: key fields, then aggregates. Without aggregates the distinct keys alone.

    Without fields all rows are one group; of no rows that is one row of nulls.
    """
    aggregates = aggregates or []
    if not aggregates:
        return project(df, fields).distinct()
    return df.groupBy(*(F.col(f"`{f}`") for f in fields)).agg(*(a.column() for a in aggregates))


def sort(df: DataFrame, fields: list[str]) -> DataFrame:
    """Ascending by the fields, one after the other."""
    return df.orderBy(*(F.col(f"`{f}`") for f in fields))


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, kept for reading more than once: in memory, on disk where that is short, made again where lost.

    `release` gives the memory back.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release(df: DataFrame) -> None:
    df.unpersist()
