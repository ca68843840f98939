"""Merge joins whose groups multiply: dealt over tasks, with every pair once."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lamella.operators import relational as R


def digest(df):
    return df.agg(F.count("*"), F.sum("a"), F.sum("b"), F.bit_xor(F.xxhash64("a", "b"))).first()


@pytest.mark.parametrize(("n", "keys"), [(3000, 1), (20_000, 40)])
def test_pairs_are_dealt_over_tasks(spark, n, keys):
    """One key of 9 million pairs; and 40 keys, none more than a task's share, of few bytes together."""
    a = spark.range(n).select(F.col("id").alias("a"), (F.col("id") % keys).alias("k"))
    b = spark.range(n).select(F.col("id").alias("b"), (F.col("id") % keys).cast("int").alias("k"))
    joined = R.project(R.merge_join(a, b, "k", "k"), ["a", "b"])
    dealt = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(dealt) == n * n // keys and len(dealt) > 1 and max(dealt) < 0.75 * sum(dealt)
    assert digest(joined) == digest(a.join(b, "k"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan


D = datetime.datetime
ODD = {
    ("int", "bigint"): [(1, 1)] * 7 + [(2, 1), (2, 2), (3, 4), (None, 1), (None, None), (5, 6), (5, 5)] + [(9, 9)] * 3,
    ("bigint", "double"): [(1, 1.0)] * 6 + [(0, -0.0), (0, 0.0), (2**53 + 1, 2.0**53), (2**53, 2.0**53), (None, float("nan"))],
    ("double", "float"): [(0.0, -0.0), (-0.0, 0.0), (float("nan"), float("nan")), (float("nan"), float("nan")), (0.1, 0.1), (0.5, 0.5), (None, None)] * 2,
    ("decimal(5,2)", "decimal(9,4)"): [(Decimal("1.50"), Decimal("1.5000")), (Decimal("1.50"), Decimal("1.5001"))] * 4,
    ("string", "string"): [("a", "a"), ("", ""), ("A", "a"), (None, ""), ("a ", "a")] * 3,
    ("string", "int"): [("1", 1)] * 3,
    ("date", "timestamp"): [(datetime.date(2020, 1, 1), D(2020, 1, 1)), (datetime.date(2020, 1, 2), D(2020, 1, 2, 1))] * 3,
    ("struct<v:int>", "struct<v:int>"): [((1,), (1,)), ((2,), (None,))] * 3,
    ("string collate UTF8_LCASE", "string collate UTF8_LCASE"): [("a", "A"), ("A", "a")] * 3,
    ("int", "int"): [],
}


@pytest.mark.parametrize("kinds", ODD, ids=", ".join)
@pytest.mark.parametrize(("pairs", "wide"), [(1, 1), (6, 2)])
def test_blocks_are_the_join(spark, monkeypatch, kinds, pairs, wide):
    """Whatever the parts: of copies, nulls, other types, zeros of both signs and texts equal but for case."""
    monkeypatch.setattr(R, "MULTIPLIED", 0)
    both = spark.createDataFrame([(*v, n) for n, v in enumerate(ODD[kinds])], f"x {kinds[0]}, y {kinds[1]}, n int")
    a, b = both.select("x", "n"), both.select("y", F.col("n").alias("m"))
    want = [] if kinds == ("string", "int") else a.join(b, a["x"] == b["y"]).select("n", "m").collect()
    got = R.merge_join(a, b, "X", "y", pairs, wide)
    if kinds in (("int", "bigint"), ("bigint", "double"), ("string", "string"), ("date", "timestamp")):
        assert "l_other" in got._jdf.queryExecution().analyzed().toString()
    assert got.columns == ["x", "n", "y", "m"]
    assert sorted(map(tuple, got.select("n", "m").collect())) == sorted(map(tuple, want))
    again = R.merge_join(both, both, "n", "n", pairs, wide)
    assert again.columns == ["x", "y", "n"] and sorted(r["n"] for r in again.collect()) == list(range(len(ODD[kinds])))


@pytest.mark.parametrize(("left", "right"), [(1, 1), (1, 10**9), (10**9, 1), (7, 10**6), (5_400_000, 14_400), (10**6, 10**6)])
def test_parts_bound_pairs_and_right_rows(left, right):
    for share, rows in ((4_000_000, 100_000), (10**9, 100_000), (100, 10)):
        p, q = R._parts(left, right, share, rows)
        assert 1 <= p <= left and 1 <= q <= right and -(-right // q) <= rows
        assert -(-left // p) * -(-right // q) <= 4 * share or (p == left and -(-right // q) <= rows)
