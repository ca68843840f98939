"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side. The driver holds candidate boundaries
("probes"); each round the executors count exact bytes and rows between neighbouring probes, and the interval around
every wanted splitter narrows until a boundary meets the tolerance or only one key is left in it. Probes lie between
groups of equal texts first; inside a group only where the group alone is too large for the tolerance. The rows are then
exchanged once, to ranges that are parts of shards, and the counts give each range its first slot. A range has RANGE bytes
or less, whatever the size of the input, and is a task of its own.

Results: null texts count as empty and are one group with empty ones. Null doc_ids come first within their text. Repeated
rows share a key and stay together. A row that is larger than a range is one. A table with fewer rows than shards leaves
shards empty; an empty table has no rows. Columns of docs named shard or slot are renamed: _in is added until the name is free.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm import common

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: For each open boundary and round: of shards, and within them.
PROBES, INNER_PROBES = 16, 4
#: Of a shard's bytes for boundaries of shards, of a range's bytes for boundaries within them.
TOLERANCE, INNER = 0.004, 0.25
OVERHEAD = 16
#: Bytes of a range, about.
RANGE = 128 << 20

Key = tuple[int, int]


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def interval_udf(keys: list[Key]):
    """How many of the sorted keys are at most (h, s)."""
    kh, ks = (np.asarray([k[i] for k in keys], np.int64) for i in (0, 1))
    starts = np.flatnonzero(np.r_[True, kh[1:] != kh[:-1]]) if len(keys) else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def interval(h: pd.Series, s: pd.Series) -> pd.Series:
        hv, sv = h.to_numpy(np.int64), s.to_numpy(np.int64)
        out = np.searchsorted(kh, hv, "left")
        for a in starts[np.isin(kh[starts], hv)].tolist():
            b = a + int(np.searchsorted(kh[a:], kh[a], "right"))
            at = hv == kh[a]
            out[at] = a + np.searchsorted(ks[a:b], sv[at], "right")
        return pd.Series(out.astype(np.int32))

    return interval


def count_between(keys: DataFrame, probes: list[Key]) -> dict[int, tuple]:
    """Bytes, rows, and least and greatest h and s, by the interval between neighbouring probes."""
    rows = keys.groupBy(interval_udf(probes)("h", "s").alias("k")).agg(F.sum("size"), F.count("*"), F.min("h"), F.max("h"), F.min("s"), F.max("s")).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def between(lo: Key, hi: Key, n: int) -> list[Key]:
    """Up to n keys above lo and below hi: between groups of equal h while there is room, else within one."""
    if hi[0] - lo[0] > 1:
        first, last, make = lo[0] + 1, hi[0], lambda x: (x, LOW)
    elif hi[0] == lo[0] or hi[1] == LOW:
        first, last, make = lo[1] + 1, hi[1] if hi[0] == lo[0] else HIGH, lambda x: (lo[0], x)
    else:
        return [(hi[0], LOW)] if lo < (hi[0], LOW) < hi else []
    room = last - first + 1
    if room <= 0:
        return []
    picks = {first + room * (2 * k + 1) // (2 * n) for k in range(n)} if room > n else set(range(first, last + 1))
    return [k for k in map(make, sorted(picks)) if lo < k < hi]


def splitters(keys: DataFrame, parts: int, shard_every: int) -> list[Key]:
    """parts - 1 boundaries; every shard_every-th bounds a shard. A row belongs to the part that counts the boundaries at or below its key."""
    total, rows, h0, h1 = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.min("h"), F.max("h")).first()
    wanted = [total * j // parts for j in range(1, parts)]
    if not rows:
        return [(HIGH, HIGH)] * len(wanted)
    slack = [total / parts * (TOLERANCE * shard_every if j % shard_every == 0 else INNER) for j in range(1, parts)]
    ends = {(h0, LOW): 0, (h1, HIGH): total}
    span = [((h0, LOW), (h1, HIGH)) for _ in wanted]
    chosen: list[Key | None] = [None] * len(wanted)
    while any(c is None for c in chosen):
        open_ = [j for j, c in enumerate(chosen) if c is None]
        sharing = Counter(span[j] for j in open_)
        coarse = {span[j] for j in open_ if j % shard_every != shard_every - 1}
        grid = sorted({k for (lo, hi), n in sharing.items() for k in between(lo, hi, (INNER_PROBES if (lo, hi) in coarse and n > 1 else PROBES) * n)})
        found = count_between(keys, grid) if grid else {}
        below = list(accumulate(found.get(k, (0,))[0] for k in range(len(grid))))
        ends.update(zip(grid, below, strict=True))
        for j in open_:
            lo, hi = span[j]
            a, z = bisect_right(grid, lo), bisect_left(grid, hi)
            k = bisect_right(below, wanted[j], a, z)
            lo, hi = grid[k - 1] if k > a else lo, grid[k] if k < z else hi
            if grid and k in found:  # no rows lie before the least key there, nor after the greatest
                _, _, h0, h1, s0, s1 = found[k]
                least, beyond = ((h0, s0), (h0, s1 + 1)) if h0 == h1 else ((h0, LOW), (h1 + 1, LOW))
                if lo < least < hi:
                    ends.setdefault(least, ends[lo])
                    lo = least
                if lo < beyond < hi:
                    ends.setdefault(beyond, ends[hi])
                    hi = beyond
            near = min((lo, hi), key=lambda x: abs(ends[x] - wanted[j]))
            if abs(ends[near] - wanted[j]) <= slack[j] or not between(lo, hi, 1):
                chosen[j] = near
            span[j] = (lo, hi)
    return sorted(chosen)


def ranges_in_shard(total: int, shards: int, partitions: int) -> int:
    """Into how many ranges a shard is cut: for RANGE bytes each, and for about as many ranges as shuffle partitions."""
    return max(1, -(-partitions // shards), -(-total // (shards * RANGE)))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with shard and slot. Shards have near equal bytes, OVERHEAD a row included."""
    spark = docs.sparkSession
    h, s = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW))
    keys = common.written(docs.select(h.alias("h"), s.alias("s"), row_bytes(F.col(text_col)).alias("size")), "shard-keys")
    each = ranges_in_shard(keys.agg(F.sum("size")).first()[0] or 0, shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = splitters(keys, shards * each, each)
    counts = count_between(keys, cuts)
    first, at = [], 0
    for part in range(shards * each):
        at = 0 if part % each == 0 else at
        first.append(at)
        at += counts.get(part, (0, 0))[1]
    inner = docs.select(F.struct("*").alias("row"), h.alias("h"), s.alias("s")).withColumn("part", interval_udf(cuts)("h", "s"))
    dealt = inner.repartitionById(shards * each, "part")
    placed = dealt.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("h", "s")))
    names, taken = [], {"shard", "slot"} | {c.lower() for c in docs.columns}
    for c in docs.columns:
        name = c
        while c.lower() in ("shard", "slot") and name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        names.append(name)
    return placed.select(
        *[F.col("row")[c].alias(name) for c, name in zip(docs.columns, names, strict=True)],
        F.floor(F.col("part") / each).cast("int").alias("shard"),
        (F.col("n") - 1 + F.element_at(F.lit(first), F.col("part") + 1)).cast("long").alias("slot"),
    )
