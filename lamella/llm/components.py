"""Connected components of an edge table: contraction in tasks, then alternating large and small stars.

Each task takes about HELD edges, whatever their nodes, and gives the stars of their components. Where one task holds all
edges, these are the result. Else a round of stars follows, a few joins and aggregations over the contracted edges, and so
on until nothing changes. Edges are written to the shared folder; nothing but their number and a sum comes to the driver.
Least neighbours are written before they are joined, so that both sides of each join come from exchanges and adaptive
execution can split the edges of a node that has very many. The result names each node that has an edge and the least
node of its component.

Results: edges that repeat, go both ways or from a node to itself change nothing. Nulls are not allowed. No edges, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import common

#: Edges that a task contracts, about.
HELD = 500_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the least of its component, with that one."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(names))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    own = label != np.arange(len(names))
    return names[own], names[label[own]]


def _contract(batches):
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        u, v = stars(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _round(e: DataFrame) -> DataFrame:
    """A large star, then a small star; the edges are written."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = common.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = common.written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
    low = common.written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = common.written(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-stars")
    common.drop(e, least, large, low)
    return out


def _mark(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """edges: u, v (long, not null). Returns node, root."""
    e = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        tasks = -(-mark[0] // held)
        c = common.written(e.select("u", "v").repartition(tasks).mapInArrow(_contract, "u long, v long").distinct(), "contracted")
        common.drop(e)
        if tasks == 1:
            e = c
            break
        e = _round(c)
        mark, before = _mark(e), mark
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
