"""Runs of sorted rows, and connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the sorted rows of a partition, cut only where ``key`` changes."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key)
        end = keys[b.num_rows - 1].as_py()
        if keys[0].as_py() != last and held:
            yield pa.Table.from_batches(held)
            held = []
        if keys[0].as_py() == end:
            held.append(b)
        else:
            low, high = 0, b.num_rows - 1  # binary search for the last run's start
            while low < high:
                mid = (low + high) // 2
                if keys[mid].as_py() == end:
                    high = mid
                else:
                    low = mid + 1
            yield pa.Table.from_batches([*held, b.slice(0, low)])
            held = [b.slice(low)]
        last = end
    if held:
        yield pa.Table.from_batches(held)


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the least b of each a; a hub's edges are combined where they lie, and its join may be split."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Large-star and small-star steps in turn until nothing changes; each round is a written table, so the
    plan stays short and lost executors cost one round. Self edges and repeats do no harm.
    """
    e = common.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        down = common.stage(large.where("a <> b").distinct(), "cc")
        small = down.join(_least(down), "a")
        e = common.stage(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "cc")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
