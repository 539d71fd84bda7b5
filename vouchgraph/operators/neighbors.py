"""Edges around a node, and the normalised and contracted edges of the graph view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import kind_of, sign
from ..plans.staging import checked
from ..settings import EPSILON

ALL, OUT, IN = 0, 1, 2


def incident(edges: DataFrame, focus: str, direction: int = ALL) -> DataFrame:
    """(node, weight, inbound) of the focus's edges; a node linked both ways comes twice."""
    out = edges.where(F.col("src") == focus).select(F.col("dst").alias("node"), "weight", F.lit(False).alias("inbound"))
    into = edges.where(F.col("dst") == focus).select(F.col("src").alias("node"), "weight", F.lit(True).alias("inbound"))
    return out if direction == OUT else into if direction == IN else out.unionByName(into)


def neighbors(edges: DataFrame, owners: DataFrame, focus: str, direction: int = ALL, kind: str | None = None, kind_filter: bool = False) -> DataFrame:
    """:func:`incident` as the API has it: the kind only matters for opinions that come in, where the focus's own are left out.

    ``kind_filter`` keeps only nodes of the kind. Poll variants have no neighbours.
    """
    found = incident(edges, focus, direction)
    if kind == "V":
        return found.limit(0)
    if kind == "O" and direction == IN:
        own = owners.where(F.col("object_owner") == focus).select(F.col("name").alias("node"))
        found = found.join(checked(own, 64), "node", "left_anti")
    return found.where(kind_of(F.col("node")) == kind) if kind and kind_filter else found


def sums(edges: DataFrame) -> DataFrame:
    """(src, pos_sum, neg_sum) of outgoing weights, added as millionths."""
    m = F.round(F.abs("weight") * 1e6).cast("long")
    return edges.groupBy("src").agg((F.sum(F.when(F.col("weight") > 0, m).otherwise(0)) / 1e6).alias("pos_sum"), (F.sum(F.when(F.col("weight") < 0, m).otherwise(0)) / 1e6).alias("neg_sum"))


def _by(total: Column) -> Column:
    return F.col("weight") / F.when(F.col("pos_sum") < EPSILON, 1.0).otherwise(total)


def path_normalized(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) over the source's positive sum, or over 1 if there is none."""
    return edges.join(sums(edges), "src").select("src", "dst", _by(F.col("pos_sum")).alias("weight"))


def neighbor_normalized(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) over the source's sum of absolute weights, or over 1 if it has no positive edge."""
    return edges.join(sums(edges), "src").select("src", "dst", _by(F.col("pos_sum") + F.col("neg_sum")).alias("weight"))


def product(a: Column, b: Column) -> Column:
    """Weight of two edges in a row; two negative ones stay negative."""
    return F.when((a < 0) & (b < 0), -a * b).otherwise(a * b)


def focus_neighbors(edges: DataFrame, focus: str, positive_only: bool = False) -> DataFrame:
    """(dst, weight): users the focus reaches directly, or over one beacon, comment or opinion.

    Of several ways to a user one stays: direct and contracted ones are ordered by the first edge's weight
    downwards, then by its target, the sign of the second, and the user; the last wins.
    """
    around = edges.where(F.col("src") == focus).select(F.col("dst").alias("src")).union(edges.sparkSession.createDataFrame([(focus,)], "src string")).distinct()
    near = neighbor_normalized(edges.join(checked(around, 64), "src", "left_semi"))
    first = near.where(F.col("src") == focus).select(F.col("dst").alias("via"), F.col("weight").alias("w1"))
    second = near.select(F.col("src").alias("via"), F.col("dst").alias("user"), F.col("weight").alias("w2"))
    if positive_only:
        first, second = first.where("w1 > 0"), second.where("w2 > 0")
    direct = first.where(kind_of(F.col("via")) == "U").select(F.col("via").alias("dst"), F.col("w1").alias("weight"), "w1", "via", F.lit(0).alias("s2"))
    objects = first.where(kind_of(F.col("via")).isin("B", "C", "O")).join(second, "via")
    far = objects.where((F.col("user") != focus) & (kind_of(F.col("user")) == "U")).select(F.col("user").alias("dst"), product(F.col("w1"), F.col("w2")).alias("weight"), "w1", "via", sign(F.col("w2")).alias("s2"))
    both = direct.unionByName(far).where(F.abs("weight") >= EPSILON)
    return both.groupBy("dst").agg(F.max_by("weight", F.struct(-F.col("w1"), "via", -F.col("s2"), "dst")).alias("weight"))
