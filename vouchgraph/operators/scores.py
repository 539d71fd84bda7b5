"""Scores from hits: blending, clusters, filters, order and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import checked
from ..settings import CLUSTER_EPSILON


def raw(hits: DataFrame) -> DataFrame:
    """(ego, node, score): positive minus negative hits over all hits of the ego."""
    total = F.sum(F.col("pos_hits") + F.col("neg_hits")).over(Window.partitionBy("ego"))
    return hits.select("ego", "node", ((F.col("pos_hits") - F.col("neg_hits")) / total).alias("score"))


def blend(scores: DataFrame, zero: DataFrame, factor: float) -> DataFrame:
    """Scores mixed with the zero opinions (node, z) of all; what comes out as exactly 0 is left out.

    A node with a zero opinion but no hits is there too. One aggregation instead of an outer join.
    """
    egos = scores.select("ego").distinct()
    zeros = egos.crossJoin(checked(zero, 24)).select("ego", "node", F.lit(0.0).alias("score"), "z")
    both = scores.select("ego", "node", "score", F.lit(0.0).alias("z")).unionByName(zeros).groupBy("ego", "node").agg(F.sum("score").alias("s"), F.sum("z").alias("z"))
    return both.select("ego", "node", (F.col("s") * (1 - factor) + factor * F.col("z")).alias("score")).where("score <> 0")


def omit_negative(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Without nodes to which the ego has an edge of negative weight itself."""
    no = edges.where("negative").select(F.col("src_id").alias("ego"), F.col("dst_id").alias("node"))
    return scores.join(no, ["ego", "node"], "left_anti")


def quantile_bounds(scores: DataFrame, nodes: DataFrame, quantiles: int) -> DataFrame:
    """(ego, kind, bounds): quantiles - 1 bounds of the ego's positive scores of each kind."""
    kinds = nodes.select(F.col("node_id").alias("node"), "kind")
    lists = scores.where(F.col("score") > CLUSTER_EPSILON).join(checked(kinds, 24), "node").groupBy("ego", "kind").agg(F.sort_array(F.collect_list("score")).alias("s"))
    n = F.size("s").cast("long")
    i = F.sequence(F.lit(1).cast("long"), F.lit(quantiles - 1).cast("long"))

    def bound(x: Column) -> Column:
        p = F.floor(x * n / quantiles).cast("int")
        return F.when(n == 1, F.get("s", F.lit(0)) - CLUSTER_EPSILON).when(p == 0, F.get("s", F.lit(0))).otherwise((F.get("s", p - 1) + F.get("s", p)) / 2)

    return lists.select("ego", "kind", F.transform(i, bound).alias("bounds"))


def cluster(score: Column, bounds: Column) -> Column:
    """0 for no positive score, 1 without bounds, else 1 + the bounds below the score."""
    none = bounds.isNull() | ((F.get(bounds, F.lit(0)) == 0.0) & (F.element_at(bounds, -1) == 0.0))
    return F.when(score < CLUSTER_EPSILON, 0).when(none, 1).otherwise(F.size(F.filter(bounds, lambda b: b < score)) + 1).cast("int")


def clustered(scores: DataFrame, nodes: DataFrame, bounds: DataFrame, by_ego_kind: bool = False) -> DataFrame:
    """``scores`` with cluster, by the node's own kind or by the ego's."""
    kinds = checked(nodes.select("node_id", "kind"), 24)
    key = F.col("ego") if by_ego_kind else F.col("node")
    both = scores.join(kinds, key == F.col("node_id")).drop("node_id").join(checked(bounds, 900), ["ego", "kind"], "left")
    return both.select("ego", "node", "score", cluster(F.col("score"), F.col("bounds")).alias("cluster"))


def in_bounds(score: Column, gt: float | None = None, gte: float | None = None, lt: float | None = None, lte: float | None = None, compat: bool = False) -> Column:
    """Condition on the score; with ``compat`` the inclusive and exclusive bounds change places."""
    if compat:
        gt, gte, lt, lte = gte, gt, lte, lt
    out = F.lit(True)
    for ok, v in ((lambda v: score > v, gt), (lambda v: score >= v, gte), (lambda v: score < v, lt), (lambda v: score <= v, lte)):
        if v is not None:
            out = out & ok(v)
    return out


def paged(rows: DataFrame, order: list[Column], index: int, count: int) -> DataFrame:
    """Rows index..index+count of the order, with their place; only index + count rows are ever sorted out."""
    top = rows.orderBy(*order).limit(min(index + count, (1 << 31) - 1))
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return ranked.where(F.col("position") > index)


def default_order(score: str = "score") -> list[Column]:
    return [F.abs(F.col(score)).desc(), F.col("node").asc()]


def mutual(scores: DataFrame, ego_id: int, users: DataFrame) -> DataFrame:
    """(node, score, reverse) of users whom the ego scores above 0, with their score of the ego (0 without one)."""
    own = scores.where((F.col("ego") == ego_id) & (F.col("score") > 0)).join(checked(users.select(F.col("node_id").alias("node")), 16), "node", "left_semi")
    back = scores.where(F.col("node") == ego_id).select(F.col("ego").alias("node"), F.col("score").alias("back"))
    return own.join(back, "node", "left").select("node", "score", F.coalesce("back", F.lit(0.0)).alias("reverse"))

