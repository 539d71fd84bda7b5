"""Cheapest paths over positive edges, contraction to users, and the paged view around a focus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import kind_of
from ..plans.staging import checked, stage
from ..settings import EPSILON
from . import neighbors


def costs(edges: DataFrame) -> DataFrame:
    """(src, dst, cost) of the positive edges: the source's positive sum over the weight."""
    both = edges.where("weight > 0").join(neighbors.sums(edges), "src")
    share = F.col("weight") / F.col("pos_sum")
    return both.select("src", "dst", F.when(share < EPSILON, 1e6).otherwise(F.col("pos_sum") / F.col("weight")).alias("cost"))


def cheapest_path(edges: DataFrame, start: str, goal: str) -> list[str] | None:
    """:func:`cheapest` over the positive edges, by :func:`costs`."""
    return cheapest(costs(edges), start, goal)


def cheapest(links: DataFrame, start: str, goal: str) -> list[str] | None:
    """Nodes of the path from start to goal over (src, dst, cost > 0), None without one; only the path reaches the driver.

    The path ends as soon as the goal is next to a settled node: it is the cheapest way to the goal's nearest
    source, and one edge more. Of equal ones, the source first by name wins, and on the way to a node the last
    stop of the least cost, then the first by name. Costs spread from the start hop by hop, each round a written
    table of the nodes that became cheaper, and not beyond the cost of the best source found so far.
    """
    if start == goal:
        return [start]
    links = stage(links.where(F.col("dst") != start), "costs")
    last = links.where(F.col("dst") == goal).select(F.col("src").alias("node"))
    links = links.where(F.col("dst") != goal)
    last = checked(stage(last, "sources"), 48)
    found = links.sparkSession.range(0, 1, 1, 1).select(F.lit(start).alias("node"), F.struct(F.lit(0.0).alias("cost"), F.lit(-1.0).alias("before"), F.lit("").alias("via"), F.array(F.lit(start)).alias("path")).alias("best"))
    found = front = stage(found, "reached")
    while True:
        best = found.join(last, "node").agg(F.min(F.struct("best.cost", "node", "best.path")).alias("b")).first()["b"]
        go = front if best is None else front.where(F.col("best.cost") < best["cost"])
        if go.isEmpty():
            return None if best is None else [*best["path"], goal]
        step = go.select(F.col("node").alias("src"), "best").join(links, "src")
        tried = step.select(F.col("dst").alias("node"), F.struct((F.col("best.cost") + F.col("cost")).alias("cost"), F.col("best.cost").alias("before"), F.col("src").alias("via"), F.concat("best.path", F.array("dst")).alias("path")).alias("best"))
        tried = tried.groupBy("node").agg(F.min("best").alias("best"))
        front = stage(tried.join(found.select("node", F.col("best").alias("old")), "node", "left").where("old is null or best < old").select("node", "best"), "front")
        found = stage(found.join(front.select("node"), "node", "left_anti").unionByName(front), "reached")


def contract(path: list[str], weight: dict[tuple[str, str], float]) -> list[tuple[str, str, float]]:
    """Edges of a path between users: an object in between is left out, with the product of the two weights."""
    out = []
    i = 0
    while i + 1 < len(path):
        a, b = path[i], path[i + 1]
        w = weight[a, b]
        if i + 2 < len(path) and not b.startswith("U"):
            c = path[i + 2]
            w2 = weight[b, c]
            if a.startswith("U") and abs(p := w * w2 * (-1 if w < 0 and w2 < 0 else 1)) >= EPSILON:
                out.append((a, c, p))
            i += 2 if c.startswith("U") else 1
        else:
            if a.startswith("U"):
                out.append((a, b, w))
            i += 1
    return out


def view(edges: DataFrame, ego: str, focus: str, index: int = 0, count: int = 1 << 30, positive_only: bool = False, force: bool = False) -> DataFrame:
    """(position, src, dst, weight): the contracted path from ego to focus, then the focus's neighbours.

    The path comes whole if its end lies beyond index, even if it is longer than count; neighbours follow by
    falling weight. With ``force`` an ego without a path is joined to the focus by an edge of 1.
    """
    spark = edges.sparkSession
    path = cheapest_path(edges, ego, focus)
    first: list[tuple[str, str, float]] = []
    if path and len(path) > 1:
        hop = spark.createDataFrame(list(zip(path, path[1:])), "src string, dst string")
        near = edges.join(checked(hop.select("src").distinct(), 32), "src", "left_semi")
        norm = {(r["src"], r["dst"]): r["weight"] for r in neighbors.path_normalized(near).join(checked(hop, 64), ["src", "dst"]).collect()}  # a row a hop
        first = contract(path, norm)
    elif force and path is None:
        first = [(ego, focus, 1.0)]
    first = list({(a, b): (a, b, w) for a, b, w in reversed(first) if a != b}.values())[::-1]
    pos = spark.createDataFrame([(i + 1, *e) for i, e in enumerate(first)], "position int, src string, dst string, weight double")
    rest = neighbors.focus_neighbors(edges, focus, positive_only).select(F.lit(focus).alias("src"), "dst", "weight").where("src <> dst")
    rest = rest.join(checked(pos.select("src", "dst"), 64), ["src", "dst"], "left_anti")
    n = len(first)
    shown = max(0, n - index) if index <= n else 0
    skip, take = max(0, index - n), max(0, count - shown)
    top = rest.orderBy(F.abs("weight").desc(), "dst").limit(min(skip + take, (1 << 31) - 1))
    from pyspark.sql import Window

    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(F.abs("weight").desc(), "dst"))).where(F.col("position") > skip)
    return pos.where(F.col("position") > index).unionByName(ranked.select((F.col("position") + n).alias("position"), "src", "dst", "weight"))
