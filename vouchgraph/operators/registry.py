"""Nodes of each context: ids in order of registration, kinds, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import kind_of
from ..plans.staging import checked, stage


def dense_ids(rows: DataFrame, within: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with 0, 1, 2... by ``order`` (distinct together) in each ``within``.

    Rows are partitioned by ranges of (within, order), sorted there and written; an id is a row's place in its
    partition, shifted by what the ``within`` has in earlier ones. No task sees a whole context.
    """
    ranged = rows.repartitionByRange(within, *order).sortWithinPartitions(within, *order)
    placed = stage(ranged.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")), "ranked")
    sizes = placed.groupBy("__p", within).agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = sizes.select("__p", within, "__first", (F.sum("__n").over(Window.partitionBy(within).orderBy("__p")) - F.col("__n")).alias("__before"))
    return placed.join(checked(before, 64), ["__p", within]).withColumn(name, (F.col("__before") + F.col("__i") - F.col("__first")).cast("long")).drop("__p", "__i", "__first", "__before")


def first_seen(routed: DataFrame, calculated: DataFrame | None = None) -> DataFrame:
    """(context, name, at, owner): when each node is registered (twice its operation, one more for the second node).

    An edge registers its source, then its target; one from an object registers its user first, then the
    object, owned by that user if it is new. ``calculated`` (context, op_idx, name) registers users by name.
    """
    by_object = kind_of(F.col("src")) != "U"
    first = F.struct(F.when(by_object, F.col("dst")).otherwise(F.col("src")).alias("name"), F.lit(0).alias("place"))
    second = F.struct(F.when(by_object, F.col("src")).otherwise(F.col("dst")).alias("name"), F.lit(1).alias("place"))
    seen = routed.select("context", "op_idx", F.explode(F.array(first, second)).alias("e")).select("context", (F.col("op_idx") * 2 + F.col("e.place")).alias("at"), "e.name")
    if calculated is not None:
        seen = seen.unionByName(calculated.select("context", (F.col("op_idx") * 2).alias("at"), "name"))
    # sums of numbers alone are hashed; with the owner, a text, all rows would be sorted
    found = seen.groupBy("context", "name").agg(F.min("at").alias("at"))
    other = (F.col("src") < "U") | (F.col("src") >= "V")  # says nothing new, but lets files of users alone be skipped
    owned = routed.where(other & by_object).groupBy("context", F.col("src").alias("name"), (F.col("op_idx") * 2 + 1).alias("at")).agg(F.min("dst").alias("owner"))
    return found.join(owned, ["context", "name", "at"], "left").select("context", "name", "at", "owner")


def register(routed: DataFrame, calculated: DataFrame | None = None) -> DataFrame:
    """(context, node_id, name, kind, owner, at) of every node, by :func:`first_seen`. Owners never change later."""
    return dense_ids(first_seen(routed, calculated), "context", ["at", "name"], "node_id").select("context", "node_id", "name", kind_of(F.col("name")).alias("kind"), "owner", "at")


def object_owner(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(context, name, object_owner): the registered owner; else an opinion's first remaining source; else the node itself."""
    inbound = edges.where(kind_of(F.col("dst")) == "O").groupBy("context", F.col("dst").alias("name")).agg(F.min_by("src", "op_idx").alias("source"))
    both = nodes.join(inbound, ["context", "name"], "left")
    return both.select("context", "name", F.coalesce("owner", F.when(F.col("kind") == "O", F.col("source")), F.when(F.col("kind") != "O", F.col("name")), F.col("name")).alias("object_owner"))
