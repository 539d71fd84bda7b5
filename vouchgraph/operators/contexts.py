"""Which operations of a log still count, which contexts each reaches, and the edges that are left.

A log is a history: ``reset`` and every bulk load drop all contexts and start anew. Within what is left, orders are
compared by op_idx alone: rows of the bulk load in force and seeded rows get places below any operation's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import KINDS, kind_of
from ..plans.staging import checked, stage
from ..settings import EPSILON, Settings
from . import decay, registry

_OPS = ["op_idx", "context", "src", "dst", "amount", "magnitude"]
#: Birth of contexts that are there before the first operation, and where seeded and loaded user edges begin.
_ALWAYS, _SEEDED, _LOADED = -(1 << 63), -(1 << 62), -(1 << 61)


def _kinds() -> tuple[Column, Column]:
    return kind_of(F.col("src")), kind_of(F.col("dst"))


def _aggregate(ops: DataFrame) -> DataFrame:
    """The one row (context) of the context "", which all others feed."""
    return ops.sparkSession.range(0, 1, 1, 1).select(F.lit("").alias("context"))


def _pairs() -> tuple[Column, Column]:
    """Whether an edge is between users, or between a user and an object, by cheap comparisons: filters repeat them."""
    user = lambda c: F.col(c).startswith("U")
    object_ = lambda c: F.substring(c, 1, 1).isin("B", "C", "O")
    differ = F.col("src") != F.col("dst")
    return differ & user("src") & user("dst"), differ & ((user("src") & object_("dst")) | (object_("src") & user("dst")))


def classify(ops: DataFrame) -> DataFrame:
    """``ops`` with route: "users" (user to user), "object", "ignored" (votes), or "rejected".

    Rejected are self edges, other pairs with polls or variants, object to object, unknown kinds and nulls.
    """
    s, d = _kinds()
    poll = lambda k: k.isin("V", "P")
    known = s.isNotNull() & d.isNotNull() & (F.col("src") != F.col("dst"))
    route = (
        F.when(known & (s == "U") & (d == "U"), "users")
        .when(known & (((s == "U") & (d == "V")) | ((s == "V") & (d == "P"))), "ignored")
        .when(known & ~poll(s) & ~poll(d) & ((s == "U") | (d == "U")), "object")
        .otherwise("rejected")
    )
    return ops.withColumn("route", route)


def live(ops: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(load, later): rows of the bulk load in force, None without one, and the operations after the last load or reset.

    Rows of kind bulk_load belong to one load if they have the same batch (column node, null is one too) and no
    other operation lies between them; a later load replaces an earlier one.
    """
    mine = F.col("kind").eqNullSafe(F.lit("bulk_load"))
    last = ops.agg(F.max(F.when(F.col("kind") == "reset", F.col("op_idx"))).alias("reset"), F.max(F.when(mine, F.struct("op_idx", "node"))).alias("load")).first()
    reset, load = last["reset"], last["load"]
    if load is None and reset is None:
        return None, ops
    if load is None or (reset is not None and reset > load["op_idx"]):
        return None, ops.where(F.col("op_idx") > reset)
    own = mine & F.col("node").eqNullSafe(F.lit(load["node"])) & (F.col("op_idx") <= load["op_idx"])
    before = ops.where((F.col("op_idx") < load["op_idx"]) & ~own).agg(F.max("op_idx")).first()[0]
    rows = ops.where(own)
    return rows if before is None else rows.where(F.col("op_idx") > before), ops.where(F.col("op_idx") > load["op_idx"])


def births(ops: DataFrame, load: DataFrame | None = None) -> DataFrame:
    """(context, born): each context's first operation; "" and all contexts that ``load`` mentions were always there.

    Self edges, votes and other pairs with polls open no context; any other operation that names one does.
    """
    poll = lambda c: F.coalesce(F.col(c).startswith("V") | F.col(c).startswith("P"), F.lit(False))
    edge = F.col("kind").isin("edge", "delete_edge") & (F.col("src") != F.col("dst")) & ~poll("src") & ~poll("dst")
    found = ops.where(edge | F.col("kind").isin("create_context", "delete_node", "zero_opinion", "calculate")).groupBy("context").agg(F.min("op_idx").alias("born"))
    always = _aggregate(ops)
    always = always if load is None else always.union(load.select("context"))
    return found.unionByName(always.withColumn("born", F.lit(_ALWAYS).cast("long"))).groupBy("context").agg(F.min("born").alias("born"))


def route(ops: DataFrame, load: DataFrame | None = None) -> DataFrame:
    """Edge operations by the context they reach.

    User to user goes to every context born by then, the named one and "" included; other edges to the named
    context and to "". A context that an edge creates doesn't get earlier edges; see :func:`seed`. Contexts of a
    bulk ``load`` that came before are there from the start.
    """
    edges = ops.where("kind in ('edge', 'delete_edge')").withColumn("amount", F.when(F.col("kind") == "delete_edge", 0.0).otherwise(F.col("amount")))
    both, mixed = _pairs()
    born = checked(stage(births(ops, load), "births"), 64)
    users = edges.where(both).drop("context").join(born, F.col("born") <= F.col("op_idx"))
    objects = edges.where(mixed).withColumn("context", F.explode(F.array_distinct(F.array(F.col("context"), F.lit("")))))
    return users.select(*_OPS).unionByName(objects.select(*_OPS))


def route_to(ops: DataFrame, context: str, load: DataFrame | None = None) -> DataFrame:
    """:func:`route`, of one context alone: one pass, without joins or copies."""
    both, mixed = _pairs()
    if context:
        born = births(ops, load).where(F.col("context") == context).first()
        if born is None:
            return ops.select(*_OPS).limit(0)
        both, mixed = both & (F.col("op_idx") >= born["born"]), mixed & (F.col("context") == context)
    edges = ops.where("kind in ('edge', 'delete_edge')").where(both | mixed)
    amount = F.when(F.col("kind") == "delete_edge", 0.0).otherwise(F.col("amount"))
    return edges.withColumns({"amount": amount, "context": F.lit(context)}).select(*_OPS)


def seed(ops: DataFrame, settings: Settings | None = None, load: DataFrame | None = None, routed: DataFrame | None = None) -> DataFrame:
    """(op_idx, context, src, dst, amount, magnitude, place): edges that create_context copies into a new context.

    These are the user edges that "" holds at that moment, with the weights they have there (after decay, where
    ``settings`` are given) and without those of deleted nodes; ``place`` is their order within the context.
    Creating a context that is there already does nothing. ``routed`` is :func:`route` of the same log.
    """
    made = ops.where("kind = 'create_context'").groupBy("context").agg(F.min("op_idx").alias("at")).join(births(ops, load), "context").where("at = born and context <> ''").select("context", "at")
    made = checked(stage(made, "made"), 64)
    rows = route(ops, load) if routed is None else routed
    both = rows.where("context = ''").drop("context").join(made, F.col("op_idx") < F.col("at")).select(*_OPS)
    held = decay.decayed(both, settings) if settings else last_write(both)
    gone = ops.where("kind = 'delete_node'").drop("context").join(made, F.col("op_idx") < F.col("at")).groupBy("context", F.col("node").alias("src")).agg(F.max("op_idx").alias("del"))
    held = held.join(checked(stage(gone, "deleted"), 96), ["context", "src"], "left").where("del is null or op_idx > del")
    held = held.where(kind_of(F.col("src")) == "U").where(kind_of(F.col("dst")) == "U")
    first = registry.first_seen(both).select("context", F.col("name").alias("src"), "at")
    ordered = held.select("context", "src", "dst", F.col("weight").alias("amount")).join(first, ["context", "src"])
    placed = registry.dense_ids(ordered.select("context", "src", "dst", "amount", F.col("at").alias("order"), (F.col("amount") < 0).alias("negative")), "context", ["order", "negative", "dst"], "place")
    return placed.join(made, "context").select(F.col("at").alias("op_idx"), "context", "src", "dst", "amount", F.lit(0).cast("long").alias("magnitude"), "place")


def bulk(ops: DataFrame) -> DataFrame:
    """A bulk load: it replaces all contexts. User edges go to "" and every context it mentions, others to "" and their own.

    User edges come first, then the rest, each in the order given, all before any later operation. Votes are
    edges here; self edges, unknown kinds and object to object are dropped, though their contexts are made.
    """
    s, d = F.col("src").startswith("U"), F.col("dst").startswith("U")
    known = F.substring("src", 1, 1).isin(*KINDS) & F.substring("dst", 1, 1).isin(*KINDS)
    ok = ops.where((F.col("src") != F.col("dst")) & (s | d) & known)
    both = s & d
    contexts = ops.select("context").union(_aggregate(ops)).distinct()
    users = ok.where(both).drop("context").withColumn("op_idx", F.col("op_idx") + _LOADED).crossJoin(checked(stage(contexts, "contexts"), 64))
    objects = ok.where(~both).withColumn("context", F.explode(F.array_distinct(F.array(F.col("context"), F.lit("")))))
    return users.select(*_OPS).unionByName(objects.select(*_OPS))


def replay(ops: DataFrame, settings: Settings | None = None, context: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(routed, later): every edge operation by context, or those of one ``context``, ordered by op_idx, and the operations that still count.

    The bulk load in force comes first, then what created contexts copied, then the operations after the load.
    ``ops`` is read several times: give a written table. ``settings`` let copied weights decay.
    """
    load, later = live(ops)
    seeds = not later.where("kind = 'create_context'").isEmpty()
    if context is not None and not seeds:
        routed = route_to(later, context, load)
        return routed if load is None else bulk(load).where(F.col("context") == context).unionByName(routed), later
    routed = route(later, load)
    if load is not None:
        routed = bulk(load).unionByName(routed)
    if not seeds:
        return routed, later
    copied = seed(later, settings, load, routed).withColumn("op_idx", F.col("place") + _SEEDED)
    routed = routed.unionByName(stage(copied.select(*_OPS), "copied"))
    return routed if context is None else routed.where(F.col("context") == context), later


def last_write(routed: DataFrame) -> DataFrame:
    """(context, src, dst, weight, op_idx): the last write of each pair; weights within EPSILON of zero delete it."""
    last = routed.groupBy("context", "src", "dst").agg(F.max_by("amount", "op_idx").alias("weight"), F.max("op_idx").alias("op_idx"))
    return last.where(F.abs("weight") > EPSILON)


def drop_deleted(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """``edges`` without those that a later delete_node of their source, in their context or through "", has removed."""
    gone = ops.where("kind = 'delete_node'").select(F.explode(F.array_distinct(F.array(F.col("context"), F.lit("")))).alias("context"), F.col("node").alias("src"), F.col("op_idx").alias("del")).groupBy("context", "src").agg(F.max("del").alias("del"))
    return edges.join(checked(gone, 96), ["context", "src"], "left").where("del is null or op_idx > del").drop("del")
