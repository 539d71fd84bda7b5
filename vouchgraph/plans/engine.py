"""The engine: an operation log in, result tables out.

Everything is derived lazily from the log. Hits of egos are computed on first use and kept, the least recently
used ones given up beyond ``walks_cache_size``.
"""

from __future__ import annotations

import functools
from collections import OrderedDict
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contexts, decay, neighbors, paths, registry, scores, walks
from ..settings import EPSILON, Settings
from ..sources import oplog
from . import staging

VERSION = "0.1.0"
SCORE_COLUMNS = ["src", "dst", "score_value_of_dst", "score_value_of_src", "score_cluster_of_dst", "score_cluster_of_src"]


class TrustGraph:
    """One context of a log: nodes, edges, hits and scores."""

    def __init__(self, routed: DataFrame, ops: DataFrame, context: str, settings: Settings, with_decay: bool = True) -> None:
        self.context, self.settings = context, settings
        self._from = routed
        self._ops = ops
        self._with_decay = with_decay
        self._hits: OrderedDict[int, DataFrame] = OrderedDict()
        self._kept: list[DataFrame] = []

    @property
    def spark(self) -> SparkSession:
        return self._ops.sparkSession

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return df

    @cached_property
    def _routed(self) -> DataFrame:
        """This context's edge operations, as the written log is routed: a copy would cost more than to route again."""
        return self._from.where(F.col("context") == self.context)

    @cached_property
    def nodes(self) -> DataFrame:
        """(context, node_id, name, kind, owner, at); users that a calculate operation names are registered by it."""
        ego = F.coalesce("node", "src")
        asked = self._ops.where((F.col("kind") == "calculate") & (F.col("context") == self.context) & ego.startswith("U"))
        return self._keep(registry.register(self._routed, asked.select("context", "op_idx", ego.alias("name"))))

    @cached_property
    def edges(self) -> DataFrame:
        """(context, src, dst, weight, op_idx)."""
        found = decay.decayed(self._routed, self.settings) if self._with_decay else contexts.last_write(self._routed)
        return self._keep(contexts.drop_deleted(found, self._ops))

    @cached_property
    def links(self) -> DataFrame:
        """(src_id, dst_id, w, negative)."""
        return self._keep(walks.by_id(self.edges, self.nodes))

    @cached_property
    def network(self) -> walks.Network:
        return walks.Network(self.links, self.settings)

    @cached_property
    def owners(self) -> DataFrame:
        return self._keep(registry.object_owner(self.nodes, self.edges))

    @cached_property
    def zero(self) -> DataFrame:
        """(node, z): the last zero opinion of each node, of those set in this context after the node was registered."""
        z = self._ops.where((F.col("kind") == "zero_opinion") & (F.col("context") == self.context)).select(F.col("node").alias("name"), "score", "op_idx")
        known = z.join(self.nodes.select("name", "at", F.col("node_id").alias("node")), "name").where("op_idx * 2 > at")
        return self._keep(known.groupBy("node").agg(F.max_by("score", "op_idx").alias("z")))

    def close(self) -> None:
        """Let go of all cached tables; what is asked for later is computed again."""
        self.clear()
        while self._kept:
            self._kept.pop().unpersist()
        for name in ("nodes", "edges", "links", "network", "owners", "zero"):
            self.__dict__.pop(name, None)

    def node_id(self, name: str) -> int | None:
        row = self.nodes.where(F.col("name") == name).select("node_id").first()
        return row[0] if row else None

    def user_id(self, name: str) -> int | None:
        return self.node_id(name) if name.startswith("U") else None

    def calculate(self, egos: DataFrame) -> DataFrame:
        """Hits of ``egos`` (ego), all in one pass."""
        return self.network.hits(egos)

    def hits(self, ego: int) -> DataFrame:
        """Cached hits of one ego."""
        if ego in self._hits:
            self._hits.move_to_end(ego)
        else:
            self._hits[ego] = self.calculate(self.spark.range(ego, ego + 1).select(F.col("id").alias("ego"))).persist()
            while self.settings.walks_cache_size and len(self._hits) > self.settings.walks_cache_size:
                self._hits.popitem(last=False)[1].unpersist()
        return self._hits[ego]

    def take_over(self, old: TrustGraph | None) -> None:
        """Cached hits of ``old``, the graph before its log went on, of all egos whose walks can't have changed.

        A walk depends on the edges of the nodes it visits alone: an ego is walked again iff a hit node's outgoing
        edges differ. Nothing is taken over if ids have changed, as after a bulk load or a reset.
        """
        if old is None or not old._hits:
            return
        same = old.nodes.select("node_id", "name").join(self.nodes.select("node_id", "name"), ["node_id", "name"]).count()
        if same != old.nodes.count():
            return
        both = old.links.unionByName(self.links)
        changed = both.groupBy(*both.columns).count().where("count = 1").select(F.col("src_id").alias("src"))
        every = functools.reduce(DataFrame.unionByName, old._hits.values())
        again = {r["ego"] for r in walks.touched(every, changed).collect()}  # at most a row a cached ego
        self._hits.update((ego, h) for ego, h in old._hits.items() if ego not in again)

    def clear_ego(self, name: str) -> None:
        found = self._hits.pop(self.node_id(name), None)
        if found is not None:
            found.unpersist()

    def clear(self) -> None:
        while self._hits:
            self._hits.popitem()[1].unpersist()

    def exact(self, ego: int) -> DataFrame:
        """(node, score): the limit that raw scores approach, 0 for nodes that no walk of the ego reaches."""
        found = walks.exact(self.links, ego, self.settings.alpha)
        every = self.nodes.select(F.col("node_id").alias("node")).join(found, "node", "left")
        return every.select("node", F.coalesce("score", F.lit(0.0)).alias("score"))

    def blended(self, hits: DataFrame) -> DataFrame:
        """(ego, node, score) with zero opinions."""
        return scores.blend(scores.raw(hits), self.zero, self.settings.zero_opinion_factor)

    def bounds(self, blended: DataFrame) -> DataFrame:
        return scores.quantile_bounds(blended, self.nodes, self.settings.num_score_quantiles)

    def all_users(self) -> DataFrame:
        return self.nodes.where("kind = 'U'").select(F.col("node_id").alias("ego"))


class TrustEngine:
    """Queries over a log; every result is a DataFrame with the public column names."""

    def __init__(self, ops: DataFrame, settings: Settings = Settings(), with_decay: bool = True) -> None:
        self.ops, self.settings, self.with_decay = ops, settings, with_decay
        self._graphs: dict[str, TrustGraph] = {}
        self._before: dict[str, TrustGraph] = {}

    @cached_property
    def _log(self) -> DataFrame:
        """The log as it was written down once."""
        return staging.stage(self.ops, "log")

    def _replay(self, context: str | None = None) -> tuple[DataFrame, DataFrame]:
        return contexts.replay(self._log, self.settings if self.with_decay else None, context)

    @cached_property
    def _replayed(self) -> tuple[DataFrame, DataFrame]:
        """Routed edge operations and the operations that still count."""
        return self._replay()

    @property
    def routed(self) -> DataFrame:
        return self._replayed[0]

    def graph_of(self, context: str | None = "") -> TrustGraph:
        key = context or ""
        if key not in self._graphs:
            g = self._graphs[key] = TrustGraph(*self._replay(key), key, self.settings, self.with_decay)
            g.take_over(self._before.pop(key, None))
        return self._graphs[key]

    def all_edges(self) -> DataFrame:
        """(context, src, dst, weight, op_idx) of every context."""
        routed, later = self._replayed
        return contexts.drop_deleted(decay.decayed(routed, self.settings) if self.with_decay else contexts.last_write(routed), later)

    def close(self) -> None:
        """Let go of what all contexts have cached."""
        for g in self._graphs.values():
            g.close()

    def reset(self) -> TrustEngine:
        """An engine without any operations."""
        return TrustEngine(self.ops.limit(0), self.settings, self.with_decay)

    def apply(self, more: DataFrame) -> TrustEngine:
        """An engine whose log goes on with ``more``; this one keeps what it has read.

        Hits of egos whose walks meet no node with changed edges are taken over, the others are walked again.
        """
        after = TrustEngine(self.ops.unionByName(more), self.settings, self.with_decay)
        after._before = dict(self._graphs)
        return after

    def _empty(self, schema: str) -> DataFrame:
        return self.ops.sparkSession.createDataFrame([], schema)

    def _score_rows(self, g: TrustGraph, ego: int, ego_name: str, rows: DataFrame, value: str) -> DataFrame:
        """Public columns of (node, ``value``, cluster, position): with the reverse score of each node's owner."""
        names = g.nodes.select(F.col("node_id").alias("node"), "name")
        own = g.owners.join(g.nodes.select(F.col("name").alias("object_owner"), F.col("node_id").alias("owner_id")), "object_owner", "left").select("name", "owner_id")
        shown = staging.stage(rows.select("node", value, "cluster", "position"), "page").join(names, "node").join(own, "name", "left")
        if self.settings.reverse == "full":
            owners = staging.stage(shown.where("owner_id is not null").select(F.col("owner_id").alias("ego")).distinct(), "owners")
            back = staging.stage(g.blended(g.calculate(owners)), "reverse")
            both = scores.clustered(back.where(F.col("node") == ego), g.nodes, g.bounds(back), by_ego_kind=True)
            both = both.select(F.col("ego").alias("owner_id"), F.col("score").alias("rs"), F.col("cluster").alias("rc"))
            shown = shown.join(both, "owner_id", "left")
        else:
            shown = shown.withColumns({"rs": F.lit(0.0), "rc": F.lit(0)})
        return shown.select(F.lit(ego_name).alias("src"), F.col("name").alias("dst"), F.col(value).alias("score_value_of_dst"), F.coalesce("rs", F.lit(0.0)).alias("score_value_of_src"), F.col("cluster").cast("int").alias("score_cluster_of_dst"), F.coalesce("rc", F.lit(0)).cast("int").alias("score_cluster_of_src"), "position").orderBy("position")

    def scores(self, ego: str, context: str | None = "", kind: str = "", hide_personal: bool = False, gt: float | None = None, gte: float | None = None, lt: float | None = None, lte: float | None = None, index: int | None = 0, count: int | None = 16) -> DataFrame:
        """Nodes by falling absolute score; with position, the order."""
        oplog.required(ego, "src")
        oplog.bounds(gt, gte, lt, lte)
        index, count = oplog.page(index, count)
        g = self.graph_of(context)
        me = g.user_id(ego)
        if me is None:
            return self._empty("src string, dst string, score_value_of_dst double, score_value_of_src double, score_cluster_of_dst int, score_cluster_of_src int, position int")
        blended = g.blended(g.hits(me))
        bounds = g.bounds(blended)
        found = scores.omit_negative(blended, g.links) if self.settings.omit_neg_edges_scores else blended
        named = found.join(g.nodes.select(F.col("node_id").alias("node"), F.col("kind").alias("k"), "owner"), "node")
        if kind:
            named = named.where(F.col("k") == kind)
        if hide_personal:
            named = named.where(~F.col("owner").eqNullSafe(F.lit(ego)))
        named = named.where(scores.in_bounds(F.col("score"), gt, gte, lt, lte, self.settings.compat_bounds))
        page = scores.paged(named.select("ego", "node", "score"), scores.default_order(), index, count)
        rows = scores.clustered(page, g.nodes, bounds).join(page.select("node", "position"), "node")
        return self._score_rows(g, me, ego, rows, "score")

    def node_score(self, ego: str, dst: str, context: str | None = "") -> DataFrame:
        """One row, 0 for a node without hits; the cluster is by the bounds of the ego's kind."""
        oplog.required(ego, "src")
        oplog.required(dst, "dst")
        g = self.graph_of(context)
        me, to = g.user_id(ego), g.node_id(dst)
        if me is None or to is None:
            return self.scores("", context)
        blended = g.blended(g.hits(me))
        one = self.ops.sparkSession.createDataFrame([(me, to)], "ego long, node long").join(blended, ["ego", "node"], "left").select("ego", "node", F.coalesce("score", F.lit(0.0)).alias("score"))
        rows = scores.clustered(one, g.nodes, g.bounds(blended), by_ego_kind=True).withColumn("position", F.lit(1))
        return self._score_rows(g, me, ego, rows, "score")

    def neighbors(self, ego: str, focus: str, direction: int = 0, context: str | None = "", kind: str = "", hide_personal: bool = False, gt: float | None = None, gte: float | None = None, lt: float | None = None, lte: float | None = None, index: int | None = 0, count: int | None = 16, kind_filter: bool = False) -> DataFrame:
        """The focus's edges: the value is the edge's weight, the cluster the ego's of that node; own nodes come first."""
        oplog.required(ego, "ego")
        oplog.required(focus, "focus")
        oplog.bounds(gt, gte, lt, lte)
        oplog.direction(direction)
        index, count = oplog.page(index, count)
        g = self.graph_of(context)
        me = g.user_id(ego)
        if me is None or g.node_id(focus) is None:
            return self.scores("", context)
        found = neighbors.neighbors(g.edges, g.owners, focus, direction, kind or None, kind_filter)
        named = found.withColumnRenamed("node", "name").join(g.nodes.select("name", F.col("node_id").alias("node"), "owner"), "name")
        if hide_personal:
            named = named.where(~F.col("owner").eqNullSafe(F.lit(ego)))
        named = named.where(scores.in_bounds(F.col("weight"), gt, gte, lt, lte, self.settings.compat_bounds)).withColumn("mine", F.col("owner").eqNullSafe(F.lit(ego)))
        page = scores.paged(named.select("node", "weight", "mine", "inbound"), [F.col("mine").desc(), *scores.default_order("weight"), F.col("inbound")], index, count)
        blended = g.blended(g.hits(me))
        marks = scores.clustered(blended, g.nodes, g.bounds(blended)).select("node", "cluster")
        rows = page.join(marks, "node", "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))
        return self._score_rows(g, me, ego, rows, "weight")

    def mutual_scores(self, ego: str, context: str | None = "") -> DataFrame:
        """Users the ego scores above 0, by node id, with their score of the ego; only these users walk."""
        oplog.required(ego, "ego")
        g = self.graph_of(context)
        me = g.user_id(ego)
        if me is None:
            return self.scores("", context)
        mine = g.blended(g.hits(me))
        liked = mine.where("score > 0").join(g.all_users().withColumnRenamed("ego", "node"), "node").select(F.col("node").alias("ego"))
        others = staging.stage(g.blended(g.calculate(staging.stage(liked, "liked"))), "mutual")
        own = scores.clustered(mine, g.nodes, g.bounds(mine)).withColumnRenamed("cluster", "c")
        back = scores.clustered(others.where(F.col("node") == me), g.nodes, g.bounds(others), by_ego_kind=True).select(F.col("ego").alias("node"), F.col("score").alias("rs"), F.col("cluster").alias("rc"))
        users = g.nodes.where("kind = 'U'").select(F.col("node_id").alias("node"), "name")
        both = own.where("score > 0").join(users, "node").join(back, "node", "left")
        return both.select(F.lit(ego).alias("src"), F.col("name").alias("dst"), F.col("score").alias("score_value_of_dst"), F.coalesce("rs", F.lit(0.0)).alias("score_value_of_src"), F.col("c").cast("int").alias("score_cluster_of_dst"), F.coalesce("rc", F.lit(0)).cast("int").alias("score_cluster_of_src"), F.col("node").alias("position")).orderBy("position")

    def graph(self, ego: str, focus: str, context: str | None = "", positive_only: bool = False, index: int | None = 0, count: int | None = 16) -> DataFrame:
        """Path from ego to focus and the focus's neighbourhood, with the ego's scores of the targets."""
        oplog.required(ego, "ego")
        oplog.required(focus, "focus")
        index, count = oplog.page(index, count)
        g = self.graph_of(context)
        me = g.user_id(ego)
        schema = "src string, dst string, weight double, score_value_of_dst double, score_value_of_ego double, score_cluster_of_dst int, score_cluster_of_ego int, position int"
        known = g.node_id(focus) is not None
        if not known or (me is None and not self.settings.force_read_graph_conn):
            return self._empty(schema)
        shown = paths.view(g.edges, ego, focus, index, count, positive_only, self.settings.force_read_graph_conn)
        if me is None:
            zero = {c: F.lit(0).cast("double" if "value" in c else "int") for c in ("score_value_of_dst", "score_value_of_ego", "score_cluster_of_dst", "score_cluster_of_ego")}
            return shown.withColumns(zero).select(*[c.split(" ")[0] for c in schema.split(", ")])
        rows = shown.select(F.col("dst").alias("name"), F.col("src").alias("from"), "weight", F.col("position").alias("place")).join(g.nodes.select("name", F.col("node_id").alias("node")), "name")
        blended = g.blended(g.hits(me))
        marks = scores.clustered(rows.select(F.lit(me).alias("ego"), "node").distinct().join(blended, ["ego", "node"], "left").select("ego", "node", F.coalesce("score", F.lit(0.0)).alias("score")), g.nodes, g.bounds(blended), by_ego_kind=True)
        full = self._score_rows(g, me, ego, rows.join(marks.select("node", "score", "cluster"), "node").withColumn("position", F.col("place")), "score").drop("src")
        return full.join(shown.select("position", F.col("src"), "weight"), "position").select("src", "dst", "weight", "score_value_of_dst", F.col("score_value_of_src").alias("score_value_of_ego"), "score_cluster_of_dst", F.col("score_cluster_of_src").alias("score_cluster_of_ego"), "position").orderBy("position")

    def nodelist(self, context: str | None = "") -> DataFrame:
        return self.graph_of(context).nodes.orderBy("node_id").select(F.col("name").alias("node"))

    def edgelist(self, context: str | None = "") -> DataFrame:
        g = self.graph_of(context)
        ids = g.nodes.select(F.col("name").alias("src"), "node_id")
        return g.edges.join(ids, "src").orderBy("node_id", (F.col("weight") < 0), "dst").select("src", "dst", "weight")

    def connected(self, node: str, context: str | None = "") -> DataFrame:
        oplog.required(node, "node")
        return self.graph_of(context).edges.where(F.col("src") == node).select("src", "dst")

    def register_views(self, context: str | None = "") -> None:
        """Temp views trust_nodes and trust_edges for SQL."""
        g = self.graph_of(context)
        g.nodes.createOrReplaceTempView("trust_nodes")
        g.edges.createOrReplaceTempView("trust_edges")

    def version(self) -> str:
        return VERSION

    def zerorec(self) -> None:
        raise NotImplementedError("zerorec is removed; set zero opinions, or compute them with operators.polls.pagerank")

    def recalculate_clustering(self) -> None:
        """Accepted and without effect: clusters always follow the log."""


__all__ = ["TrustEngine", "TrustGraph", "SCORE_COLUMNS", "EPSILON"]
