"""The whole request surface in one object: writes that append to a log, reads as DataFrames, table functions for SQL."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbors, polls, scores
from ..settings import Settings
from ..sources import oplog
from .engine import VERSION, TrustEngine, TrustGraph
from .staging import checked, stage

_COLUMNS = "src STRING, dst STRING, score_value_of_dst DOUBLE, score_value_of_src DOUBLE, score_cluster_of_dst INT, score_cluster_of_src INT"


class TrustService:
    """Writes wait in order until a read or ``sync``; then the engine's log goes on with them as one written batch.

    Null required arguments are errors, a null context is "", a null or negative index is magnitude 0. A bulk load
    takes effect as a whole. Hits of egos whose walks meet no changed node survive writes.
    """

    def __init__(self, spark: SparkSession, settings: Settings = Settings(), log: DataFrame | None = None) -> None:
        self.spark, self.settings = spark, settings
        self._engine = TrustEngine(log if log is not None else spark.createDataFrame([], oplog.SCHEMA), settings)
        self._waiting: list[tuple[Any, ...]] = []
        last = None if log is None else log.agg(F.max("op_idx")).first()[0]
        self._next = 0 if last is None else last + 1
        self._filters: dict[str, DataFrame] = {}

    # --- writes ---

    def _write(self, kind: str, context: str | None, src: str | None = None, dst: str | None = None, amount: float | None = None, index: int | None = None, node: str | None = None, score: float | None = None) -> None:
        self._waiting.append((self._next, context or "", kind, src, dst, None if amount is None else float(amount), oplog.magnitude(index), node, None if score is None else float(score)))
        self._next += 1

    def put_edge(self, src: str, dst: str, weight: float, context: str | None = "", index: int | None = -1) -> tuple[str, str, float]:
        for value, name in ((src, "src"), (dst, "dst"), (weight, "weight")):
            oplog.required(value, name)
        self._write("edge", context, src, dst, weight, index)
        return src, dst, weight

    def delete_edge(self, src: str, dst: str, context: str | None = "", index: int | None = -1) -> None:
        oplog.required(src, "src")
        oplog.required(dst, "dst")
        self._write("delete_edge", context, src, dst, 0.0, index)

    def delete_node(self, node: str, context: str | None = "") -> None:
        oplog.required(node, "node")
        self._write("delete_node", context, node=node)

    def create_context(self, context: str) -> None:
        oplog.required(context, "context")
        self._write("create_context", context)

    def set_zero_opinion(self, node: str, score: float, context: str | None = "") -> None:
        oplog.required(node, "node")
        oplog.required(score, "score")
        self._write("zero_opinion", context, node=node, score=score)

    def calculate(self, ego: str, context: str | None = "") -> None:
        oplog.required(ego, "ego")
        self._write("calculate", context, node=ego)

    def reset(self) -> None:
        self._write("reset", "")

    def bulk_load_edges(self, src: Sequence[str], dst: Sequence[str], weight: Sequence[float], magnitude: Sequence[int], context: Sequence[str]) -> None:
        """Five arrays of one length replace all contexts."""
        if len({len(x) for x in (src, dst, weight, magnitude, context)}) != 1:
            raise ValueError("all arrays must have the same length")
        if not src:
            return self.reset()
        batch = f"load-{self._next}"
        for s, d, w, m, c in zip(src, dst, weight, magnitude, context):
            self._write("bulk_load", c, s, d, w, m, node=batch)

    def bulk_load(self, edges: DataFrame) -> None:
        """The same for a DataFrame in the log's schema, of any size: its own op_idx orders it."""
        self.sync()
        first = edges.agg(F.min("op_idx"), F.max("op_idx")).first()
        if first[0] is None:
            return self.reset()
        shifted = oplog.log(edges, "bulk_load").withColumns({"op_idx": F.col("op_idx") - first[0] + self._next, "kind": F.lit("bulk_load"), "node": F.lit(f"load-{self._next}")})
        self._next += first[1] - first[0] + 1
        self._engine = self._engine.apply(stage(shifted, "bulk"))

    def sync(self) -> TrustEngine:
        """The engine over everything written so far."""
        if self._waiting:
            rows = oplog.log(self.spark.createDataFrame(self._waiting, oplog.SCHEMA))
            self._waiting = []
            self._engine = self._engine.apply(stage(rows, "ops"))
        return self._engine

    # --- reads ---

    def scores(self, ego: str, **args: Any) -> DataFrame:
        return self.sync().scores(ego, **args)

    def node_score(self, ego: str, dst: str, context: str | None = "") -> DataFrame:
        return self.sync().node_score(ego, dst, context)

    def neighbors(self, ego: str, focus: str, direction: int = neighbors.ALL, **args: Any) -> DataFrame:
        return self.sync().neighbors(ego, focus, direction, **args)

    def mutual_scores(self, ego: str, context: str | None = "") -> DataFrame:
        return self.sync().mutual_scores(ego, context)

    def graph(self, ego: str, focus: str, **args: Any) -> DataFrame:
        return self.sync().graph(ego, focus, **args)

    def nodelist(self, context: str | None = "") -> DataFrame:
        return self.sync().nodelist(context)

    def edgelist(self, context: str | None = "") -> DataFrame:
        return self.sync().edgelist(context)

    def connected(self, node: str, context: str | None = "") -> DataFrame:
        return self.sync().connected(node, context)

    def version(self) -> str:
        return VERSION

    # --- new edges, zero opinions ---

    def get_new_edges_filter(self, ego: str) -> bytes:
        """The ego's filter as bytes: its bits, eight bytes a word, little end first; empty without one."""
        oplog.required(ego, "ego")
        found = self._filters.get(ego)
        row = None if found is None else found.first()
        if row is None:
            return b""
        out = bytearray(8 * row["words"])
        for bit in row["filter"]:  # at most 64 bits a word of one ego's filter
            out[bit >> 3] |= 1 << (bit & 7)
        return bytes(out)

    def set_new_edges_filter(self, ego: str, data: bytes) -> None:
        oplog.required(ego, "ego")
        bits = [8 * i + j for i, x in enumerate(data) for j in range(8) if x >> j & 1]
        self._filters[ego] = self.spark.createDataFrame([(ego, bits, len(data) // 8)], "ego string, filter array<long>, words int")

    def fetch_new_edges(self, ego: str, prefix: str | None = "", context: str | None = "") -> DataFrame:
        """Nodes with the prefix, scored at least 1e-6, that the ego's filter doesn't hold; it holds them from then on.

        The filter is rebuilt over everything seen, with twice the words until no unseen node of the context seems seen.
        """
        oplog.required(ego, "ego")
        g = self.sync().graph_of(context)
        me = g.user_id(ego)
        if me is None:
            return self._engine.scores("", context)
        names = g.nodes.select(F.col("node_id").alias("node"), "name")
        own = stage(g.blended(g.hits(me)).join(names, "node").select(F.lit(ego).alias("ego"), "name", "node", "score"), "new-edges")
        wanted = own.where(F.col("score") >= 1e-6).where(F.col("name").startswith(prefix or ""))
        old = self._filters.get(ego)
        words = polls.WORDS if old is None else old.first()["words"]
        marked = wanted.withColumn("seen", F.lit(False)) if old is None else polls.maybe_seen(wanted, old.drop("words"), words)
        new = stage(marked.where("not seen").drop("seen"), "new-edges")
        every = own if old is None else polls.maybe_seen(own, old.drop("words"), words).withColumn("known", F.col("seen")).drop("seen")
        seen = stage((new if old is None else every.where("known").drop("known").unionByName(new)).select("ego", "name").distinct(), "seen")
        self._filters[ego] = stage(polls.rebuilt(seen, own.select("ego", "name"), words), "filter")
        page = new.select(F.lit(me).cast("long").alias("ego"), "node", "score")
        rows = scores.clustered(page, g.nodes, g.bounds(g.blended(g.hits(me)))).withColumn("position", F.col("node"))
        return self._engine._score_rows(g, me, ego, rows, "score").drop("position")

    def recompute_zero_opinions(self, context: str | None = "", top: int = 100) -> DataFrame:
        """(name, score): PageRank over who scores whom, for all users; the top ones are written as the context's zero opinions."""
        g = self.sync().graph_of(context)
        found = polls.zero_opinions(scores.raw(g.calculate(g.all_users())), g.nodes, top).join(g.nodes.select(F.col("node_id").alias("node"), "name"), "node").select("name", "score")
        rows = found.collect()  # top rows at most
        for r in g.zero.join(g.nodes.select(F.col("node_id").alias("node"), "name"), "node").select("name").collect():  # and those of before
            self.set_zero_opinion(r["name"], 0.0, context)
        for r in rows:
            self.set_zero_opinion(r["name"], r["score"], context)
        return self.spark.createDataFrame(rows, "name string, score double")

    # --- SQL ---

    def register_functions(self, context: str | None = "", prefix: str = "trust_") -> None:
        """Table functions of the context for SQL: scores, node_score, neighbors, mutual_scores, nodelist, edgelist, connected.

        The scores of all users are computed once and written; the functions read them, as they are now. Arguments
        have the defaults of the methods and can be named: ``SELECT * FROM trust_scores('U1', kind => 'B')``. A graph view
        needs a search and stays a method.
        """
        g = self.sync().graph_of(context)
        views = _views(g)
        for name, df in views.items():
            df.createOrReplaceTempView(f"{prefix}v_{name}")
        v = prefix + "v_"
        bound = "(gt IS NULL OR value > gt) AND (gte IS NULL OR value >= gte) AND (lt IS NULL OR value < lt) AND (lte IS NULL OR value <= lte)"
        limits = "lt DOUBLE DEFAULT NULL, lte DOUBLE DEFAULT NULL, gt DOUBLE DEFAULT NULL, gte DOUBLE DEFAULT NULL, index BIGINT DEFAULT 0, count BIGINT DEFAULT 16"
        paging = "place > greatest(0, coalesce(index, 0)) AND place <= greatest(0, coalesce(index, 0)) + coalesce(greatest(0, count), 2147483647)"
        shown = "src, dst, value AS score_value_of_dst, back AS score_value_of_src, cluster AS score_cluster_of_dst, back_cluster AS score_cluster_of_src"
        create = f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}"
        run = self.spark.sql
        run(f"""{create}scores(ego STRING, hide_personal BOOLEAN DEFAULT FALSE, kind STRING DEFAULT '', {limits}) RETURNS TABLE({_COLUMNS}) RETURN
            SELECT {shown} FROM (SELECT *, row_number() OVER (ORDER BY abs(value) DESC, node) AS place FROM {v}scores WHERE src = ego AND shown
              AND (kind = '' OR node_kind = kind) AND NOT (coalesce(hide_personal, FALSE) AND owner <=> ego) AND {bound}) WHERE {paging}""")
        run(f"""{create}node_score(ego STRING, target STRING) RETURNS TABLE({_COLUMNS}) RETURN
            SELECT src, dst, value, back, user_cluster, back_cluster FROM {v}pairs WHERE src = ego AND dst = target""")
        run(f"""{create}neighbors(ego STRING, focus STRING, direction INT DEFAULT 0, hide_personal BOOLEAN DEFAULT FALSE, {limits}) RETURNS TABLE({_COLUMNS}) RETURN
            SELECT {shown} FROM (SELECT *, row_number() OVER (ORDER BY (owner <=> ego) DESC, abs(value) DESC, node, inbound) AS place FROM (
              SELECT p.src, p.dst, p.node, p.owner, e.weight AS value, p.cluster, p.back, p.back_cluster, e.inbound FROM {v}incident e JOIN {v}pairs p ON p.src = ego AND p.dst = e.name
              WHERE e.focus = neighbors.focus AND (direction = 0 OR (direction = 1) = (NOT e.inbound)))
              WHERE NOT (coalesce(hide_personal, FALSE) AND owner <=> ego) AND {bound}) WHERE {paging}""".replace("neighbors.focus", f"{prefix}neighbors.focus"))
        run(f"""{create}mutual_scores(ego STRING) RETURNS TABLE({_COLUMNS}) RETURN SELECT {shown} FROM {v}scores WHERE src = ego AND node_kind = 'U' AND value > 0""")
        run(f"{create}nodelist() RETURNS TABLE(node STRING) RETURN SELECT name FROM {v}nodes")
        run(f"{create}edgelist() RETURNS TABLE(src STRING, dst STRING, weight DOUBLE) RETURN SELECT src, dst, weight FROM {v}edges")
        run(f"{create}connected(node STRING) RETURNS TABLE(src STRING, dst STRING) RETURN SELECT src, dst FROM {v}edges WHERE src = node")


def _views(g: TrustGraph) -> dict[str, DataFrame]:
    """Written tables that the SQL functions read: all users' scores and pairs with clusters and reverse scores, edges both ways, nodes."""
    names = g.nodes.select(F.col("node_id").alias("node"), F.col("name").alias("dst"), F.col("kind").alias("node_kind"), "owner")
    users = g.nodes.where("kind = 'U'").select(F.col("node_id").alias("ego"), F.col("name").alias("src"))
    blended = stage(g.blended(g.calculate(g.all_users())), "all-scores")
    bounds = stage(g.bounds(blended), "all-bounds")
    kinds = bounds.select("ego", "kind", "bounds")
    owners = g.owners.select(F.col("name").alias("dst"), F.col("object_owner").alias("holder"))
    back = blended.join(users, "ego").join(names.select("node", F.col("dst").alias("me")), "node").join(checked(kinds.where("kind = 'U'").drop("kind"), 900), "ego", "left")
    back = back.select(F.col("me").alias("src"), F.col("src").alias("holder"), F.col("score").alias("back"), scores.cluster(F.col("score"), F.col("bounds")).alias("back_cluster"))
    pairs = users.crossJoin(checked(names, 64)).join(blended, ["ego", "node"], "left").join(owners, "dst", "left").join(back, ["src", "holder"], "left")
    pairs = pairs.join(kinds.withColumnRenamed("kind", "node_kind"), ["ego", "node_kind"], "left").join(kinds.where("kind = 'U'").select("ego", F.col("bounds").alias("usual")), "ego", "left")
    value = F.coalesce("score", F.lit(0.0))
    pairs = stage(pairs.select("src", "dst", "node", "node_kind", "owner", value.alias("value"), F.col("score").isNotNull().alias("there"), scores.cluster(value, F.col("bounds")).alias("cluster"), scores.cluster(value, F.col("usual")).alias("user_cluster"), F.coalesce("back", F.lit(0.0)).alias("back"), F.coalesce("back_cluster", F.lit(0)).alias("back_cluster")), "all-pairs")
    edges = g.edges.select("src", "dst", "weight")
    there = pairs.where("there").drop("there")
    shown = there.join(edges.where("weight < 0").select("src", "dst", F.lit(True).alias("negative")), ["src", "dst"], "left").withColumn("shown", F.col("negative").isNull() if g.settings.omit_neg_edges_scores else F.lit(True)).drop("negative")
    incident = edges.select(F.col("src").alias("focus"), F.col("dst").alias("name"), "weight", F.lit(False).alias("inbound")).unionByName(edges.select(F.col("dst").alias("focus"), F.col("src").alias("name"), "weight", F.lit(True).alias("inbound")))
    return {"scores": shown, "pairs": pairs.drop("there"), "incident": incident, "nodes": g.nodes.select("name", "node_id"), "edges": edges}


__all__ = ["TrustService"]
