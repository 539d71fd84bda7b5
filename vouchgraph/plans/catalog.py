"""Every graph query over the test graphs, with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import contexts, decay, neighbors, polls, scores, walks
from ..settings import Settings
from ..sources import oplog
from . import histories, reads
from .engine import TrustEngine
from .staging import shared_dir, stage
from .testgraphs import MIXED_OPS, USER_OPS, mixed_ops, user_ops

Query = Callable[[SparkSession, str], DataFrame]
EGOS = ("U1", "U7", "U12")
FOCUS = "U3"
WALKS = 400
#: Settings of the walk queries; the SQL repeats their values.
ORACLE = Settings(num_walks=WALKS, seed=20_240, num_score_quantiles=10)


def r9(c: str | Column, name: str) -> Column:
    return F.round(c, 9).alias(name)


# --- edges and contexts -------------------------------------------------------------------------------


def _user_log(spark: SparkSession, sf: str) -> DataFrame:
    """User operations with deletions of nodes: every 997th event deletes its user."""
    ops = user_ops(spark, sf)
    gone = ops.where("op_idx % 997 = 500").select((F.col("op_idx")).alias("op_idx"), "context", F.lit("delete_node").alias("kind"), F.col("src").alias("node"))
    return ops.where("op_idx % 997 <> 500").unionByName(oplog.log(gone, "delete_node"))


def edges_lww(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.last_write(contexts.route(user_ops(spark, sf))).select("context", "src", "dst", "weight")


_ROUTED = """
valid AS (SELECT * FROM ops WHERE src <> dst),
born AS (SELECT context, min(op_idx) AS born FROM valid GROUP BY context UNION ALL SELECT '', -1),
routed AS (SELECT v.op_idx, b.context, v.src, v.dst, v.amount, v.magnitude FROM valid v JOIN born b ON b.born <= v.op_idx)"""
_LAST = """
last AS (SELECT context, src, dst, arg_max(amount, op_idx) AS weight, max(op_idx) AS op_idx FROM routed GROUP BY context, src, dst),
edges AS (SELECT * FROM last WHERE abs(weight) > 1e-6)"""


def edges_decay(spark: SparkSession, sf: str) -> DataFrame:
    settings = Settings(vsids_bump=1.3, deletion_ratio=0.05)
    return decay.decayed(contexts.route(stage(user_ops(spark, sf), "log")), settings).select("context", "src", "dst", F.round("weight", 4).alias("weight"))


_DECAY = """
scaled AS (SELECT *, amount * pow(1.3::DOUBLE, magnitude) AS s FROM routed),
marked AS (SELECT *, max(abs(s)) OVER (PARTITION BY context, src) AS most, max(op_idx) OVER (PARTITION BY context, src) AS final,
                  row_number() OVER (PARTITION BY context, src, dst ORDER BY op_idx DESC) AS rn FROM scaled)
SELECT context, src, dst, round(s, 4) AS weight FROM marked
WHERE rn = 1 AND abs(s) > 1e-6 AND (op_idx = final OR abs(s) > most * 0.05)"""


def edges_after_delete_node(spark: SparkSession, sf: str) -> DataFrame:
    ops = _user_log(spark, sf)
    return contexts.drop_deleted(contexts.last_write(contexts.route(ops)), ops).select("context", "src", "dst", "weight")


_DELETED = f"""WITH {USER_OPS.replace("ops AS", "all_ops AS")},
ops AS (SELECT * FROM all_ops WHERE op_idx % 997 <> 500),
gone AS (SELECT context, src, max(op_idx) AS del FROM (
  SELECT context, src, op_idx FROM all_ops WHERE op_idx % 997 = 500 UNION ALL SELECT '', src, op_idx FROM all_ops WHERE op_idx % 997 = 500) GROUP BY ALL),
{_ROUTED},{_LAST}
SELECT e.context, e.src, e.dst, e.weight FROM edges e LEFT JOIN gone g ON g.context = e.context AND g.src = e.src WHERE g.del IS NULL OR e.op_idx > g.del"""


def router_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.route(user_ops(spark, sf)).groupBy("context").agg(F.count("*").alias("n"), F.min("op_idx").alias("first_op"), F.count_distinct("src").alias("sources"), (F.sum(F.round(F.col("amount") * 100).cast("long"))).alias("cents"))


_NEW_AT = 400


def create_context_seed(spark: SparkSession, sf: str) -> DataFrame:
    ops = user_ops(spark, sf)
    made = spark.createDataFrame([(_NEW_AT, "fresh")], "op_idx long, context string")
    log = ops.where(F.col("op_idx") != _NEW_AT).unionByName(oplog.log(made, "create_context"))
    return contexts.seed(log).select("op_idx", "context", "src", "dst", "amount", "magnitude")


def bulk_load_contexts(spark: SparkSession, sf: str) -> DataFrame:
    ops = mixed_ops(spark, sf).withColumn("context", F.when(F.col("op_idx") % 3 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("op_idx") % 3).cast("string"))))
    return contexts.last_write(contexts.bulk(ops)).select("context", "src", "dst", "weight")


_BULK = f"""WITH {MIXED_OPS.replace("ops AS", "raw AS")},
ops AS (SELECT op_idx, CASE WHEN op_idx % 3 = 0 THEN '' ELSE 'c' || (op_idx % 3) END AS context, src, dst, amount FROM raw),
names AS (SELECT DISTINCT context FROM ops UNION SELECT ''),
routed AS (
  SELECT op_idx, n.context, src, dst, amount FROM ops, names n WHERE src[1] = 'U' AND dst[1] = 'U'
  UNION ALL SELECT op_idx + (1::BIGINT << 61), context, src, dst, amount FROM ops WHERE NOT (src[1] = 'U' AND dst[1] = 'U')
  UNION ALL SELECT op_idx + (1::BIGINT << 61), '', src, dst, amount FROM ops WHERE NOT (src[1] = 'U' AND dst[1] = 'U') AND context <> ''),{_LAST}
SELECT context, src, dst, weight FROM edges"""


def csv_source(spark: SparkSession, sf: str) -> DataFrame:
    """Edges written as CSV and read back."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    user_ops(spark, sf).where("context = 'view'").select("src", "dst", F.col("amount").alias("weight")).write.csv(path, header=True)
    return oplog.read_csv(spark, path).select("context", "kind", "src", "dst", "amount", "magnitude")


def array_source(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from rows of parallel arrays, a row a day."""
    ops = user_ops(spark, sf)
    rows = ops.groupBy(F.col("magnitude").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("op_idx", "src", "dst", "amount", "magnitude", "context"))).alias("e"))
    arrays = rows.select("batch", *[F.col(f"e.{c}").alias("weight" if c == "amount" else c) for c in ("src", "dst", "amount", "magnitude", "context")])
    return oplog.from_array_columns(arrays).select((F.col("op_idx") % (1 << 32)).alias("place"), "context", "src", "dst", "amount", "magnitude")


# --- nodes --------------------------------------------------------------------------------------------


def node_registry(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_engine(spark, sf).graph_of().nodes.select("node_id", "name", "kind", "owner")


_NODES = """
seen AS (
  SELECT context, op_idx * 2 AS pos, CASE WHEN src[1] <> 'U' THEN dst ELSE src END AS name, NULL::VARCHAR AS owner FROM routed
  UNION ALL
  SELECT context, op_idx * 2 + 1, CASE WHEN src[1] <> 'U' THEN src ELSE dst END, CASE WHEN src[1] <> 'U' THEN dst END FROM routed),
first_seen AS (SELECT *, row_number() OVER (PARTITION BY context, name ORDER BY pos) AS k FROM seen),
nodes AS (
  SELECT context, (row_number() OVER (PARTITION BY context ORDER BY pos) - 1)::BIGINT AS node_id, name, name[1] AS kind, owner FROM first_seen WHERE k = 1)"""
_MIXED = f"WITH {MIXED_OPS},\nrouted AS (SELECT * FROM ops WHERE src <> dst),{_LAST},{_NODES}"


def object_owner(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_engine(spark, sf).graph_of().owners.select("name", "object_owner")


def _mixed_engine(spark: SparkSession, sf: str, settings: Settings = ORACLE) -> TrustEngine:
    return TrustEngine(mixed_ops(spark, sf), settings, with_decay=False)


def nodelist(spark: SparkSession, sf: str) -> DataFrame:
    g = _mixed_engine(spark, sf).graph_of()
    return g.nodes.select(F.col("node_id").alias("position"), F.col("name").alias("node"))


def edgelist(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_engine(spark, sf).edgelist()


def connected(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_engine(spark, sf).connected(FOCUS)


def _mixed_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_engine(spark, sf).graph_of().edges


def neighbors_out(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.incident(_mixed_edges(spark, sf), FOCUS, neighbors.OUT)


def neighbors_in(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.incident(_mixed_edges(spark, sf), FOCUS, neighbors.IN)


def neighbors_all(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.incident(_mixed_edges(spark, sf), FOCUS)


_OUT = f"SELECT dst AS node, weight, false AS inbound FROM edges WHERE src = '{FOCUS}'"
_IN = f"SELECT src AS node, weight, true AS inbound FROM edges WHERE dst = '{FOCUS}'"


def neighbors_opinions(spark: SparkSession, sf: str) -> DataFrame:
    g = _mixed_engine(spark, sf).graph_of()
    return neighbors.neighbors(g.edges, g.owners, FOCUS, neighbors.IN, "O")


_OWNERS = """
owners AS (SELECT n.name, coalesce(owner, CASE WHEN kind = 'O' THEN (SELECT arg_min(e.src, e.op_idx) FROM edges e WHERE e.dst = n.name) END, n.name) AS object_owner FROM nodes n)"""


def edge_normalized_path(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.path_normalized(_mixed_edges(spark, sf)).select("src", "dst", r9("weight", "weight"))


def edge_normalized_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.neighbor_normalized(_mixed_edges(spark, sf)).select("src", "dst", r9("weight", "weight"))


_SUMS = """
sums AS (SELECT src, sum(CASE WHEN weight > 0 THEN round(abs(weight) * 1e6) ELSE 0 END)::BIGINT / 1e6::DOUBLE AS p,
                sum(CASE WHEN weight < 0 THEN round(abs(weight) * 1e6) ELSE 0 END)::BIGINT / 1e6::DOUBLE AS q FROM edges GROUP BY src)"""


def focus_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.focus_neighbors(_mixed_edges(spark, sf), FOCUS).select("dst", r9("weight", "weight"))


_TWO_HOP = f"""{_MIXED},{_SUMS},
norm AS (SELECT e.src, e.dst, weight / CASE WHEN p < 1e-6 THEN 1.0 ELSE p + q END AS w FROM edges e JOIN sums USING (src)),
f AS (SELECT dst AS via, w AS w1 FROM norm WHERE src = '{FOCUS}'),
ways AS (
  SELECT via AS dst, w1 AS weight, w1, via, 0 AS s2 FROM f WHERE via[1] = 'U'
  UNION ALL
  SELECT n.dst, CASE WHEN w1 < 0 AND n.w < 0 THEN -w1 * n.w ELSE w1 * n.w END, w1, via, CASE WHEN n.w > 1e-6 THEN 1 WHEN n.w < -1e-6 THEN -1 ELSE 0 END
  FROM f JOIN norm n ON n.src = f.via WHERE via[1] IN ('B', 'C', 'O') AND n.dst <> '{FOCUS}' AND n.dst[1] = 'U')
SELECT dst, round(weight, 9) AS weight FROM ways WHERE abs(weight) >= 1e-6
QUALIFY row_number() OVER (PARTITION BY dst ORDER BY w1 ASC, via DESC, s2 ASC) = 1"""


# --- walks and scores ---------------------------------------------------------------------------------


def _user_graph(spark: SparkSession, sf: str, settings: Settings = ORACLE):
    ops = user_ops(spark, sf).withColumn("context", F.lit(""))
    return TrustEngine(ops, settings, with_decay=False).graph_of()


def _ego_hits(spark: SparkSession, sf: str, settings: Settings = ORACLE):
    g = _user_graph(spark, sf, settings)
    egos = g.nodes.where(F.col("name").isin(*EGOS)).select(F.col("node_id").alias("ego"))
    return g, g.calculate(egos)


def _named(g, rows: DataFrame) -> DataFrame:
    n = g.nodes.select("node_id", "name")
    a = n.select(F.col("node_id").alias("ego"), F.col("name").alias("src"))
    b = n.select(F.col("node_id").alias("node"), F.col("name").alias("dst"))
    return rows.join(a, "ego").join(b, "node").drop("ego", "node")


def walk_hits(spark: SparkSession, sf: str) -> DataFrame:
    g, h = _ego_hits(spark, sf)
    return _named(g, h)


def walk_hits_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same hits by joins, as for graphs too large for a broadcast."""
    g = _user_graph(spark, sf)
    egos = g.nodes.where(F.col("name").isin(*EGOS)).select(F.col("node_id").alias("ego"))
    return _named(g, walks.joined_hits(g.links, egos, ORACLE))


_P31 = 1 << 31
_H0 = rng.mix_sql("h1", "wid")
_WALK = f"""WITH RECURSIVE {USER_OPS.replace("event_type AS context", "'' AS context")},
routed AS (SELECT * FROM ops WHERE src <> dst),{_LAST},{_NODES},
links AS (SELECT a.node_id AS s, b.node_id AS d, round(abs(weight) * 1e6)::BIGINT AS w, weight < 0 AS neg
          FROM edges e JOIN nodes a ON a.name = e.src JOIN nodes b ON b.name = e.dst),
phased AS (SELECT *, 0 AS ph FROM links UNION ALL SELECT *, 1 FROM links WHERE NOT neg),
ranges AS (SELECT *, sum(w) OVER (PARTITION BY s, ph ORDER BY d)::BIGINT AS hi, sum(w) OVER (PARTITION BY s, ph)::BIGINT AS total FROM phased),
egos AS (SELECT node_id AS ego FROM nodes WHERE name IN {EGOS}),
start0 AS (SELECT ego, wid::BIGINT AS wid, {rng.mix_sql(str(ORACLE.seed), "ego")} AS h1 FROM egos, range(0, {WALKS}) t(wid)),
start AS (SELECT ego, wid, {_H0} AS h FROM start0),
walk(ego, wid, h, step, node, ph) AS (
  SELECT ego, wid, h, 0::BIGINT, ego, 0 FROM start
  UNION ALL
  SELECT t.ego, t.wid, t.h, t.step + 1, r.d, CASE WHEN t.ph = 1 OR r.neg THEN 1 ELSE 0 END
  FROM (SELECT *, {rng.mix_sql("h", "4 * step")} AS a, {rng.mix_sql("h", "4 * step + 1")} * {_P31} + {rng.mix_sql("h", "4 * step + 2")} AS b FROM walk) t
  JOIN ranges r ON r.s = t.node AND r.ph = t.ph AND t.b % r.total >= r.hi - r.w AND t.b % r.total < r.hi
  WHERE t.a < {rng.go_on_below(ORACLE.alpha)}),
visits AS (SELECT DISTINCT ego, wid, node, ph FROM walk),
hits AS (SELECT ego, node, count(*) FILTER (ph = 0)::BIGINT AS pos_hits, count(*) FILTER (ph = 1)::BIGINT AS neg_hits FROM visits GROUP BY ego, node),
raw AS (SELECT ego, node, (pos_hits - neg_hits)::DOUBLE / sum(pos_hits + neg_hits) OVER (PARTITION BY ego)::DOUBLE AS score FROM hits)"""
_NAMES = "JOIN nodes a ON a.node_id = ego JOIN nodes b ON b.node_id = node"


def scores_raw(spark: SparkSession, sf: str) -> DataFrame:
    g, h = _ego_hits(spark, sf)
    return _named(g, scores.raw(h))


#: Zero opinions of the test graph: every fifth node.
_ZERO = "zero AS (SELECT node_id AS node, (node_id % 7 - 3) / 100.0::DOUBLE AS z FROM nodes WHERE node_id % 5 = 0)"
_BLEND = f"""{_ZERO},
mixed AS (
  SELECT ego, node, sum(s) * (1 - 0.2::DOUBLE) + 0.2::DOUBLE * sum(z) AS score FROM (
    SELECT ego, node, score AS s, 0.0::DOUBLE AS z FROM raw UNION ALL SELECT ego, node, 0.0::DOUBLE, z FROM egos, zero) GROUP BY ego, node),
blended AS (SELECT * FROM mixed WHERE score <> 0)"""


def _zero(g) -> DataFrame:
    return g.nodes.where("node_id % 5 = 0").select(F.col("node_id").alias("node"), ((F.col("node_id") % 7 - 3) / 100.0).alias("z"))


def _blended(spark: SparkSession, sf: str):
    g, h = _ego_hits(spark, sf)
    return g, scores.blend(scores.raw(h), _zero(g), 0.2)


def scores_blended(spark: SparkSession, sf: str) -> DataFrame:
    g, b = _blended(spark, sf)
    return _named(g, b).select("src", "dst", r9("score", "score"))


def scores_filtered_paged(spark: SparkSession, sf: str) -> DataFrame:
    g, b = _blended(spark, sf)
    one = b.join(g.nodes.where(F.col("name") == EGOS[0]).select(F.col("node_id").alias("ego")), "ego")
    kept = one.where(scores.in_bounds(F.col("score"), gte=-0.5, lt=0.2))
    return _named(g, scores.paged(kept, scores.default_order(), 5, 20)).select("position", "dst", r9("score", "score"))


def scores_omit_neg(spark: SparkSession, sf: str) -> DataFrame:
    g, b = _blended(spark, sf)
    return _named(g, scores.omit_negative(b, g.links)).select("src", "dst", r9("score", "score"))


_Q = ORACLE.num_score_quantiles
_BOUNDS = f"""
positive AS (SELECT b.*, n.kind FROM blended b JOIN nodes n ON n.node_id = b.node WHERE score > 2.220446049250313e-16),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ego, kind ORDER BY score) AS rn, count(*) OVER (PARTITION BY ego, kind) AS n FROM positive),
places AS (SELECT DISTINCT ego, kind, n, i, (i * n) // {_Q} AS p FROM ranked, range(1, {_Q}) t(i)),
bounds AS (
  SELECT p.ego, p.kind, i, CASE WHEN p.n = 1 THEN hi.score - 2.220446049250313e-16 WHEN p.p = 0 THEN hi.score ELSE (lo.score + hi.score) / 2 END AS bound
  FROM places p JOIN ranked hi ON hi.ego = p.ego AND hi.kind = p.kind AND hi.rn = p.p + 1 LEFT JOIN ranked lo ON lo.ego = p.ego AND lo.kind = p.kind AND lo.rn = p.p)"""


def quantile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    g, b = _blended(spark, sf)
    q = scores.quantile_bounds(b, g.nodes, _Q).select("ego", "kind", F.posexplode("bounds").alias("i", "bound"))
    src = g.nodes.select(F.col("node_id").alias("ego"), F.col("name").alias("src"))
    return q.join(src, "ego").select("src", "kind", (F.col("i") + 1).cast("long").alias("i"), r9("bound", "bound"))


def score_clusters(spark: SparkSession, sf: str) -> DataFrame:
    g, b = _blended(spark, sf)
    c = scores.clustered(b, g.nodes, scores.quantile_bounds(b, g.nodes, _Q))
    return _named(g, c).select("src", "dst", r9("score", "score"), "cluster")


_CLUSTER = f"""
marked AS (
  SELECT b.ego, b.node, b.score, CASE WHEN b.score < 2.220446049250313e-16 THEN 0 ELSE 1 + (SELECT count(*) FROM bounds q WHERE q.ego = b.ego AND q.kind = n.kind AND q.bound < b.score) END::INTEGER AS cluster
  FROM blended b JOIN nodes n ON n.node_id = b.node)"""


def node_score(spark: SparkSession, sf: str) -> DataFrame:
    g, b = _blended(spark, sf)
    pairs = g.nodes.where(F.col("name").isin(*EGOS)).select(F.col("node_id").alias("ego")).crossJoin(g.nodes.where("node_id < 20").select(F.col("node_id").alias("node")))
    all_ = pairs.join(b, ["ego", "node"], "left").select("ego", "node", F.coalesce("score", F.lit(0.0)).alias("score"))
    c = scores.clustered(all_, g.nodes, scores.quantile_bounds(b, g.nodes, _Q), by_ego_kind=True)
    return _named(g, c).select("src", "dst", r9("score", "score"), "cluster")


def mutual_scores(spark: SparkSession, sf: str) -> DataFrame:
    g, b = _blended(spark, sf)
    me = g.node_id(EGOS[0])
    users = g.nodes.where(F.col("name").isin(*EGOS))
    n = g.nodes.select(F.col("node_id").alias("node"), F.col("name").alias("dst"))
    return scores.mutual(b, me, users).join(n, "node").select("node", "dst", r9("score", "score"), r9("reverse", "reverse"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return polls.latency(spark.read.parquet(f"{sf}/events.parquet"))


def global_user_scores(spark: SparkSession, sf: str) -> DataFrame:
    g, h = _ego_hits(spark, sf)
    names = g.nodes.select(F.col("node_id").alias("node"), F.col("name").alias("dst"))
    return polls.global_scores(scores.raw(h)).join(names, "node").select("dst", "score")


def poll_results(spark: SparkSession, sf: str) -> DataFrame:
    """Users vote for priorities of orders: an option is a priority, a poll an order status."""
    g, h = _ego_hits(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    option = F.concat("o_orderstatus", F.lit("/"), "o_orderpriority")
    votes = orders.select(F.col("o_orderkey").alias("op_idx"), F.concat(F.lit("U"), (F.col("o_custkey") % 150).cast("string")).alias("user"), option.alias("option"), F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(1.0).alias("amount"))
    options = orders.select(option.alias("option"), F.col("o_orderstatus").alias("poll")).distinct()
    s = _named(g, scores.raw(h)).select(F.col("src").alias("ego"), F.col("dst").alias("user"), "score")
    return polls.poll_results(votes, options, s, 0.05).select("ego", "poll", "option", r9("share", "share"), "votes")


_POLLS = f"""{_WALK},
s AS (SELECT a.name AS ego, b.name AS "user", score FROM raw {_NAMES}),
votes AS (SELECT o_orderkey AS op_idx, 'U' || (o_custkey % 150) AS "user", o_orderstatus || '/' || o_orderpriority AS option, o_orderstatus AS poll, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE 1.0 END AS amount FROM orders),
lastv AS (SELECT poll, "user", option, amount FROM votes QUALIFY row_number() OVER (PARTITION BY poll, "user" ORDER BY op_idx DESC) = 1),
tally AS (SELECT s.ego, poll, option, sum(round(least(score, 0.05::DOUBLE) * 1.0::DOUBLE * 1e9::DOUBLE))::BIGINT AS m, count(*) AS votes FROM lastv JOIN s USING ("user") WHERE amount > 0 AND score > 0 GROUP BY ALL),
opts AS (SELECT DISTINCT poll, option FROM votes),
grid AS (SELECT e.ego, o.poll, o.option, coalesce(m, 0) AS m, coalesce(votes, 0) AS votes FROM (SELECT DISTINCT ego FROM s) e, opts o LEFT JOIN tally t ON t.ego = e.ego AND t.poll = o.poll AND t.option = o.option)
SELECT ego, poll, option, round(CASE WHEN sum(m) OVER w > 0 THEN m::DOUBLE / (sum(m) OVER w)::DOUBLE ELSE 0.0 END, 9) AS share, votes::BIGINT AS votes FROM grid WINDOW w AS (PARTITION BY ego, poll)"""


def new_edges(spark: SparkSession, sf: str) -> DataFrame:
    g, h = _ego_hits(spark, sf)
    s = _named(g, scores.raw(h)).select(F.col("src").alias("ego"), F.col("dst").alias("name"), "score")
    seen = s.where("cast(substring(name, 2) as int) % 2 = 0").select("ego", "name")
    return polls.new_edges(s, seen, "U").select("ego", "name", r9("score", "score"))


def zero_opinion_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    edges = contexts.last_write(contexts.route(user_ops(spark, sf).withColumn("context", F.lit(""))))
    return polls.pagerank(edges.where("weight > 0").select("src", "dst"), iterations=5)


def _pagerank_sql(iterations: int) -> str:
    sql = f"""WITH {USER_OPS.replace("event_type AS context", "'' AS context")}, routed AS (SELECT * FROM ops WHERE src <> dst),{_LAST},
e AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM (SELECT DISTINCT src, dst FROM edges WHERE weight > 0)),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS k FROM nodes),
r0 AS (SELECT node, 1000000000000 // k AS rank FROM nodes, c)"""
    for i in range(iterations):
        sql += f""",
r{i + 1} AS (SELECT node, (coalesce(got, 0) * 85 // 100 + {int((1 - 0.85) * 10**12)} // k)::BIGINT AS rank FROM c, nodes LEFT JOIN
  (SELECT dst, sum(rank // n)::BIGINT AS got FROM e JOIN r{i} ON node = src GROUP BY dst) ON dst = node)"""
    return sql + f"\nSELECT node, rank FROM r{iterations}"


def all_egos(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every user for every user, 10,000 walks an ego: the batch that throughput is measured by."""
    g = _user_graph(spark, sf, Settings())
    return scores.raw(g.calculate(g.all_users()))


def exact_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The limit that walks approach, by dense solves over the nodes that they can visit."""
    g = _user_graph(spark, sf)
    return g.exact(g.node_id(EGOS[0]))


QUERIES: dict[str, Query] = {
    **reads.QUERIES,
    **{f.__name__: f for f in (
        edges_lww, edges_decay, edges_after_delete_node, router_contexts, create_context_seed, bulk_load_contexts, csv_source, array_source,
        node_registry, object_owner, nodelist, edgelist, connected, neighbors_out, neighbors_in, neighbors_all, neighbors_opinions,
        edge_normalized_path, edge_normalized_neighbors, focus_two_hop, walk_hits, walk_hits_joined, scores_raw, scores_blended,
        scores_filtered_paged, scores_omit_neg, quantile_bounds, score_clusters, node_score, mutual_scores, latency_percentiles,
        global_user_scores, poll_results, new_edges, zero_opinion_pagerank, all_egos, exact_scores)},
    **histories.QUERIES,
}

_HITS = f"{_WALK}\nSELECT pos_hits, neg_hits, a.name AS src, b.name AS dst FROM hits {_NAMES}"
_WITH_BOUNDS = f"{_WALK},{_BLEND},{_BOUNDS}"

SQL: dict[str, str] = {
    **histories.SQL,
    **reads.SQL,
    "edges_lww": f"WITH {USER_OPS},{_ROUTED},{_LAST} SELECT context, src, dst, weight FROM edges",
    "edges_decay": f"WITH {USER_OPS},{_ROUTED},{_DECAY}",
    "edges_after_delete_node": _DELETED,
    "router_contexts": f"WITH {USER_OPS},{_ROUTED} SELECT context, count(*) AS n, min(op_idx) AS first_op, count(DISTINCT src) AS sources, sum(round(amount * 100)::BIGINT)::BIGINT AS cents FROM routed GROUP BY context",
    "create_context_seed": f"WITH {USER_OPS} SELECT {_NEW_AT}::BIGINT AS op_idx, 'fresh' AS context, src, dst, arg_max(amount, op_idx) AS amount, 0::BIGINT AS magnitude FROM ops WHERE src <> dst AND op_idx < {_NEW_AT} GROUP BY src, dst HAVING abs(arg_max(amount, op_idx)) > 1e-6",
    "bulk_load_contexts": _BULK,
    "csv_source": f"WITH {USER_OPS} SELECT '' AS context, 'edge' AS kind, src, dst, amount, 0::BIGINT AS magnitude FROM ops WHERE context = 'view'",
    "array_source": f"WITH {USER_OPS} SELECT row_number() OVER (PARTITION BY magnitude ORDER BY op_idx) - 1 AS place, context, src, dst, amount, magnitude FROM ops",
    "node_registry": f"{_MIXED} SELECT node_id, name, kind, owner FROM nodes",
    "object_owner": f"{_MIXED},{_OWNERS} SELECT name, object_owner FROM owners",
    "nodelist": f"{_MIXED} SELECT node_id AS position, name AS node FROM nodes",
    "edgelist": f"{_MIXED} SELECT src, dst, weight FROM edges",
    "connected": f"{_MIXED} SELECT src, dst FROM edges WHERE src = '{FOCUS}'",
    "neighbors_out": f"{_MIXED} {_OUT}",
    "neighbors_in": f"{_MIXED} {_IN}",
    "neighbors_all": f"{_MIXED} {_OUT} UNION ALL {_IN}",
    "neighbors_opinions": f"{_MIXED},{_OWNERS} SELECT * FROM ({_IN}) WHERE node NOT IN (SELECT name FROM owners WHERE object_owner = '{FOCUS}')",
    "edge_normalized_path": f"{_MIXED},{_SUMS} SELECT e.src, dst, round(weight / CASE WHEN p < 1e-6 THEN 1.0 ELSE p END, 9) AS weight FROM edges e JOIN sums USING (src)",
    "edge_normalized_neighbors": f"{_MIXED},{_SUMS} SELECT e.src, dst, round(weight / CASE WHEN p < 1e-6 THEN 1.0 ELSE p + q END, 9) AS weight FROM edges e JOIN sums USING (src)",
    "focus_two_hop": _TWO_HOP,
    "walk_hits": _HITS,
    "walk_hits_joined": _HITS,
    "scores_raw": f"{_WALK}\nSELECT score, a.name AS src, b.name AS dst FROM raw {_NAMES}",
    "scores_blended": f"{_WALK},{_BLEND}\nSELECT a.name AS src, b.name AS dst, round(score, 9) AS score FROM blended {_NAMES}",
    "scores_filtered_paged": f"{_WALK},{_BLEND}\nSELECT position::INTEGER AS position, dst, round(score, 9) AS score FROM (SELECT b.name AS dst, score, row_number() OVER (ORDER BY abs(score) DESC, node) AS position FROM blended {_NAMES} WHERE a.name = '{EGOS[0]}' AND score >= -0.5 AND score < 0.2) WHERE position BETWEEN 6 AND 25",
    "scores_omit_neg": f"{_WALK},{_BLEND}\nSELECT a.name AS src, b.name AS dst, round(score, 9) AS score FROM blended {_NAMES} WHERE NOT EXISTS (SELECT 1 FROM links WHERE s = ego AND d = node AND neg)",
    "quantile_bounds": f"{_WITH_BOUNDS}\nSELECT a.name AS src, q.kind, i, round(bound, 9) AS bound FROM bounds q JOIN nodes a ON a.node_id = ego",
    "score_clusters": f"{_WITH_BOUNDS},{_CLUSTER}\nSELECT a.name AS src, b.name AS dst, round(score, 9) AS score, cluster FROM marked {_NAMES}",
    "node_score": f"""{_WITH_BOUNDS},
full_pairs AS (SELECT e.ego, n.node_id AS node, coalesce(b.score, 0.0) AS score FROM egos e CROSS JOIN (SELECT node_id FROM nodes WHERE node_id < 20) n LEFT JOIN blended b ON b.ego = e.ego AND b.node = n.node_id)
SELECT a.name AS src, b.name AS dst, round(f.score, 9) AS score, CASE WHEN f.score < 2.220446049250313e-16 THEN 0 ELSE 1 + (SELECT count(*) FROM bounds q WHERE q.ego = f.ego AND q.kind = 'U' AND q.bound < f.score) END::INTEGER AS cluster FROM full_pairs f {_NAMES}""",
    "mutual_scores": f"{_WALK},{_BLEND}\nSELECT x.node, b.name AS dst, round(x.score, 9) AS score, round(coalesce(y.score, 0.0), 9) AS reverse FROM blended x JOIN nodes a ON a.node_id = x.ego JOIN nodes b ON b.node_id = x.node LEFT JOIN blended y ON y.ego = x.node AND y.node = x.ego WHERE a.name = '{EGOS[0]}' AND x.score > 0 AND b.name IN {EGOS}",
    "latency_percentiles": "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT min(value) FILTER (i = (n - 1) // 2) AS median, min(value) FILTER (i = least(n * 95 // 100, n - 1)) AS p95, min(value) FILTER (i = least(n * 99 // 100, n - 1)) AS p99, min(value) AS min, max(value) AS max, count(*)::BIGINT AS count FROM s",
    "global_user_scores": f"{_WALK}\nSELECT b.name AS dst, sum(round(score * 1e9)::BIGINT)::BIGINT / 1e9::DOUBLE AS score FROM raw {_NAMES} GROUP BY b.name",
    "poll_results": _POLLS,
    "new_edges": f"{_WALK}\nSELECT a.name AS ego, b.name AS name, round(score, 9) AS score FROM raw {_NAMES} WHERE score >= 1e-6 AND substr(b.name, 2)::INTEGER % 2 = 1",
    "zero_opinion_pagerank": _pagerank_sql(5),
}
