"""Whole read requests through the engine, with DuckDB SQL that walks, blends, clusters and pages by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import contexts, paths
from ..settings import Settings
from .engine import TrustEngine
from .staging import stage
from .testgraphs import MIXED_OPS, USER_OPS, mixed_ops, user_ops

EGO, FOCUS, FAR = "U1", "U3", "U99"
PAGE = Settings(num_walks=2000, num_score_quantiles=10)
FEW = Settings(num_walks=100, seed=7, num_score_quantiles=10)
_TINY = 2.220446049250313e-16


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9).alias(c) for c, kind in df.dtypes if kind == "double"})


def _users(spark: SparkSession, sf: str, settings: Settings) -> TrustEngine:
    return TrustEngine(user_ops(spark, sf).withColumn("context", F.lit("")), settings, with_decay=False)


def _mixed(spark: SparkSession, sf: str) -> TrustEngine:
    return TrustEngine(mixed_ops(spark, sf), FEW, with_decay=False)


_LAST = """
last AS (SELECT src, dst, arg_max(amount, op_idx) AS weight, max(op_idx) AS op_idx FROM routed GROUP BY src, dst),
edges AS (SELECT * FROM last WHERE abs(weight) > 1e-6)"""
_NODES = """
seen AS (
  SELECT op_idx * 2 AS pos, CASE WHEN src[1] <> 'U' THEN dst ELSE src END AS name, NULL::VARCHAR AS owner FROM routed
  UNION ALL
  SELECT op_idx * 2 + 1, CASE WHEN src[1] <> 'U' THEN src ELSE dst END, CASE WHEN src[1] <> 'U' THEN dst END FROM routed),
nodes AS (
  SELECT (row_number() OVER (ORDER BY pos) - 1)::BIGINT AS node_id, name, name[1] AS kind, owner
  FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM seen) WHERE k = 1),
owners AS (
  SELECT n.node_id AS node, coalesce(owner, CASE WHEN kind = 'O' THEN first_in END, n.name) AS owner_name
  FROM nodes n LEFT JOIN (SELECT dst, arg_min(src, op_idx) AS first_in FROM edges GROUP BY dst) e ON e.dst = n.name)"""
_USER_GRAPH = f"{USER_OPS}, routed AS (SELECT * FROM ops WHERE src <> dst),{_LAST},{_NODES}"
_MIXED_GRAPH = f"{MIXED_OPS}, routed AS (SELECT * FROM ops WHERE src <> dst),{_LAST},{_NODES}"
#: Edges of the aggregate context, decayed with the default settings.
_DECAYED_GRAPH = f"""{USER_OPS},
routed AS (SELECT * FROM ops WHERE src <> dst),
scaled AS (SELECT *, amount * pow(1.03::DOUBLE, magnitude) AS s FROM routed),
decaying AS (SELECT *, max(abs(s)) OVER (PARTITION BY src) AS most, max(op_idx) OVER (PARTITION BY src) AS final,
                  row_number() OVER (PARTITION BY src, dst ORDER BY op_idx DESC) AS rn FROM scaled),
edges AS (SELECT src, dst, s AS weight, op_idx FROM decaying WHERE rn = 1 AND abs(s) > 1e-6 AND (op_idx = final OR abs(s) > most * 0.001)),{_NODES}"""


def _walks(graph: str, settings: Settings, egos: str = "SELECT node_id AS ego FROM nodes WHERE kind = 'U'") -> str:
    """SQL up to ``raw`` (ego, node, score), ``blended``, ``bounds`` and ``marked`` (ego, node, score, by node's kind, by user's) of ``egos``."""
    p31 = 1 << 31
    q = settings.num_score_quantiles
    return f"""WITH RECURSIVE {graph},
links AS (SELECT a.node_id AS s, b.node_id AS d, round(abs(weight) * 1e6)::BIGINT AS w, weight < 0 AS neg
          FROM edges e JOIN nodes a ON a.name = e.src JOIN nodes b ON b.name = e.dst),
phased AS (SELECT *, 0 AS ph FROM links UNION ALL SELECT *, 1 FROM links WHERE NOT neg),
ranges AS (SELECT *, sum(w) OVER (PARTITION BY s, ph ORDER BY d)::BIGINT AS hi, sum(w) OVER (PARTITION BY s, ph)::BIGINT AS total FROM phased),
egos AS ({egos}),
start0 AS (SELECT ego, wid::BIGINT AS wid, {rng.mix_sql(str(settings.seed), "ego")} AS h1 FROM egos, range(0, {settings.num_walks}) t(wid)),
start AS (SELECT ego, wid, {rng.mix_sql("h1", "wid")} AS h FROM start0),
walk(ego, wid, h, step, node, ph) AS (
  SELECT ego, wid, h, 0::BIGINT, ego, 0 FROM start
  UNION ALL
  SELECT t.ego, t.wid, t.h, t.step + 1, r.d, CASE WHEN t.ph = 1 OR r.neg THEN 1 ELSE 0 END
  FROM (SELECT *, {rng.mix_sql("h", "4 * step")} AS a, {rng.mix_sql("h", "4 * step + 1")} * {p31} + {rng.mix_sql("h", "4 * step + 2")} AS b FROM walk) t
  JOIN ranges r ON r.s = t.node AND r.ph = t.ph AND t.b % r.total >= r.hi - r.w AND t.b % r.total < r.hi
  WHERE t.a < {rng.go_on_below(settings.alpha)}),
hits AS (SELECT ego, node, count(*) FILTER (ph = 0)::BIGINT AS p, count(*) FILTER (ph = 1)::BIGINT AS n FROM (SELECT DISTINCT ego, wid, node, ph FROM walk) GROUP BY ego, node),
raw AS (SELECT ego, node, (p - n)::DOUBLE / sum(p + n) OVER (PARTITION BY ego)::DOUBLE AS score FROM hits),
blended AS (SELECT ego, node, score * (1 - 0.2::DOUBLE) + 0.2::DOUBLE * 0.0 AS score FROM raw WHERE score <> 0),
positive AS (SELECT b.*, n.kind FROM blended b JOIN nodes n ON n.node_id = b.node WHERE score > {_TINY}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ego, kind ORDER BY score) AS rn, count(*) OVER (PARTITION BY ego, kind) AS n FROM positive),
places AS (SELECT DISTINCT ego, kind, n, i, (i * n) // {q} AS p FROM ranked, range(1, {q}) t(i)),
bounds AS (
  SELECT p.ego, p.kind, list(CASE WHEN p.n = 1 THEN hi.score - {_TINY} WHEN p.p = 0 THEN hi.score ELSE (lo.score + hi.score) / 2 END) AS b
  FROM places p JOIN ranked hi ON hi.ego = p.ego AND hi.kind = p.kind AND hi.rn = p.p + 1 LEFT JOIN ranked lo ON lo.ego = p.ego AND lo.kind = p.kind AND lo.rn = p.p GROUP BY ALL),
marked AS (
  SELECT s.ego, s.node, s.score, CASE WHEN s.score < {_TINY} THEN 0 ELSE 1 + len(list_filter(coalesce(own.b, []), lambda x: x < s.score)) END::INTEGER AS c,
         CASE WHEN s.score < {_TINY} THEN 0 ELSE 1 + len(list_filter(coalesce(usr.b, []), lambda x: x < s.score)) END::INTEGER AS cu
  FROM blended s JOIN nodes k ON k.node_id = s.node LEFT JOIN bounds own ON own.ego = s.ego AND own.kind = k.kind LEFT JOIN bounds usr ON usr.ego = s.ego AND usr.kind = 'U'),
me AS (SELECT node_id AS id FROM nodes WHERE name = '{EGO}'),
mine AS (SELECT m.* FROM marked m, me WHERE m.ego = me.id),
back AS (SELECT n.name AS owner_name, m.score AS rs, m.cu AS rc FROM marked m JOIN me ON m.node = me.id JOIN nodes n ON n.node_id = m.ego)"""


def _page(rows: str, order: str, index: int, count: int) -> str:
    """Public columns of a page of ``rows`` (node, value, cluster, ...) by ``order``."""
    return f""",
paged AS (SELECT *, row_number() OVER (ORDER BY {order})::INTEGER AS position FROM ({rows}))
SELECT '{EGO}' AS src, n.name AS dst, round(value, 9) AS score_value_of_dst, round(coalesce(rs, 0.0), 9) AS score_value_of_src, cluster AS score_cluster_of_dst, coalesce(rc, 0)::INTEGER AS score_cluster_of_src, position
FROM paged p JOIN nodes n ON n.node_id = p.node JOIN owners o ON o.node = p.node LEFT JOIN back USING (owner_name) WHERE position > {index} AND position <= {index + count}"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: an ego's page of scores over decayed edges of all contexts, with clusters and reverse scores."""
    return _rounded(TrustEngine(user_ops(spark, sf), PAGE).scores(EGO, count=30))


def scores_of_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Beacons alone, those that the ego owns left out, within bounds, a later page."""
    return _rounded(_mixed(spark, sf).scores(EGO, kind="B", hide_personal=True, gte=-0.5, lt=0.2, index=3, count=12))


def scores_hide_personal(spark: SparkSession, sf: str) -> DataFrame:
    """All kinds without what the ego owns."""
    return _rounded(_mixed(spark, sf).scores(EGO, hide_personal=True, count=40))


def neighbors_page(spark: SparkSession, sf: str) -> DataFrame:
    """The focus's edges both ways, what the ego owns first, with clusters by the ego's scores and reverse scores."""
    return _rounded(_mixed(spark, sf).neighbors(EGO, EGO, count=60))


def mutual_scores_all(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual scores of the ego with every user that it scores above 0."""
    return _rounded(_users(spark, sf, FEW).mutual_scores(EGO))


def node_score_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a user and of a beacon by the ego, one request each."""
    e = _mixed(spark, sf)
    return _rounded(e.node_score(EGO, FOCUS).unionByName(e.node_score(EGO, "B7")))


def all_egos_few(spark: SparkSession, sf: str) -> DataFrame:
    """Raw scores of every user for every node, by 100 walks an ego."""
    from ..operators import scores as ops

    g = _users(spark, sf, FEW).graph_of()
    return _rounded(ops.raw(g.calculate(g.all_users())))


def _user_edges(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.last_write(contexts.route_to(user_ops(spark, sf).withColumn("context", F.lit("")), ""))


def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    """Cheapest paths from the ego to two users."""
    edges = stage(_user_edges(spark, sf), "edges")
    rows = [(goal, i, n) for goal in (FOCUS, FAR) for i, n in enumerate(paths.cheapest_path(edges, EGO, goal) or [])]
    return spark.createDataFrame(rows, "goal string, position int, node string")


def graph_view(spark: SparkSession, sf: str) -> DataFrame:
    """Path to the focus and its neighbourhood over objects, with scores and reverse scores."""
    return _rounded(_mixed(spark, sf).graph(EGO, FOCUS, count=40))


_ROUNDS = 8
_COSTS = """
sums AS (SELECT src, sum(CASE WHEN weight > 0 THEN round(abs(weight) * 1e6) ELSE 0 END)::BIGINT / 1e6::DOUBLE AS pos,
                sum(CASE WHEN weight < 0 THEN round(abs(weight) * 1e6) ELSE 0 END)::BIGINT / 1e6::DOUBLE AS neg FROM edges GROUP BY src),
costs AS (SELECT src, dst, CASE WHEN weight / pos < 1e-6 THEN 1e6 ELSE pos / weight END AS cost FROM edges JOIN sums USING (src) WHERE weight > 0)"""


def _path(goal: str, name: str) -> str:
    """CTE ``name`` (path): relaxation of all costs in _ROUNDS rounds, then one edge from the goal's cheapest source."""
    sql = f"{name}0 AS (SELECT '{EGO}' AS node, {{'cost': 0.0::DOUBLE, 'before': -1.0::DOUBLE, 'via': '', 'path': ['{EGO}']}} AS best)"
    for i in range(_ROUNDS):
        sql += f""",
{name}{i + 1} AS (SELECT node, min(best) AS best FROM (
  SELECT * FROM {name}{i} UNION ALL
  SELECT c.dst, {{'cost': r.best.cost + c.cost, 'before': r.best.cost, 'via': c.src, 'path': list_append(r.best.path, c.dst)}} FROM {name}{i} r JOIN costs c ON c.src = r.node WHERE c.dst <> '{goal}' AND c.dst <> '{EGO}') GROUP BY node)"""
    return sql + f""",
{name} AS (SELECT list_append(arg_min(best.path, {{'cost': best.cost, 'node': node}}), '{goal}') AS path FROM {name}{_ROUNDS} JOIN costs ON src = node AND dst = '{goal}')"""


#: A path of users and objects is shown between users: an object in between gives way to the product of its edges.
_VIEW = f"""{_walks(_MIXED_GRAPH, FEW)},{_COSTS},
{_path(FOCUS, "way")},
hops AS (SELECT unnest(range(1, len(path))) AS i, path FROM way),
steps AS (SELECT i, path[i] AS a, path[i + 1] AS b, path[i + 2] AS c FROM hops),
pn AS (SELECT e.src, e.dst, weight / CASE WHEN pos < 1e-6 THEN 1.0 ELSE pos END AS w FROM edges e JOIN sums USING (src)),
first_rows AS (
  SELECT i, a AS src, b AS dst, w FROM steps JOIN pn ON pn.src = a AND pn.dst = b WHERE a[1] = 'U' AND (b[1] = 'U' OR c IS NULL)
  UNION ALL
  SELECT i, a, c, x.w * y.w FROM steps JOIN pn x ON x.src = a AND x.dst = b JOIN pn y ON y.src = b AND y.dst = c WHERE a[1] = 'U' AND b[1] <> 'U' AND c IS NOT NULL AND abs(x.w * y.w) >= 1e-6),
shown_first AS (SELECT src, dst, w AS weight, row_number() OVER (ORDER BY i) AS position FROM first_rows WHERE src <> dst),
norm AS (SELECT e.src, e.dst, weight / CASE WHEN pos < 1e-6 THEN 1.0 ELSE pos + neg END AS w FROM edges e JOIN sums USING (src)),
f AS (SELECT dst AS via, w AS w1 FROM norm WHERE src = '{FOCUS}'),
ways AS (
  SELECT via AS dst, w1 AS weight, w1, via, 0 AS s2 FROM f WHERE via[1] = 'U'
  UNION ALL
  SELECT n.dst, CASE WHEN w1 < 0 AND n.w < 0 THEN -w1 * n.w ELSE w1 * n.w END, w1, via, CASE WHEN n.w > 1e-6 THEN 1 WHEN n.w < -1e-6 THEN -1 ELSE 0 END
  FROM f JOIN norm n ON n.src = f.via WHERE via[1] IN ('B', 'C', 'O') AND n.dst <> '{FOCUS}' AND n.dst[1] = 'U'),
rest AS (SELECT '{FOCUS}' AS src, dst, weight FROM ways WHERE abs(weight) >= 1e-6 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY w1 ASC, via DESC, s2 ASC) = 1),
shown AS (
  SELECT * FROM shown_first UNION ALL
  SELECT src, dst, weight, row_number() OVER (ORDER BY abs(weight) DESC, dst) + (SELECT count(*) FROM shown_first) FROM rest r WHERE NOT EXISTS (SELECT 1 FROM shown_first s WHERE s.src = r.src AND s.dst = r.dst))
SELECT s.src, s.dst, round(s.weight, 9) AS weight, round(coalesce(m.score, 0.0), 9) AS score_value_of_dst, round(coalesce(rs, 0.0), 9) AS score_value_of_ego,
       coalesce(m.cu, 0)::INTEGER AS score_cluster_of_dst, coalesce(rc, 0)::INTEGER AS score_cluster_of_ego, s.position::INTEGER AS position
FROM shown s JOIN nodes n ON n.name = s.dst LEFT JOIN mine m ON m.node = n.node_id JOIN owners o ON o.node = n.node_id LEFT JOIN back USING (owner_name) WHERE s.position <= 40"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (scores, scores_of_kind, scores_hide_personal, neighbors_page, mutual_scores_all, node_score_pair, all_egos_few, shortest_path, graph_view)}

_OTHERS = f"owner IS DISTINCT FROM '{EGO}'"
SQL: dict[str, str] = {
    "scores": _walks(_DECAYED_GRAPH, PAGE) + _page("SELECT node, score AS value, c AS cluster FROM mine", "abs(value) DESC, node", 0, 30),
    "scores_of_kind": _walks(_MIXED_GRAPH, FEW) + _page(f"SELECT node, score AS value, c AS cluster FROM mine JOIN nodes ON node_id = node WHERE kind = 'B' AND {_OTHERS} AND score >= -0.5 AND score < 0.2", "abs(value) DESC, node", 3, 12),
    "scores_hide_personal": _walks(_MIXED_GRAPH, FEW) + _page(f"SELECT node, score AS value, c AS cluster FROM mine JOIN nodes ON node_id = node WHERE {_OTHERS}", "abs(value) DESC, node", 0, 40),
    "neighbors_page": _walks(_MIXED_GRAPH, FEW) + _page(f"""SELECT n.node_id AS node, weight AS value, coalesce(c, 0) AS cluster, coalesce(owner = '{EGO}', false) AS own, inbound FROM (
  SELECT dst AS name, weight, false AS inbound FROM edges WHERE src = '{EGO}' UNION ALL SELECT src, weight, true FROM edges WHERE dst = '{EGO}') JOIN nodes n USING (name) LEFT JOIN mine m ON m.node = n.node_id""", "own DESC, abs(value) DESC, node, inbound", 0, 60),
    "mutual_scores_all": f"""{_walks(_USER_GRAPH, FEW)}
SELECT '{EGO}' AS src, n.name AS dst, round(m.score, 9) AS score_value_of_dst, round(coalesce(rs, 0.0), 9) AS score_value_of_src, c AS score_cluster_of_dst, coalesce(rc, 0)::INTEGER AS score_cluster_of_src, m.node AS position
FROM mine m JOIN nodes n ON n.node_id = m.node LEFT JOIN back ON owner_name = n.name WHERE m.score > 0""",
    "node_score_pair": f"""{_walks(_MIXED_GRAPH, FEW)}
SELECT '{EGO}' AS src, n.name AS dst, round(coalesce(m.score, 0.0), 9) AS score_value_of_dst, round(coalesce(rs, 0.0), 9) AS score_value_of_src, coalesce(m.cu, 0) AS score_cluster_of_dst, coalesce(rc, 0)::INTEGER AS score_cluster_of_src, 1 AS position
FROM nodes n LEFT JOIN mine m ON m.node = n.node_id JOIN owners o ON o.node = n.node_id LEFT JOIN back USING (owner_name) WHERE n.name IN ('{FOCUS}', 'B7')""",
    "all_egos_few": f"{_walks(_USER_GRAPH, FEW)} SELECT ego, node, round(score, 9) AS score FROM raw",
    "shortest_path": f"WITH {_USER_GRAPH},{_COSTS},\n{_path(FOCUS, 'near')},\n{_path(FAR, 'far')}\nSELECT goal, (generate_subscripts(path, 1) - 1)::INTEGER AS position, unnest(path) AS node FROM (SELECT '{FOCUS}' AS goal, path FROM near UNION ALL SELECT '{FAR}', path FROM far)",
    "graph_view": _VIEW,
}
