"""Logs with bulk loads, resets, seeding and deletions, through the engine, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import Settings
from .engine import TrustEngine
from .testgraphs import MIXED_OPS, USER_OPS, mixed_ops, user_ops

#: Operation at which users start to write in the mixed log.
_WRITES = 1 << 60


def _edges(ops: DataFrame) -> DataFrame:
    return TrustEngine(ops, with_decay=False).all_edges().select("context", "src", "dst", "weight")


def _kind(*cases: tuple[Column, str]) -> Column:
    kind = F.lit("edge")
    for when, name in reversed(cases):
        kind = F.when(when, name).otherwise(kind)
    return kind


def bulk_then_writes(spark: SparkSession, sf: str) -> DataFrame:
    """A bulk load of objects and users in three contexts, then writes that overwrite, delete and open contexts."""
    i = F.col("op_idx")
    ops = mixed_ops(spark, sf)
    bulk = ops.where(i < _WRITES).withColumn("context", F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("c"), (i % 3).cast("string")))).withColumn("kind", F.lit("bulk_load"))
    events = user_ops(spark, sf)
    beacon = F.concat(F.lit("B"), (i % 200).cast("string"))
    later = events.withColumn("dst", F.when(i % 4 == 0, beacon).otherwise(F.col("dst"))).withColumn("context", F.when(i % 5 == 0, F.col("context")).when(i % 3 == 0, "").otherwise(F.concat(F.lit("c"), (i % 3).cast("string"))))
    later = later.withColumn("kind", _kind((i % 97 == 5, "delete_node"), (i % 16 == 4, "delete_edge"))).withColumn("node", F.when(F.col("kind") == "delete_node", F.col("src")))
    return _edges(bulk.unionByName(later.withColumn("op_idx", i + _WRITES)))


_BULK_THEN = f"""WITH {MIXED_OPS.replace("ops AS", "raw AS")},
names AS (SELECT '' AS context UNION SELECT 'c1' UNION SELECT 'c2'),
loaded AS (SELECT op_idx, CASE WHEN op_idx % 3 = 0 THEN '' ELSE 'c' || (op_idx % 3) END AS context, src, dst, amount FROM raw WHERE op_idx < {_WRITES}),
{USER_OPS.replace("ops AS", "events_ops AS")},
later AS (
  SELECT op_idx + {_WRITES} AS op_idx, CASE WHEN op_idx % 5 = 0 THEN context WHEN op_idx % 3 = 0 THEN '' ELSE 'c' || (op_idx % 3) END AS context, src,
         CASE WHEN op_idx % 4 = 0 THEN 'B' || (op_idx % 200) ELSE dst END AS dst, amount,
         CASE WHEN op_idx % 97 = 5 THEN 'delete_node' WHEN op_idx % 16 = 4 THEN 'delete_edge' ELSE 'edge' END AS kind FROM events_ops),
born AS (SELECT context, min(op_idx) AS born FROM (SELECT context, op_idx FROM later WHERE src <> dst OR kind = 'delete_node' UNION ALL SELECT context, -1 FROM names) GROUP BY context),
valid AS (SELECT op_idx, context, src, dst, CASE WHEN kind = 'delete_edge' THEN 0.0::DOUBLE ELSE amount END AS amount FROM later WHERE kind <> 'delete_node' AND src <> dst),
routed AS (
  SELECT op_idx - (1::BIGINT << 61) AS op_idx, n.context, src, dst, amount FROM loaded, names n WHERE src[1] = 'U' AND dst[1] = 'U'
  UNION ALL SELECT op_idx, context, src, dst, amount FROM loaded WHERE NOT (src[1] = 'U' AND dst[1] = 'U')
  UNION ALL SELECT op_idx, '', src, dst, amount FROM loaded WHERE NOT (src[1] = 'U' AND dst[1] = 'U') AND context <> ''
  UNION ALL SELECT op_idx, b.context, src, dst, amount FROM valid JOIN born b ON b.born <= op_idx WHERE dst[1] = 'U'
  UNION ALL SELECT op_idx, context, src, dst, amount FROM valid WHERE dst[1] = 'B'
  UNION ALL SELECT op_idx, '', src, dst, amount FROM valid WHERE dst[1] = 'B' AND context <> ''),
last AS (SELECT context, src, dst, arg_max(amount, op_idx) AS weight, max(op_idx) AS op_idx FROM routed GROUP BY ALL),
gone AS (SELECT context, src, max(op_idx) AS del FROM (SELECT context, src, op_idx FROM later WHERE kind = 'delete_node' UNION ALL SELECT '', src, op_idx FROM later WHERE kind = 'delete_node') GROUP BY ALL)
SELECT l.context, l.src, l.dst, l.weight FROM last l LEFT JOIN gone g ON g.context = l.context AND g.src = l.src WHERE abs(weight) > 1e-6 AND (del IS NULL OR l.op_idx > del)"""


def bulk_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Two bulk loads in a row and writes after them: the second load replaces the first."""
    i = F.col("op_idx")
    ops = user_ops(spark, sf).withColumn("kind", _kind((i < 600, "bulk_load")))
    return _edges(ops.withColumn("node", F.when(i < 300, "first").when(i < 600, "second")))


def reset_in_log(spark: SparkSession, sf: str) -> DataFrame:
    """A reset after a bulk load and writes: only what follows counts, and contexts are born anew."""
    i = F.col("op_idx")
    return _edges(user_ops(spark, sf).withColumn("kind", _kind((i < 200, "bulk_load"), (i == 400, "reset"))))


def delete_edge_after_bulk(spark: SparkSession, sf: str) -> DataFrame:
    """A bulk load, then deletions of half of its edges, each in its own context."""
    i = F.col("op_idx")
    loaded = user_ops(spark, sf).where("op_idx < 500").withColumn("kind", F.lit("bulk_load"))
    return _edges(loaded.unionByName(loaded.where("op_idx % 2 = 0").withColumn("op_idx", i + 500).withColumn("kind", F.lit("delete_edge"))))


_LATE = "last AS (SELECT context, src, dst, arg_max(amount, op_idx) AS weight FROM routed GROUP BY ALL) SELECT context, src, dst, weight FROM last WHERE abs(weight) > 1e-6"

_SEED_AT = 600
_SEEDING = Settings(vsids_bump=1.3, deletion_ratio=0.05)


def seed_decayed(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of a context that is created when the others have decayed and lost nodes, after more writes."""
    i = F.col("op_idx")
    ops = user_ops(spark, sf).withColumn("kind", _kind((i == _SEED_AT, "create_context"), (i % 97 == 5, "delete_node"))).withColumn("node", F.when(F.col("kind") == "delete_node", F.col("src")))
    ops = ops.withColumn("context", F.when(i == _SEED_AT, "fresh").when(F.col("kind") == "delete_node", "").otherwise(F.col("context")))
    found = TrustEngine(ops, _SEEDING).graph_of("fresh").edges
    return found.select("src", "dst", F.round("weight", 4).alias("weight"))


def _decayed(rows: str, name: str) -> str:
    """CTE ``name`` of the edges that decay leaves of CTE ``rows`` (op_idx, src, dst, amount, magnitude)."""
    return f"""{name}_s AS (SELECT *, amount * pow(1.3::DOUBLE, magnitude) AS s FROM {rows}),
{name}_m AS (SELECT *, max(abs(s)) OVER (PARTITION BY src) AS most, max(op_idx) OVER (PARTITION BY src) AS final, row_number() OVER (PARTITION BY src, dst ORDER BY op_idx DESC) AS rn FROM {name}_s),
{name} AS (SELECT op_idx, src, dst, s AS weight FROM {name}_m WHERE rn = 1 AND abs(s) > 1e-6 AND (op_idx = final OR abs(s) > most * 0.05))"""


_SEED = f"""WITH {USER_OPS},
valid AS (SELECT op_idx, src, dst, amount, magnitude FROM ops WHERE src <> dst AND op_idx <> {_SEED_AT} AND op_idx % 97 <> 5),
gone AS (SELECT src, op_idx AS at FROM ops WHERE op_idx % 97 = 5),
early AS (SELECT * FROM valid WHERE op_idx < {_SEED_AT}),
{_decayed("early", "held")},
left_over AS (SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = h.src AND g.at > h.op_idx AND g.at < {_SEED_AT})),
copied AS (SELECT row_number() OVER (ORDER BY src, weight < 0, dst) - 1000000 AS op_idx, src, dst, weight AS amount, 0::BIGINT AS magnitude FROM left_over),
fresh AS (SELECT * FROM copied UNION ALL SELECT * FROM valid WHERE op_idx > {_SEED_AT}),
{_decayed("fresh", "final_edges")}
SELECT f.src, f.dst, round(weight, 4) AS weight FROM final_edges f"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (bulk_then_writes, bulk_twice, reset_in_log, delete_edge_after_bulk, seed_decayed)}

SQL: dict[str, str] = {
    "bulk_then_writes": _BULK_THEN,
    "bulk_twice": f"""WITH {USER_OPS},
names AS (SELECT DISTINCT context FROM ops WHERE op_idx BETWEEN 300 AND 599 UNION SELECT ''),
born AS (SELECT context, min(op_idx) AS born FROM (SELECT context, op_idx FROM ops WHERE src <> dst AND op_idx >= 600 UNION ALL SELECT context, -1 FROM names) GROUP BY context),
routed AS (SELECT op_idx, b.context, src, dst, amount FROM ops JOIN born b ON b.born <= op_idx WHERE src <> dst AND op_idx >= 300), {_LATE}""",
    "reset_in_log": f"""WITH {USER_OPS},
born AS (SELECT context, min(op_idx) AS born FROM ops WHERE src <> dst AND op_idx > 400 GROUP BY context UNION ALL SELECT '', -1),
routed AS (SELECT op_idx, b.context, src, dst, amount FROM ops JOIN born b ON b.born <= op_idx WHERE src <> dst AND op_idx > 400), {_LATE}""",
    "delete_edge_after_bulk": f"""WITH {USER_OPS},
early AS (SELECT * FROM ops WHERE op_idx < 500 AND src <> dst),
names AS (SELECT DISTINCT context FROM ops WHERE op_idx < 500 UNION SELECT ''),
routed AS (SELECT op_idx, n.context, src, dst, amount FROM early, names n UNION ALL SELECT op_idx + 500, n.context, src, dst, 0.0 FROM early, names n WHERE op_idx % 2 = 0), {_LATE}""",
    "seed_decayed": _SEED,
}

__all__ = ["QUERIES", "SQL"]
