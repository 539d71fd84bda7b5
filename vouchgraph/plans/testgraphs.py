"""Trust graphs over the star-schema tables, as operation logs; the SQL twins are beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import oplog


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edges between users: the event type is the context, errors weigh negative, the day is the magnitude."""
    e = _read(spark, sf_dir, "events")
    return oplog.log(e.select(
        F.col("event_id").alias("op_idx"), F.col("event_type").alias("context"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("U"), F.get_json_object("props", "$.k")).alias("dst"),
        F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).alias("amount"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("magnitude"),
    ))


USER_OPS = """
ops AS (
  SELECT event_id AS op_idx, event_type AS context, 'U' || user_id AS src, 'U' || (props ->> '$.k') AS dst,
         CASE WHEN event_type = 'error' THEN -value ELSE value END AS amount,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::BIGINT AS magnitude
  FROM events)"""


def mixed_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beacons (parts), opinions (suppliers), users' ratings of beacons (order lines) and of users (events), in one context."""
    beacons = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("op_idx"), F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("src"), F.concat(F.lit("U"), (F.col("p_partkey") % 150).cast("string")).alias("dst"), F.lit(1.0).alias("amount"))
    opinions = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + (1 << 40)).alias("op_idx"), F.concat(F.lit("O"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("U"), (F.col("s_suppkey") % 150).cast("string")).alias("dst"), F.lit(2.0).alias("amount"))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    rated = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long") * (1 << 44) + F.col("l_orderkey") * 8 + F.col("l_linenumber") + (1 << 41)).alias("op_idx"),
        F.concat(F.lit("U"), (F.col("o_custkey") % 150).cast("string")).alias("src"), F.concat(F.lit("B"), F.col("l_partkey").cast("string")).alias("dst"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("double").alias("amount"))
    rated = rated.groupBy("op_idx", "src", "dst").agg(F.max("amount").alias("amount"))  # line numbers repeat within an order
    users = user_ops(spark, sf_dir).select((F.col("op_idx") + (1 << 60)).alias("op_idx"), "src", "dst", "amount")
    both = beacons.unionByName(opinions).unionByName(rated).unionByName(users)
    return oplog.log(both.where("src <> dst"))


MIXED_OPS = """
ops AS (
  SELECT p_partkey AS op_idx, '' AS context, 'B' || p_partkey AS src, 'U' || (p_partkey % 150) AS dst, 1.0::DOUBLE AS amount FROM part
  UNION ALL
  SELECT s_suppkey + (1::BIGINT << 40), '', 'O' || s_suppkey, 'U' || (s_suppkey % 150), 2.0::DOUBLE FROM supplier
  UNION ALL
  SELECT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))::BIGINT * (1::BIGINT << 44) + l_orderkey * 8 + l_linenumber + (1::BIGINT << 41), '',
         'U' || (o_custkey % 150), 'B' || l_partkey, max(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::DOUBLE
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
  UNION ALL
  SELECT event_id + (1::BIGINT << 60), '', 'U' || user_id, 'U' || (props ->> '$.k'), CASE WHEN event_type = 'error' THEN -value ELSE value END
  FROM events WHERE 'U' || user_id <> 'U' || (props ->> '$.k'))"""
