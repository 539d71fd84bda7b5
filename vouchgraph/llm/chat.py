"""Chat formatting with Spark expressions only.

Turn structs are collected per conversation and sorted; adjacent turns of one role become one message; the
messages are joined. Everything is a built-in expression, linear in the number of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def format_chats(turns: DataFrame) -> DataFrame:
    r"""(conv_id, n_turns, n_messages, formatted), one row a conversation.

    A message is ``<|role|>\n`` + texts joined by ``\n`` + ``<|end|>\n``. Turns sort by (turn, role, text),
    a null turn first, so ties have one order; identical rows count once. A null role is "unknown", a null
    text is empty (the turn stays). "<|" in a role or text is written "< |": content can't forge markers.
    Rows without conv_id belong to no conversation and are dropped. Empty input gives no rows; further
    columns are ignored.
    """
    clean = lambda c, default: F.replace(F.coalesce(F.col(c), F.lit(default)), F.lit("<|"), F.lit("< |"))
    one = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), clean("role", "unknown").alias("role"), clean("text", "").alias("text"))
    grouped = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set(one)).alias("t"))
    first = lambda i: (i == 0) | (F.element_at("t", F.greatest(i, F.lit(1)))["role"] != F.element_at("t", i + 1)["role"])
    piece = F.transform("t", lambda x, i: F.when(first(i), F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit("<|end|>\n")), F.lit("<|"), x["role"], F.lit("|>\n"), x["text"])).otherwise(F.concat(F.lit("\n"), x["text"])))
    heads = F.aggregate(F.transform("t", lambda x, i: first(i).cast("int")), F.lit(0), lambda a, x: a + x)
    return grouped.select("conv_id", F.size("t").cast("long").alias("n_turns"), heads.cast("long").alias("n_messages"), F.concat(F.array_join(piece, ""), F.lit("<|end|>\n")).alias("formatted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(common.table(spark, sf_dir, "conversations"))


SQL = r"""
WITH d AS (
  SELECT DISTINCT conv_id, coalesce(turn, -9223372036854775808) AS turn,
         replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM d
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, count(*) FILTER (i = 1 OR role <> before)::BIGINT AS n_messages,
       string_agg(CASE WHEN i = 1 THEN '<|' || role || '|>' || chr(10) || text
                       WHEN role <> before THEN '<|end|>' || chr(10) || '<|' || role || '|>' || chr(10) || text
                       ELSE chr(10) || text END, '' ORDER BY i) || '<|end|>' || chr(10) AS formatted
FROM p GROUP BY conv_id
"""
