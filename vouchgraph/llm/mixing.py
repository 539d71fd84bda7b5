"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. Tokens are summed by (source, hash bucket); the running sum
over the buckets shows in which bucket a source's budget ends; only that bucket is refined to single hash
values. A document is taken iff its hash is at most its source's threshold, so nothing is sorted, larger
budgets contain smaller ones, and the choice doesn't depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Nested budgets, as parts of all tokens.
FRACTIONS = (0.25, 0.5, 1.0)
BUCKET_BITS = 14
_ALL = (1 << 60) - 1
_WORD = "[^ \\\\t\\\\n\\\\r\\\\f\\\\v]+"


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))


def _doc_hash() -> Column:
    return common.hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, k, h, tokens) of every row: source key, id hash, whitespace-separated words."""
    words = F.expr(f"coalesce(regexp_count(text, '{_WORD}'), 0)").cast("long")
    return docs.select("doc_id", "source", _source_key().alias("k"), _doc_hash().alias("h"), words.alias("tokens"))


def _weights(hist: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(k, own, w, total): tokens and weight of each source, tokens of all."""
    if weights is None:
        w = F.lit(1.0) / F.count("*").over(Window.partitionBy())
    else:
        total = float(sum(weights.values())) or 1.0
        named = F.create_map(*[x for s, w in weights.items() for x in (F.lit("s" + s), F.lit(w / total))]) if weights else F.lit(None).cast("map<string,double>")
        w = F.coalesce(named[F.col("k")], F.lit(0.0))
    return hist.groupBy("k").agg(F.sum("n").alias("own")).select("k", "own", w.alias("w"), F.sum("own").over(Window.partitionBy()).alias("total"))


def thresholds(rows: DataFrame, weights: dict[str, float] | None = None, fractions: tuple[float, ...] = FRACTIONS, balanced: bool = False) -> DataFrame:
    """One row (k, t0, t1, ...) for each source with the largest hash that each budget admits.

    ``rows`` has k, h and tokens, and should be cheap to read twice. ``weights`` maps sources to their share
    of the mix (a source that it lacks gets none); without it all sources weigh the same. A source that is
    smaller than its budget is taken whole, so where sources are skewed the mix misses the weights; ``balanced``
    takes as all tokens what the scarcest source allows (its tokens over its weight), so that it meets them.
    Sources without a token don't limit it.
    """
    shift = 60 - BUCKET_BITS
    hist = rows.groupBy("k", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("n"))
    shares, slack = _weights(hist, weights), F.lit(1.0)
    if balanced:  # the slack is for rounding: the scarcest source itself goes whole
        scarce = F.min(F.when((F.col("w") > 0) & (F.col("own") > 0), F.col("own") / F.col("w"))).over(Window.partitionBy())
        shares, slack = shares.withColumn("total", F.coalesce(scarce, F.lit(0.0))), F.lit(1 + 1e-12)
    budgets = shares.select("k", F.posexplode(F.array(*[F.floor(F.col("w") * F.lit(f) * F.col("total") * slack).cast("long") for f in fractions])).alias("i", "budget"))
    running = hist.select("k", "b", "n", F.sum("n").over(Window.partitionBy("k").orderBy("b")).alias("cum"))
    # first bucket that a budget doesn't hold whole
    edge = running.join(budgets, "k").where("cum > budget").groupBy("k", "i", "budget").agg(F.min_by(F.struct("b", (F.col("cum") - F.col("n")).alias("base")), "b").alias("e")).select("k", "i", "budget", "e.b", "e.base")
    edge = common.stage(edge, "mix-edge")
    narrow = common.checked(edge.select("k", "b").distinct(), 64)
    inside = rows.withColumn("b", F.shiftright("h", shift)).join(narrow, ["k", "b"]).groupBy("k", "b", "h").agg(F.sum("tokens").alias("n"))
    inside = inside.select("k", "b", "h", F.sum("n").over(Window.partitionBy("k", "b").orderBy("h")).alias("cum"))
    fine = edge.join(inside, ["k", "b"]).where("base + cum <= budget").groupBy("k", "i").agg(F.max("h").alias("h"))
    floor = edge.select("k", "i", (F.shiftleft(F.col("b"), shift) - 1).alias("low")).join(fine, ["k", "i"], "left").select("k", "i", F.coalesce("h", "low").alias("t"))
    whole = budgets.select("k", "i").join(floor, ["k", "i"], "left").select("k", "i", F.coalesce("t", F.lit(_ALL)).alias("t"))
    return whole.groupBy("k").agg(*[F.max(F.when(F.col("i") == i, F.col("t"))).alias(f"t{i}") for i in range(len(fractions))])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, fractions: tuple[float, ...] = FRACTIONS, balanced: bool = False) -> DataFrame:
    """(doc_id, source, tokens, level) of the documents taken; level is the first budget that takes it.

    Budget i of a source is floor(weight * fractions[i] * all tokens), where ``balanced`` puts what ``thresholds``
    says for all tokens; ``shares`` reports what the mix is then. Rows of one hash (repeated ids) are
    taken together or not at all. A null source is a source of its own; a null id hashes like the word
    "null"; null and empty texts have no tokens and follow their hash. Empty input gives no rows; further
    columns are ignored.
    """
    rows = common.stage(measured(docs), "mix-rows")
    t = common.checked(common.stage(thresholds(rows, weights, fractions, balanced), "mix-thresholds"), 64)
    level = F.coalesce(*[F.when(F.col("h") <= F.col(f"t{i}"), F.lit(i)) for i in range(len(fractions))])
    return rows.join(t, "k").select("doc_id", "source", "tokens", level.cast("int").alias("level")).where("level is not null")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, fraction: float = 1.0, balanced: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, that the budget of ``fraction`` takes; texts are read once, never shuffled."""
    rows = common.stage(measured(docs).select("k", "h", "tokens"), "mix-rows")
    t = common.checked(common.stage(thresholds(rows, weights, (fraction,), balanced), "mix-thresholds"), 64)
    t = t.select(F.col("k").alias("__mix_k"), F.col("t0").alias("__mix_t"))
    return docs.join(t, (_source_key() == F.col("__mix_k")) & (_doc_hash() <= F.col("__mix_t")), "left_semi")


def shares(docs: DataFrame, weights: dict[str, float] | None = None, fractions: tuple[float, ...] = FRACTIONS, balanced: bool = False) -> DataFrame:
    """(source, fraction, target, own, taken, share): weight asked for, tokens there and taken, share of what is taken.

    One row for each source and fraction, also for sources that only ``weights`` names; share is null where
    nothing is taken.
    """
    spark = docs.sparkSession
    rows = common.stage(measured(docs).select("source", "k", "h", "tokens"), "mix-rows")
    t = common.checked(common.stage(thresholds(rows, weights, fractions, balanced), "mix-thresholds"), 64)
    taken = F.array(*[F.sum(F.when(F.col("h") <= F.col(f"t{i}"), F.col("tokens")).otherwise(0)) for i in range(len(fractions))])
    got = rows.join(t, "k").groupBy("k", "source").agg(F.sum("tokens").alias("own"), taken.alias("taken"))
    got = got.join(_weights(rows.select("k", F.col("tokens").alias("n")), weights).select("k", "w"), "k")
    if weights:
        total = float(sum(weights.values())) or 1.0
        named = spark.createDataFrame([("s" + s, s, w / total) for s, w in weights.items()], "k string, source string, w double")
        none = F.array(*[F.lit(0).cast("long") for _ in fractions])
        got = got.unionByName(named.join(got.select("k"), "k", "left_anti").select("k", "source", F.lit(0).cast("long").alias("own"), none.alias("taken"), "w"))
    each = got.select("source", "own", F.col("w").alias("target"), F.posexplode("taken").alias("i", "taken"))
    share = F.col("taken") / F.nullif(F.sum("taken").over(Window.partitionBy("i")), F.lit(0))
    return each.select("source", F.element_at(F.array(*[F.lit(float(f)) for f in fractions]), F.col("i") + 1).alias("fraction"), "target", "own", "taken", share.alias("share"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH r AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h,
         coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')), 0)::BIGINT AS tokens
  FROM documents),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY k ORDER BY h)::BIGINT AS cum FROM r),
n AS (SELECT (SELECT count(DISTINCT k) FROM r) AS sources, (SELECT sum(tokens) FROM r)::BIGINT AS total)
SELECT doc_id, source, tokens,
       CASE WHEN cum <= floor(1.0::DOUBLE / sources * 0.25 * total) THEN 0
            WHEN cum <= floor(1.0::DOUBLE / sources * 0.5 * total) THEN 1 ELSE 2 END::INTEGER AS level
FROM c, n WHERE cum <= floor(1.0::DOUBLE / sources * 1.0 * total)
"""
