"""Polls, zero opinions by PageRank, unseen edges, consensus and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import checked, stage
from ..settings import EPSILON


def poll_results(votes: DataFrame, options: DataFrame, scores: DataFrame, cap: float | None = None) -> DataFrame:
    """(ego, poll, option, share, votes): the ego's scores of the voters, added per option over the poll's total.

    ``votes`` (op_idx, user, option, amount): the last vote of a user in a poll counts, an amount of 0 takes it
    back. ``options`` (option, poll). ``scores`` (ego, user, score); only positive ones vote, up to ``cap``.
    Options without votes are there with 0.
    """
    last = votes.join(checked(options, 48), "option").groupBy("poll", "user").agg(F.max_by(F.struct("option", "amount"), "op_idx").alias("v")).select("poll", "user", F.col("v.option").alias("option"), F.col("v.amount").alias("amount")).where(F.abs("amount") > EPSILON)
    s = F.col("score") if cap is None else F.least("score", F.lit(cap))
    micro = F.round(s * F.col("amount") * 1e9).cast("long")
    some = last.join(scores.where("score > 0"), "user").groupBy("ego", "poll", "option").agg(F.sum(micro).alias("m"), F.count("*").alias("votes"))
    grid = scores.select("ego").distinct().crossJoin(checked(options, 48)).join(some, ["ego", "poll", "option"], "left").select("ego", "poll", "option", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("votes", F.lit(0)).alias("votes"))
    total = F.sum("m").over(Window.partitionBy("ego", "poll"))
    return grid.select("ego", "poll", "option", F.when(total > 0, F.col("m") / total).otherwise(0.0).alias("share"), "votes")


def global_scores(scores: DataFrame) -> DataFrame:
    """(node, score): the sum of all egos' raw scores, added in billionths."""
    return scores.groupBy("node").agg((F.sum(F.round(F.col("score") * 1e9).cast("long")) / 1e9).alias("score"))


def pagerank(links: DataFrame, damping: float = 0.85, iterations: int = 10, top: int | None = None) -> DataFrame:
    """(node, rank) over the distinct links (src, dst), ranks in millionths of a millionth; each round is a written table.

    Nodes without links give nothing away. ``top`` keeps the highest ranks, ties by node.
    """
    unit = 10**12
    e = links.select("src", "dst").distinct()
    e = stage(e.join(e.groupBy("src").agg(F.count("*").alias("n")), "src"), "pagerank-links")
    nodes = stage(e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct(), "pagerank-nodes")
    count = nodes.count()
    if not count:
        return nodes.withColumn("rank", F.lit(0).cast("long"))
    base = int((1 - damping) * unit) // count
    rank = nodes.withColumn("rank", F.lit(unit // count).cast("long"))
    for _ in range(iterations):
        given = e.join(rank, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.floor(F.col("rank") / F.col("n")).cast("long")).alias("got"))
        rank = stage(nodes.join(given, F.col("node") == F.col("to"), "left").select("node", (F.floor(F.coalesce("got", F.lit(0)) * int(damping * 100) / 100).cast("long") + base).alias("rank")), "pagerank")
    return rank.orderBy(F.col("rank").desc(), "node").limit(top) if top else rank


def reduced_links(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) from users to users and beacons they score above EPSILON."""
    kinds = nodes.select(F.col("node_id").alias("node"), "kind").where("kind in ('U', 'B')")
    return scores.where(F.col("score") > EPSILON).join(checked(kinds, 24), "node", "left_semi").where("ego <> node").select(F.col("ego").alias("src"), F.col("node").alias("dst"))


def zero_opinions(scores: DataFrame, nodes: DataFrame, top: int = 100) -> DataFrame:
    """(node, score): PageRank, as a part of 1, of the top nodes over the links of :func:`reduced_links`, unweighted; ties by node."""
    return pagerank(reduced_links(scores, nodes), top=top).select("node", (F.col("rank") / 1e12).alias("score"))


def poll_view(votes: DataFrame, options: DataFrame, scores: DataFrame, totals: DataFrame, bounds: DataFrame, overall: float) -> DataFrame:
    """(ego, poll, option, share, global_share, circle, votes): a poll as its readers see it.

    share: of the ego's scores of other users, capped at the ego's last quantile bound (``bounds``: ego, bounds);
    global_share: the same of ``totals`` (user, score), capped at ``overall``; circle: per cent of the ego's circle, the
    ego included, that has voted; votes: of the circle for the option. ``votes`` and ``options`` as for
    :func:`poll_results`; options without votes are there with 0.
    """
    circle = scores.where("score > 0 and ego <> user")
    capped = circle.join(checked(bounds.select("ego", F.element_at("bounds", -1).alias("cap")), 64), "ego", "left").select("ego", "user", F.least("score", F.coalesce("cap", "score")).alias("score"))
    egos = checked(stage(scores.select("ego").distinct(), "egos"), 32)
    # an ego without a circle sees the options all the same
    own = poll_results(votes, options, capped.unionByName(egos.select("ego", F.lit("").alias("user"), F.lit(0.0).alias("score")))).select("ego", "poll", "option", "share")
    everyone = poll_results(votes, options, totals.select(F.lit("all").alias("ego"), "user", "score"), overall).select("poll", "option", F.col("share").alias("global_share"))
    with_ego = circle.select("ego", "user", F.lit(1.0).alias("score")).unionByName(egos.select("ego", F.col("ego").alias("user"), F.lit(1.0).alias("score")))
    counted = poll_results(votes, options, with_ego).select("ego", "poll", "option", "votes")
    size = with_ego.groupBy("ego").agg(F.count("*").alias("size"))
    voted = F.sum("votes").over(Window.partitionBy("ego", "poll"))
    return own.join(everyone, ["poll", "option"], "left").join(counted, ["ego", "poll", "option"]).join(checked(size, 32), "ego").select("ego", "poll", "option", "share", F.coalesce("global_share", F.lit(0.0)).alias("global_share"), F.round(100 * voted / F.col("size")).cast("int").alias("circle"), F.col("votes").cast("int").alias("votes"))


def rebuilt(seen: DataFrame, others: DataFrame, words: int = 1024, most: int = 1 << 20) -> DataFrame:
    """(ego, filter, words) of one ego: :func:`bloom` over ``seen``, with twice the words until none of the ``others`` (ego, name) seems seen."""
    unseen = stage(others.join(seen, ["ego", "name"], "left_anti"), "unseen")
    while True:
        found = bloom(seen, words)
        if words >= most or maybe_seen(unseen, found, words).where("seen").isEmpty():
            return found.withColumn("words", F.lit(words))
        words *= 2


def new_edges(scores: DataFrame, seen: DataFrame, prefix: str = "") -> DataFrame:
    """Scores of at least EPSILON for nodes (name) with the prefix that the ego hasn't seen (ego, name) before."""
    return scores.where(F.col("score") >= EPSILON).where(F.col("name").startswith(prefix)).join(seen, ["ego", "name"], "left_anti")


#: Words of 64 bits that a new filter has.
WORDS = 16


def bloom(names: DataFrame, words: int = 1024, hashes: int = 3) -> DataFrame:
    """(ego, filter): bit positions of each ego's seen names, as a sorted array; double ``words`` when it fills up."""
    bit = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col("name")), F.lit(64 * words))
    return names.select("ego", F.explode(F.array(*[bit(k) for k in range(hashes)])).alias("bit")).groupBy("ego").agg(F.sort_array(F.collect_set("bit")).alias("filter"))


def maybe_seen(names: DataFrame, filters: DataFrame, words: int = 1024, hashes: int = 3) -> DataFrame:
    """``names`` (ego, name) with seen: true for all that the filter holds, and rarely for one that it doesn't."""
    bit = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col("name")), F.lit(64 * words))
    return names.join(filters, "ego", "left").withColumn("seen", F.coalesce(F.forall(F.array(*[bit(k) for k in range(hashes)]), lambda b: F.array_contains("filter", b)), F.lit(False))).drop("filter")


def consensus(values: DataFrame, links: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, value): every node's share of the mean after push-sum rounds over the links and itself.

    A node splits its sum and weight evenly over itself and its targets; the quotient nears the mean of all
    values on a strongly connected graph.
    """
    nodes = values.select("node")
    out = links.select("src", "dst").union(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()
    out = stage(out.join(out.groupBy("src").agg(F.count("*").alias("n")), "src"), "pushsum-links")
    state = values.select("node", F.col("value").cast("double").alias("s"), F.lit(1.0).alias("w"))
    for k in range(rounds):
        state = out.join(state, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("s") / F.col("n")).alias("s"), F.sum(F.col("w") / F.col("n")).alias("w"))
        state = stage(state, "pushsum") if k % 5 == 4 else state
    return state.select("node", (F.col("s") / F.col("w")).alias("value"))


def latency(samples: DataFrame, value: str = "value") -> DataFrame:
    """One row: order statistics of the samples (not interpolated), least, largest and number.

    The place of each is found from counts per distinct value, so samples aren't sorted in one task.
    """
    hist = samples.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    chunk = F.floor(F.col("v"))
    by_chunk = hist.withColumn("k", chunk)
    before = by_chunk.groupBy("k").agg(F.sum("c").alias("kc")).select("k", (F.sum("kc").over(Window.orderBy("k")) - F.col("kc")).alias("b"), F.sum("kc").over(Window.partitionBy()).alias("n"))
    cum = by_chunk.withColumn("own", F.sum("c").over(Window.partitionBy("k").orderBy("v"))).join(checked(before, 32), "k").select("v", "n", (F.col("b") + F.col("own")).alias("cum"))
    at = lambda place: F.min(F.when(F.col("cum") > F.least(place, F.col("n") - 1), F.col("v")))
    floor = lambda q: F.floor(F.col("n") * q / 100).cast("long")
    return cum.agg(at(F.floor((F.col("n") - 1) / 2).cast("long")).alias("median"), at(floor(95)).alias("p95"), at(floor(99)).alias("p99"), F.min("v").alias("min"), F.max("v").alias("max"), F.coalesce(F.max("n"), F.lit(0)).alias("count"))
