"""Hits of random walks, with node ids from the registry."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel, rng
from ..functions.expr import micro
from ..plans.staging import BROADCAST_BYTES, checked, stage
from ..settings import Settings

#: Walks of one ego that one row of work stands for.
_BLOCK = 10_000
#: Rows of hits that a task hands over at once.
_ROWS = 50_000
#: Edges up to which the driver takes out itself those that lead on.
_DRIVER_EDGES = 1 << 20
#: Edges that one row of :func:`ranges` holds, on average.
_PER_BUCKET = 32
#: Bytes of a walk in a broadcast.
_WALK_BYTES = 128


def by_id(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_id, dst_id, w, negative): edges of one context with ids, weights in millionths."""
    names = nodes.select("name", "node_id")
    s = checked(names.select(F.col("name").alias("src"), F.col("node_id").alias("src_id")), 48)
    d = checked(names.select(F.col("name").alias("dst"), F.col("node_id").alias("dst_id")), 48)
    return edges.join(s, "src").join(d, "dst").select("src_id", "dst_id", micro(F.col("weight")).alias("w"), (F.col("weight") < 0).alias("negative"))


class Network:
    """A graph's edges (:func:`by_id`) as walks need them, made once and used for any number of egos.

    A walk comes back only to nodes that an edge leads to. Their edges, if they fit broadcast_bytes, go to every task,
    which advances many walks at once; other egos bring their own first edges along. Edges that don't fit stay
    tables and walks are joined to them step by step. Both draw the same numbers and give the same hits.
    """

    def __init__(self, edges: DataFrame, settings: Settings = Settings()) -> None:
        self.edges, self.settings = edges, settings

    @cached_property
    def _targets(self) -> DataFrame:
        return stage(self.edges.select(F.col("dst_id").alias("src_id")).distinct(), "targets")

    @cached_property
    def _core(self) -> tuple[Broadcast, bool] | None:
        """(adjacency of nodes that edges lead to, whether there are other sources), None if it is too large."""
        n, nodes, most = self.edges.count(), self._targets.count(), self.settings.broadcast_bytes
        size = lambda edges: edges * kernel.EDGE_BYTES + nodes * kernel.NODE_BYTES
        core = self.edges
        if n > _DRIVER_EDGES:
            core = stage(core.join(checked(self._targets, 16), "src_id", "left_semi"), "core")
            if size(core.count()) > most:
                return None
        elif size(n) > most:
            return None
        t, ids = core.toArrow(), np.sort(self._targets.toArrow().column("src_id").to_numpy())
        s, d, w = (t.column(c).to_numpy() for c in ("src_id", "dst_id", "w"))
        keep = np.isin(s, ids)
        negative = t.column("negative").to_numpy(zero_copy_only=False).astype(bool)
        adj = kernel.Adjacency(s[keep], d[keep], w[keep], negative[keep], ids)
        return self.edges.sparkSession.sparkContext.broadcast(adj), int(keep.sum()) < n

    def hits(self, egos: DataFrame) -> DataFrame:
        """(ego, node, pos_hits, neg_hits) of num_walks walks from each of ``egos`` (ego ids)."""
        if self._core is None:
            return self.joined_hits(egos)
        bc, others = self._core
        n, seed, alpha = self.settings.num_walks, self.settings.seed, self.settings.alpha

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, rows = [], 0
            for b in batches:
                ego, low, own = b.column("ego").to_numpy(), b.column("low").to_numpy(), b.column("own")
                end = np.concatenate([[0], np.cumsum(own.value_lengths().fill_null(0).to_numpy())])
                dst, w, negative = (x.to_numpy(zero_copy_only=False) for x in own.flatten().flatten())
                size = np.minimum(_BLOCK, n - low)
                walked = np.cumsum(size)
                k = 0
                while k < len(ego):
                    top = max(k + 1, int(np.searchsorted(walked, walked[k] - size[k] + kernel.CHUNK, side="right")))
                    s, mine = size[k:top], slice(end[k], end[top])
                    start = np.repeat(low[k:top] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
                    place = np.repeat(np.arange(top - k), np.diff(end[k : top + 1]))
                    first = bc.value.own(place, dst[mine], w[mine], negative[mine], top - k)
                    found.append(kernel.hits(bc.value, np.repeat(ego[k:top], s), start, seed, alpha, first, np.repeat(np.arange(top - k), s)))
                    rows += len(found[-1][0])
                    if rows >= _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["ego", "node", "pos_hits", "neg_hits"])
                        found, rows = [], 0
                    k = top
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["ego", "node", "pos_hits", "neg_hits"])

        work = egos.select("ego", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(_BLOCK).cast("long"))).alias("low"))
        if others:
            asked = checked(egos.select(F.col("ego").alias("src_id")), 16)
            first = self.edges.join(asked, "src_id", "left_semi").join(checked(self._targets, 16), "src_id", "left_anti")
            work = work.join(first.groupBy(F.col("src_id").alias("ego")).agg(F.collect_list(F.struct("dst_id", "w", "negative")).alias("own")), "ego", "left")
        else:
            work = work.withColumn("own", F.lit(None).cast("array<struct<dst_id: long, w: long, negative: boolean>>"))
        # work is tiny against what it stands for: spread it over all cores by hand
        found = work.repartition(3 * egos.sparkSession.sparkContext.defaultParallelism, "ego", "low").mapInArrow(run, "ego long, node long, pos_hits long, neg_hits long")
        return found if n <= _BLOCK else found.groupBy("ego", "node").agg(F.sum("pos_hits").alias("pos_hits"), F.sum("neg_hits").alias("neg_hits"))

    @cached_property
    def _ranges(self) -> tuple[DataFrame, DataFrame]:
        return ranges(self.edges)

    def joined_hits(self, egos: DataFrame) -> DataFrame:
        """:meth:`hits` with walks as rows, joined to the edges step by step; each step is a written table.

        A step joins the draw's total, then the bucket the draw falls into: walks at a hub are spread over its buckets.
        Walks that are few go to the edges, which are read where they lie; only many walks let edges be shuffled.
        """
        below, seed = rng.go_on_below(self.settings.alpha), self.settings.seed % rng.P
        sources, buckets = self._ranges
        h = rng.mix_col(rng.mix_col(F.lit(seed).cast("long"), F.col("ego")), F.col("wid"))
        state = egos.select("ego", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.settings.num_walks - 1).cast("long"))).alias("wid"))
        state = stage(state.select("ego", "wid", h.alias("h"), F.col("ego").alias("node"), F.lit(0).alias("phase")), "walk")
        visits, step = state.select("ego", "wid", "node", "phase"), 0
        while walking := state.count():
            few = F.broadcast if walking * _WALK_BYTES <= BROADCAST_BYTES else lambda df: df
            go = state.where(rng.mix_col(F.col("h"), F.lit(4 * step).cast("long")) < below)
            pick = (rng.mix_col(F.col("h"), F.lit(4 * step + 1).cast("long")) * (1 << 31) + rng.mix_col(F.col("h"), F.lit(4 * step + 2).cast("long"))) % F.col("total")
            drawn = sources.join(few(go.withColumnRenamed("node", "src_id")), ["src_id", "phase"]).withColumn("pick", pick)
            met = buckets.join(few(drawn.withColumn("bucket", F.expr("pick div width"))), ["src_id", "phase", "bucket"])
            edge = F.get(F.filter("out", lambda e: e["hi"] > F.col("pick")), F.lit(0))
            state = stage(met.select("ego", "wid", "h", edge.alias("e"), "phase").select("ego", "wid", "h", F.col("e.dst_id").alias("node"), F.greatest(F.col("phase"), F.col("e.negative").cast("int")).alias("phase")), "walk")
            visits = visits.unionByName(state.select("ego", "wid", "node", "phase"))
            step += 1
        once = visits.distinct()
        return once.groupBy("ego", "node").agg(F.count_if(F.col("phase") == 0).alias("pos_hits"), F.count_if(F.col("phase") == 1).alias("neg_hits"))


def hits(edges: DataFrame, egos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """:meth:`Network.hits` of a network for once."""
    return Network(edges, settings).hits(egos)


def joined_hits(edges: DataFrame, egos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """:meth:`Network.joined_hits` of a network for once."""
    return Network(edges, settings).joined_hits(egos)


def ranges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src_id, phase, total, width), (src_id, phase, bucket, out)): each source's draws, cut into buckets of equal width.

    ``out`` lists the edges (hi, dst_id, negative) that draws of the bucket can meet, by rising hi: a source with
    many edges is many rows, so a step mostly looks through a few dozen edges, whatever the degree. Edges are
    shuffled once, by source; sums, buckets and lists are made where they arrive.
    """
    good = F.when(~F.col("negative"), F.col("w")).otherwise(0)
    totals = edges.groupBy("src_id").agg(F.sum("w").alias("t0"), F.count("*").alias("n0"), F.sum(good).alias("t1"), F.count_if(~F.col("negative")).alias("n1"))
    width = lambda k: F.expr(f"(t{k} + ceil(n{k} / {_PER_BUCKET}) - 1) div ceil(n{k} / {_PER_BUCKET})")
    totals = stage(totals.select("src_id", "t0", width(0).alias("w0"), "t1", F.when(F.col("n1") > 0, width(1)).alias("w1")), "totals")
    phase = lambda k: F.struct(F.lit(k).alias("phase"), F.col(f"t{k}").alias("total"), F.col(f"w{k}").alias("width"))
    sources = totals.select("src_id", F.explode(F.array(phase(0), phase(1))).alias("e")).select("src_id", "e.*").where("total > 0")
    w = Window.partitionBy("src_id").orderBy("dst_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = edges.select("src_id", "dst_id", "w", "negative", F.sum("w").over(w).alias("h0"), F.sum(good).over(w).alias("h1"))
    cut = cut.join(checked(totals.select("src_id", "w0", "w1"), 48), "src_id")
    piece = lambda k: F.struct(F.lit(k).alias("phase"), F.col(f"h{k}").alias("hi"), F.col(f"w{k}").alias("width"))
    both = cut.select("src_id", "dst_id", "w", "negative", F.explode(F.when(F.col("negative"), F.array(piece(0))).otherwise(F.array(piece(0), piece(1)))).alias("e")).select("src_id", "dst_id", "w", "negative", "e.*")
    spread = both.withColumn("bucket", F.explode(F.sequence(F.expr("(hi - w) div width"), F.expr("(hi - 1) div width"))))
    lists = spread.groupBy("src_id", "phase", "bucket").agg(F.sort_array(F.collect_list(F.struct("hi", "dst_id", "negative"))).alias("out"))
    return sources, stage(lists, "buckets")


def reachable(edges: DataFrame, ego: int) -> DataFrame:
    """(node): the ego and all that walks from it can visit, found hop by hop, a written table each."""
    seen = front = stage(edges.sparkSession.range(ego, ego + 1, 1, 1).select(F.col("id").alias("node")), "reached")
    hop = edges.select("src_id", "dst_id")
    while not front.isEmpty():
        met = hop.join(checked(front.select(F.col("node").alias("src_id")), 16), "src_id", "left_semi").select(F.col("dst_id").alias("node")).distinct()
        front = stage(met.join(checked(seen, 16), "node", "left_anti"), "front")
        seen = seen.unionByName(front)
    return seen


def exact(edges: DataFrame, ego: int, alpha: float) -> DataFrame:
    """(node, score): the limit of raw scores, of the nodes that walks from the ego can visit.

    Up to kernel.EXACT_NODES of them are solved densely on the driver. Of more, each node needs a sum of powers of
    its own, quadratic work by nature: tasks take a few nodes at a time, with the edges in every task and memory that
    doesn't grow with the number of pairs.
    """
    spark = edges.sparkSession
    seen = reachable(edges, ego)
    t = edges.join(checked(seen.select(F.col("node").alias("src_id")), 16), "src_id", "left_semi").toArrow()
    s, d, w = (t.column(c).to_numpy() for c in ("src_id", "dst_id", "w"))
    signed = np.where(t.column("negative").to_numpy(zero_copy_only=False), -w, w) / 1e6
    ids = np.unique(np.concatenate([s, d, [ego]]))
    n, me, s, d = len(ids), int(np.searchsorted(ids, ego)), np.searchsorted(ids, s), np.searchsorted(ids, d)
    if n <= kernel.EXACT_NODES:
        found = kernel.exact(s, d, signed, me, n, alpha)
    else:
        steps = kernel.powers(s, d, signed, n, alpha)
        bc = spark.sparkContext.broadcast(steps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node = b.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, bc.value[0].diagonal(node), bc.value[2].diagonal(node))], ["id", "before", "after"])

        both = spark.range(n).repartition(4 * spark.sparkContext.defaultParallelism, "id").mapInArrow(run, "id long, before double, after double").toArrow()
        order = np.argsort(both.column("id").to_numpy())
        found = kernel.exact_by_powers(steps, me, *(both.column(c).to_numpy()[order] for c in ("before", "after")))
    return spark.createDataFrame(pa.table({"node": ids, "score": found}))


def touched(visits: DataFrame, changed: DataFrame) -> DataFrame:
    """Egos whose walks must be redone after an edge of ``changed`` (src) changed: those that ever hit a source."""
    return visits.join(changed.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select("ego").distinct()
