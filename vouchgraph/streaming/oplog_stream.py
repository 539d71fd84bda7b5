"""Operation logs as streams: snapshots that are published batch by batch, and decay as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.decay import Fold
from ..plans.engine import TrustEngine
from ..settings import Settings
from ..sources import oplog


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Log files (parquet, in the log's schema) of a folder as they arrive; files_per_trigger holds back the rest."""
    return spark.readStream.schema(oplog.SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class Published:
    """The engine readers see: the log of all batches so far, swapped as a whole after each.

    Batches are appended to ``folder`` under their number, so a batch that is tried again replaces itself.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings(), min_ops: int = 1) -> None:
        self.spark, self.folder, self.settings, self.min_ops = spark, folder.rstrip("/"), settings, min_ops
        self.stamp, self.last, self.waiting, self.engine = -1, -1, 0, None

    def apply(self, batch: DataFrame, number: int) -> None:
        """foreachBatch function; publishes once at least ``min_ops`` operations wait."""
        path = f"{self.folder}/batch={number}"
        oplog.log(batch).write.mode("overwrite").parquet(path)
        self.last = number
        self.waiting += self.spark.read.parquet(path).count()
        if self.waiting >= self.min_ops:
            self.publish(number)

    def publish(self, number: int) -> None:
        ops = self.spark.read.schema(oplog.SCHEMA + ", batch int").parquet(self.folder).drop("batch")
        self.engine, self.stamp, self.waiting = TrustEngine(ops, self.settings), number, 0

    def recover(self) -> None:
        """Publish what an earlier run has left in the folder, under the number of its last batch; nothing if it is empty."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        numbers = [int(f.getPath().getName()[6:]) for f in files.listStatus(path) if f.getPath().getName().startswith("batch=")] if files.exists(path) else []
        if numbers:
            self.last = max(numbers)
            self.publish(self.last)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start, or go on after a restart: readers have an engine before the next batch arrives."""
        self.recover()
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()

    def sync(self, query: StreamingQuery) -> int:
        """Wait until everything that has arrived is published; returns the stamp."""
        query.processAllAvailable()
        if self.waiting:
            self.publish(self.last)
        return self.stamp


def decay_stream(routed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Decayed edges as a stream of changes (context, src, dst, weight, op_idx): a weight of 0 takes an edge away.

    State per (context, src): scale, largest weight, edges. Operations of a batch are applied in order of
    op_idx; between batches the order is that of arrival.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scale, most, names, weights, ids = state.get if state.exists else (0, 0.0, [], [], [])
        before = {d: (w, i) for d, w, i in zip(names, weights, ids)}
        own = Fold(settings, scale, most, dict(before))
        edges = own.apply(pd.concat(list(frames)))
        state.update((own.scale, own.most, list(edges), [w for w, _ in edges.values()], [i for _, i in edges.values()]))
        changed = [(key[0], key[1], d, w, i) for d, (w, i) in edges.items() if before.get(d) != (w, i)]
        gone = [(key[0], key[1], d, 0.0, before[d][1]) for d in before if d not in edges]
        yield pd.DataFrame(changed + gone, columns=["context", "src", "dst", "weight", "op_idx"])

    return routed.groupBy("context", "src").applyInPandasWithState(
        step, "context string, src string, dst string, weight double, op_idx long",
        "scale long, most double, names array<string>, weights array<double>, ids array<long>", "update", GroupStateTimeout.NoTimeout)


def memory_table(df: DataFrame, name: str, mode: str = "update") -> StreamingQuery:
    """A running query into an in-memory table, for looking at a stream."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()


__all__ = ["Published", "decay_stream", "memory_table", "read_stream"]
