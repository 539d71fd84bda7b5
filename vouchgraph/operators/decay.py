"""Weights that grow with an operation's magnitude, and the pruning of edges that have become weak."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import checked, stage
from ..settings import EPSILON, Settings


class Fold:
    """Outgoing edges of one source, operation by operation, rescaled whenever a weight passes the threshold."""

    def __init__(self, settings: Settings, scale: int = 0, most: float = 0.0, edges: dict[str, tuple[float, int]] | None = None) -> None:
        self.settings, self.scale, self.most, self.edges = settings, scale, most, edges or {}

    def apply(self, rows: pd.DataFrame) -> dict[str, tuple[float, int]]:
        """Edges (weight, op_idx) by target after ``rows`` (op_idx, dst, amount, magnitude), in order of op_idx."""
        bump = self.settings.vsids_bump
        for r in rows.sort_values("op_idx").itertuples(index=False):
            weight, factor = r.amount * bump ** (r.magnitude - self.scale), 1.0
            if abs(weight) > self.settings.rescale_threshold:
                factor = bump ** (r.magnitude - self.scale)
                self.scale, weight = int(r.magnitude), r.amount
            self.most = max(self.most / factor, abs(weight))
            least = self.most * self.settings.deletion_ratio
            self.edges = {d: (w / factor, i) for d, (w, i) in self.edges.items() if abs(w / factor) > least}
            if abs(weight) > EPSILON:
                self.edges[r.dst] = (weight, int(r.op_idx))
            else:
                self.edges.pop(r.dst, None)
        return self.edges


def fold(rows: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """Edges of one source after all its operations in order."""
    first, edges = rows.iloc[0], Fold(settings).apply(rows)
    return pd.DataFrame([(first.context, first.src, d, w, i) for d, (w, i) in edges.items()], columns=["context", "src", "dst", "weight", "op_idx"])


def decayed(routed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(context, src, dst, weight, op_idx) after decay and pruning.

    A weight is amount * bump^magnitude. Every operation of a source prunes its other edges below
    deletion_ratio of the largest weight it ever had, so a last write survives iff it isn't within EPSILON of
    zero and is the source's last operation or still above that share: one shuffle by (context, src), where pairs
    are summed up and compared. Only sources whose weights pass the threshold are folded in order.
    """
    s = F.col("amount") * F.pow(F.lit(settings.vsids_bump), F.col("magnitude"))
    rows = routed.select("context", "src", "dst", "op_idx", "amount", "magnitude", s.alias("s"))
    wild = stage(rows.groupBy("context", "src").agg(F.max(F.abs("s")).alias("most")).where(F.col("most") > settings.rescale_threshold).select("context", "src"), "wild")
    by_src = Window.partitionBy("context", "src")
    pairs = rows.select("context", "src", "dst", "op_idx", "s").repartition("context", "src").groupBy("context", "src", "dst").agg(F.max_by("s", "op_idx").alias("weight"), F.max("op_idx").alias("op_idx"), F.max(F.abs("s")).alias("most"))
    marked = pairs.withColumns({"most": F.max("most").over(by_src), "last": F.max("op_idx").over(by_src)}).where(F.col("most") <= settings.rescale_threshold)
    kept = marked.where(F.abs("weight") > EPSILON).where((F.col("op_idx") == F.col("last")) | (F.abs("weight") > F.col("most") * settings.deletion_ratio)).select("context", "src", "dst", "weight", "op_idx")
    if wild.isEmpty():
        return kept
    folded = rows.drop("s").join(checked(wild, 96), ["context", "src"], "left_semi").groupBy("context", "src").applyInPandas(lambda p: fold(p, settings), "context string, src string, dst string, weight double, op_idx long")
    return kept.unionByName(folded)
