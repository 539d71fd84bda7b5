"""Operation logs: schema, validation, and the ways to read and write them.

A log is a DataFrame (op_idx, context, kind, src, dst, amount, magnitude, node, score), ordered by op_idx.
kind: edge, delete_edge, delete_node, create_context, zero_opinion, calculate, reset, bulk_load.
"""

from __future__ import annotations

import tarfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "op_idx long, context string, kind string, src string, dst string, amount double, magnitude long, node string, score double"
U32_MAX = (1 << 32) - 1
INT_MAX = (1 << 31) - 1


def required(value: object, name: str) -> None:
    if value is None:
        raise ValueError(f"{name} should not be null")


def page(index: int | None, count: int | None) -> tuple[int, int]:
    """(index, count) with the defaults of the SQL surface; negative values count as 0, a null count as all."""
    return max(0, index or 0), INT_MAX if count is None else max(0, count)


def bounds(gt: float | None, gte: float | None, lt: float | None, lte: float | None) -> None:
    if gt is not None and gte is not None:
        raise ValueError("give gt or gte, not both")
    if lt is not None and lte is not None:
        raise ValueError("give lt or lte, not both")


def direction(value: int) -> int:
    if value not in (0, 1, 2):
        raise ValueError("direction must be 0 (all), 1 (outbound) or 2 (inbound)")
    return value


def magnitude(index: int | None) -> int:
    """A negative, null or too large index is magnitude 0."""
    return index if index is not None and 0 <= index <= U32_MAX else 0


def log(df: DataFrame, kind: str = "edge") -> DataFrame:
    """``df`` in the log's schema: missing columns are null, a null context is "", bad magnitudes are 0, NaN and infinite amounts are dropped."""
    have = set(df.columns)
    cols = []
    for part in SCHEMA.split(", "):
        name, type_ = part.split(" ")
        default = F.lit(kind) if name == "kind" else F.lit(None)
        cols.append((F.col(name) if name in have else default).cast(type_).alias(name))
    out = df.select(*cols).withColumns({
        "context": F.coalesce("context", F.lit("")),
        "magnitude": F.when(F.col("magnitude").between(0, U32_MAX), F.col("magnitude")).otherwise(0).cast("long"),
    })
    finite = ~F.isnan("amount") & (F.abs("amount") != float("inf"))
    return out.where(F.col("amount").isNull() | finite)


def read_csv(spark: SparkSession, path: str, context: str = "") -> DataFrame:
    """Edges of a CSV file with header src,dst,weight; blanks around commas are trimmed, ids may be numbers.

    op_idx follows the file's order of rows: file, then place in it.
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    rows = raw.select(F.monotonically_increasing_id().alias("op_idx"), "src", "dst", F.col("weight").cast("double").alias("amount"))
    return log(rows.withColumn("context", F.lit(context)))


def from_arrays(spark: SparkSession, src: Sequence[str], dst: Sequence[str], weight: Sequence[float], magnitude_: Sequence[int], context: Sequence[str]) -> DataFrame:
    """Edges of five parallel arrays; arrays of different lengths are an error."""
    sizes = {len(x) for x in (src, dst, weight, magnitude_, context)}
    if len(sizes) != 1:
        raise ValueError("all arrays must have the same length")
    rows = [(i, c, s, d, float(w), magnitude(m)) for i, (s, d, w, m, c) in enumerate(zip(src, dst, weight, magnitude_, context))]
    return log(spark.createDataFrame(rows, "op_idx long, context string, src string, dst string, amount double, magnitude long"))


def from_array_columns(df: DataFrame) -> DataFrame:
    """Edges of rows that hold the five arrays as columns (src, dst, weight, magnitude, context) and batch, an order."""
    same = (F.size("src") == F.size("dst")) & (F.size("src") == F.size("weight")) & (F.size("src") == F.size("magnitude")) & (F.size("src") == F.size("context"))
    ok = df.select("batch", F.when(same, F.arrays_zip("src", "dst", "weight", "magnitude", "context")).otherwise(F.raise_error(F.lit("all arrays must have the same length"))).alias("z"))
    rows = ok.select("batch", F.posexplode("z").alias("i", "e")).select((F.col("batch") * (1 << 32) + F.col("i")).alias("op_idx"), "e.context", "e.src", "e.dst", F.col("e.weight").alias("amount"), "e.magnitude")
    return log(rows)


def read_archive(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Edges of the CSV files (context,src,dst,weight,magnitude, no header) of a tar.gz, unpacked into the shared ``folder``."""
    target = Path(folder.removeprefix("file://"))
    target.mkdir(parents=True, exist_ok=True)
    with tarfile.open(path, "r:gz") as t:
        t.extractall(target, filter="data")
    raw = spark.read.csv(folder, schema="context string, src string, dst string, weight double, magnitude long", recursiveFileLookup=True)
    return log(raw.select(F.monotonically_increasing_id().alias("op_idx"), "context", "src", "dst", F.col("weight").alias("amount"), "magnitude"))


def append_stats(stats: DataFrame, path: str) -> None:
    """Append rows of statistics to a CSV folder."""
    stats.write.mode("append").csv(path, header=True)
