"""Written tables that cut lineage, and broadcasts behind a size check."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in estimated bytes, that is broadcast.
BROADCAST_BYTES = 32 << 20
_own: dict[str, str] = {}
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or an own folder where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="vouchgraph-")
    return _own[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _staged.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged() -> None:
    """Delete all staged tables, as when Python ends; results that were read from them can't be computed afterwards."""
    while _staged:
        spark, path = _staged.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended already
            return


atexit.register(drop_staged)


def checked(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows fit the limit; else the join shuffles."""
    return F.broadcast(small) if small.count() * row_bytes <= limit else small
