"""Helpers shared by the corpus operators: staging tables, checked broadcasts, row streams."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in estimated bytes, that is ever broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20

_worker: dict[str, Any] = {}
_own_dir: dict[str, str] = {}
_staged: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``, or an own one where it is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="vouchgraph-")
        spark.sparkContext.setCheckpointDir(_own_dir[app])
    return _own_dir[app]


def new_path(spark: SparkSession, label: str, table: str | None = None) -> str:
    """A path in the shared folder that nothing else uses; it is removed when Python ends, and the catalog's ``table`` there with it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.append((spark, path, table))
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession | None = None) -> None:
    """Delete the staged tables; results that were read from them can't be computed afterwards."""
    while _staged:
        own, path, table = _staged.pop()
        try:
            if table:
                own.sql(f"DROP TABLE IF EXISTS {table}")
            jvm = own.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(own.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended already
            return


atexit.register(drop_staged)


def checked(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows fit the limit, else as it is (a shuffled join)."""
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(col: Column) -> Column:
    """60-bit integer of the md5 of a string: the same in every SQL engine."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 15), 16, 10).cast("long")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of that many rows for what is written inside: wide rows need less memory at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks under ``name``; another name's is let go, so memory doesn't add up."""
    if name not in _worker:
        _worker.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim()
        _worker[name] = make()
    return _worker[name]


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def binary_rows(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of the rows of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
