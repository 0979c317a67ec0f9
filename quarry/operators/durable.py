"""Cuts of lineage that survive lost executors, and Arrow batches that fit a task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows of an Arrow batch.
ARROW_ROWS = 256
#: Rows that ``dealt`` has a task get.
TASK_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). On a cluster it must be set; a local session, as
    in tests, gets a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path:
        return path
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="quarry-checkpoints-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def dealt(table: DataFrame, *key: str) -> DataFrame:
    """A stored table, dealt by a key to as many tasks as its rows need, so what a task sorts doesn't grow with the table. Windows,
    groups and joins on the key and more use the same deal. Counting reads the files' footers only."""
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))
    return table.repartition(tasks, *key)


def stored(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Writes a wider intermediate table as Parquet (columnar, compressed) in the shared folder and reads it back; its
    path is added to ``paths``, for ``remove``."""
    path = f"{shared_dir(df.sparkSession)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of at most ARROW_ROWS rows, set for the session if its limit is Spark's own: 10,000 long
    texts at a time are too much for the memory outside the heap that a task has for Arrow and Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(ARROW_ROWS))
    return df.mapInArrow(run, schema)
