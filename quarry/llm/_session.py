"""Helpers shared by the training-data operators: durable cuts of lineage and joins on ids."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.durable import ARROW_ROWS, cut, map_arrow, shared_dir, stored

#: A list of ids is broadcast up to this many rows (8 to 40 bytes each); beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: A key is hot if it has more than one of so many rows, so there are never more hot keys than this.
HOT_KEYS = 10_000


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller parts, so a task holds few texts as Python objects at a time. At the end of a task, freed
    memory goes back to the system, as the Python worker stays for later tasks."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables that no later step reads."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes shuffles and checkpoints that no table refers to any more only then,
    and a heap with much room puts it off while they fill the disks. Between steps that leave much."""
    gc.collect()
    spark._jvm.System.gc()


def join_ids(rows: DataFrame, ids: DataFrame, key: str | list[str], n_ids: int, how: str = "inner") -> DataFrame:
    """Joins ``rows`` with a table of ids, broadcast only if its counted rows stay within BROADCAST_ROWS."""
    return rows.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, key, how)


def join_counted(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Joins ``rows`` with a table of one row a key that says in ``count`` how many of ``total`` rows have the key. Keys
    with more than 1 / HOT_KEYS of the rows, fewer than HOT_KEYS of them, are broadcast, so no task gets a hot key; the
    others are shuffled at every size."""
    is_hot = F.col(count) * HOT_KEYS > total
    hot = F.broadcast(table.where(is_hot))
    rest = rows.join(F.broadcast(table.where(is_hot).select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(~is_hot).hint("merge"), key))


def own_name(id_col: str, taken: tuple[str, ...]) -> str:
    """The id column's name in a result; with ``_id`` appended where an output column has that name."""
    return f"{id_col}_id" if id_col in taken else id_col


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that the table doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["ARROW_ROWS", "BROADCAST_ROWS", "HOT_KEYS", "cut", "free", "fresh", "join_counted", "join_ids", "map_arrow", "own_name", "read_table", "remove", "shared_dir", "slices", "stored"]
