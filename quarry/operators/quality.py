"""Assertions over tables: each gives one row (check, offenders), so a suite is one union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, count: Column) -> DataFrame:
    return df.agg(count.alias("offenders")).select(F.lit(name).alias("check"), "offenders")


def holds(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """Rows for which the condition is false; null holds."""
    return _row(df, name, F.count_if(~condition))


def no_nan(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows with a value that is no finite number."""
    bad = (F.isnan(c) | (F.abs(c) == float("inf")) for c in map(F.col, columns))
    return _row(df, name, F.count_if(reduce(lambda a, b: a | b, bad)))


def determines(df: DataFrame, name: str, key: list[str], values: list[str]) -> DataFrame:
    """Keys with more than one combination of values."""
    return _row(df.groupBy(*key).agg(F.count_distinct(*values).alias("n")).where("n > 1"), name, F.count("*"))


def unique(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return at_most(df, name, key, 1)


def at_most(df: DataFrame, name: str, key: list[str], limit: int) -> DataFrame:
    """Keys with more rows than the limit."""
    return _row(df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > limit), name, F.count("*"))


def contained(child: DataFrame, parent: DataFrame, name: str, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    return _row(child.join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(child_key) == F.col("__p"), "left_anti"), name, F.count("*"))
