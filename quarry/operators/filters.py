"""Predicates over parents and their children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def within(value: Column, low=None, high=None) -> Column:
    """low <= value <= high, each bound optional; null fails a given bound, NaN is above every high bound."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (value >= low)
    if high is not None:
        keep = keep & (value <= high)
    return keep


def having_at_most(parents: DataFrame, children: DataFrame, key: str, counted: Column, limit: int) -> DataFrame:
    """Parents with at most ``limit`` counted children; those without any are kept."""
    n = children.groupBy(key).agg(F.count_if(counted).alias("__n"))
    return parents.join(n, key, "left").where(F.coalesce("__n", F.lit(0)) <= limit).drop("__n")


def for_all(parents: DataFrame, children: DataFrame, key: str, holds: Column) -> DataFrame:
    """Parents all of whose children satisfy the predicate (null counts as not)."""
    return parents.join(children.where(~F.coalesce(holds, F.lit(False))).select(key).distinct(), key, "left_anti")


def observed(df: DataFrame, name: str, step) -> tuple[DataFrame, Observation, Observation]:
    """Applies a filter and counts rows before and after it in the same job."""
    before, after = Observation(f"{name}-before"), Observation(f"{name}-after")
    return step(df.observe(before, F.count(F.lit(1)).alias("n"))).observe(after, F.count(F.lit(1)).alias("n")), before, after
