"""Samples that are the same in every run: order by a hash of seed and key instead of random draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.order import prefix_sum


def draw(seed: int, *key: Column | str) -> Column:
    """Pseudo-random order of a key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key)))


def per_group(df: DataFrame, group: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each group (all, where it has fewer)."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def clusters_then_members(df: DataFrame, kind: str, cluster: str, quota: Column, seed: int, key: list[str]) -> DataFrame:
    """One drawn member of each cluster, then as many clusters of each kind as its quota says (null: all)."""
    one = per_group(df, [kind, cluster], 1, [draw(seed, *key), *map(F.col, key)])
    rank = F.row_number().over(W.partitionBy(kind).orderBy(draw(seed + 1, kind, cluster), F.col(cluster)))
    return one.withColumn("__r", rank).where(quota.isNull() | (F.col("__r") <= quota)).drop("__r")


def by_weight(df: DataFrame, weight: str, order: list[str], draws: int, step: int) -> DataFrame:
    """``draws`` rows with replacement, in proportion to whole-number weights: point i * step modulo the total falls
    into the row whose running total covers it. Points meet rows by partition, so neither side is gathered."""
    running, parts = prefix_sum(df.where(F.col(weight) > 0), order, F.col(weight).cast("long"), "__running", "__part")
    total = parts.agg(F.max("until")).first()[0] or 0
    if not total:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    points = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (F.col("id") * step % total).alias("point"))
    # parts: few rows, one for each partition
    placed = points.join(F.broadcast(parts), (F.col("point") >= F.col("since")) & (F.col("point") < F.col("until"))).select(F.col("draw").alias("__draw"), F.col("point").alias("__point"), "__part")
    hit = (F.col("__point") >= F.col("__running") - F.col(weight)) & (F.col("__point") < F.col("__running"))
    return running.join(placed, "__part").where(hit).withColumn("draw", F.col("__draw")).drop("__part", "__point", "__running", "__draw")
