"""Operators over atoms, tokens, bonds and chains, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.sampling import draw


def majority(df: DataFrame, group: list[str], kind: str) -> DataFrame:
    """The most frequent kind of each group; of equally frequent ones the smallest."""
    n = df.groupBy(*group, kind).agg(F.count("*").alias("votes"))
    return n.groupBy(*group).agg(F.min_by(F.struct(kind, "votes"), F.struct(-F.col("votes"), F.col(kind))).alias("m")).select(*group, f"m.{kind}", "m.votes")


def missing_positions(df: DataFrame, group: list[str], position: str, length: Column) -> DataFrame:
    """Positions 1 to length of each group that no row has."""
    full = df.groupBy(*group).agg(length.alias("__n")).select(*group, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias(position))
    return full.join(df.select(*group, F.col(position).cast("int").alias(position)).distinct(), [*group, position], "left_anti")


def contiguous_crop(df: DataFrame, group: str, chain: str, order: list[str], budget: int, seed: int) -> DataFrame:
    """A run of consecutive rows from each chain, chains in drawn order, until the budget of the group is spent. The
    run's start in its chain is drawn, too."""
    sizes = df.groupBy(group, chain).agg(F.count("*").alias("__n"))
    w = W.partitionBy(group).orderBy(draw(seed, group, chain), chain).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("__used", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    take = F.least(F.col("__n"), F.greatest(F.lit(budget) - F.col("__used"), F.lit(0)))
    slack = F.col("__n") - take + 1
    start = F.conv(F.substring(draw(seed + 1, group, chain), 1, 8), 16, 10).cast("bigint") % slack
    sizes = sizes.select(group, chain, take.alias("__take"), start.alias("__start"))
    at = F.row_number().over(W.partitionBy(group, chain).orderBy(*order)) - 1
    rows = df.withColumn("__at", at).join(sizes, [group, chain])
    return rows.where((F.col("__at") >= F.col("__start")) & (F.col("__at") < F.col("__start") + F.col("__take"))).drop("__at", "__start", "__take")


def filter_bonds(bonds: DataFrame, max_length: float, drop_between_chains: bool = True) -> DataFrame:
    """Bonds (chain_1, chain_2, res_1, res_2, kind, polymer_1, polymer_2, length) without coordination bonds between
    chains, links between polymers of different chains or of residues apart in one chain, and too long ones. An unknown
    length is kept."""
    apart = F.col("chain_1") != F.col("chain_2")
    polymers = F.col("polymer_1") & F.col("polymer_2")
    bad = (apart & (F.col("kind") == "COORDINATION")) | (~apart & polymers & (F.abs(F.col("res_1") - F.col("res_2")) > 1))
    if drop_between_chains:
        bad = bad | (apart & polymers)
    too_long = F.col("length").isNotNull() & ~F.isnan("length") & (F.col("length") > max_length)
    return bonds.where(~bad & ~too_long)


def symmetry_ids(members: DataFrame, molecule: str, entity: str) -> DataFrame:
    """(molecule, kind, number): molecules of the same entities and size are one kind, numbered from 1 within it. The
    kind is a digest of its description."""
    m = members.groupBy(molecule).agg(F.array_join(F.array_sort(F.collect_set(F.col(entity).cast("string"))), ",").alias("__e"), F.count("*").alias("__n"))
    m = m.withColumn("kind", F.md5(F.concat_ws("|", "__e", F.col("__n").cast("string"))))
    return m.withColumn("number", F.row_number().over(W.partitionBy("kind").orderBy(molecule)).cast("bigint")).select(molecule, "kind", "number")


def masked_mean(value: Column, mask: Column, eps: float = 1e-4) -> Column:
    """Sum over the mask by its size plus a small number, as an aggregate."""
    return F.sum(F.when(mask, value).otherwise(0.0)) / (F.sum(mask.cast("double")) + eps)


def distance_bin(distance: Column, low: float, high: float, boundaries: int) -> Column:
    """Number of equally spaced boundaries below the distance."""
    step = (high - low) / (boundaries - 1)
    return F.greatest(F.lit(0), F.least(F.lit(boundaries), F.ceil((distance - low) / step))).cast("bigint")


def stacked(parts: list[tuple[DataFrame, int | None]], group: list[str], order: list[str], limit: int) -> DataFrame:
    """Rows of several sources below each other, each cut to its own number and all to the limit, with their place."""
    out = None
    for i, (rows, most) in enumerate(parts):
        own = rows.withColumn("source_no", F.lit(i)).withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
        own = own if most is None else own.where(F.col("__r") <= most)
        out = own if out is None else out.unionByName(own)
    place = F.row_number().over(W.partitionBy(*group).orderBy("source_no", "__r")).cast("bigint")
    return out.withColumn("row_idx", place).where(F.col("row_idx") <= limit).drop("__r")
