"""Pairing of alignment rows across the chains of a complex, by species."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.sequence import occurrence


def heteromers(chains: DataFrame, group: str, rep: str, protein: Column) -> DataFrame:
    """Complexes with proteins of more than one sequence; the others, single chains and copies of one, are not paired."""
    return chains.where(protein).groupBy(group).agg(F.count_distinct(rep).alias("__n")).where("__n > 1").select(group)


def with_rows_to_pair(rows: DataFrame, group: str, chain: str, sources: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of the sources that are paired, of chains that have a row besides the query's (``row`` 0 of each source)."""
    own = rows if sources is None else rows.where(F.col("source").isin(*sources))
    held = own.groupBy(group, chain).agg(F.count("*").alias("__n")).where("__n > 1").select(group, chain)
    return own.join(held, [group, chain])


def species_counts(rows: DataFrame, group: str, chain: str, species: str, shared: bool = True, most: int | None = 600) -> DataFrame:
    """(group, species, chains, largest) of species that may be paired: found in two chains at least (``shared``), and in
    none more than ``most`` times. Null species are never paired."""
    n = rows.where(F.col(species).isNotNull()).groupBy(group, chain, species).agg(F.count("*").alias("__n"))
    found = n.groupBy(group, species).agg(F.count("*").alias("chains"), F.max("__n").alias("largest"))
    if shared:
        found = found.where("chains > 1")
    return found if most is None else found.where(F.col("largest") <= most)


def pair_rows(
    rows: DataFrame, group: str, chain: str, species: str, order: list[str], max_rows: int = 8191, min_chains: int = 2, shared: bool = True, most: int | None = 600
) -> DataFrame:
    """The rows that are paired, with ``paired_row`` (from 0 in each complex) and ``level`` (chains in that row).

    Levels go from all chains down to ``min_chains`` (to all, if the complex has fewer). At each, a species that just so
    many chains still have rows of gives as many paired rows as the chain with the fewest has left, and these are taken
    from all its chains; what is left goes to lower levels. At most ``max_rows`` in all, the highest levels first, species in
    order of name.

    Taking the fewest from all leaves, after k rows, the chains with more than k: so the k-th rows of a species (by
    ``order`` in each chain) are one paired row, and its level is the number of chains that have a k-th. Only species
    with at most ``most`` rows in a chain are numbered, so no task gets a species that is everywhere, and the limit is applied
    before the complexes' rows are brought together."""
    if min_chains < 1 or max_rows < 0:
        raise ValueError("min_chains must be 1 or more, and max_rows 0 or more")
    chains = rows.groupBy(group).agg(F.count_distinct(chain).alias("__chains")).where("__chains > 1")
    allowed = species_counts(rows, group, chain, species, shared, most).select(group, species)
    numbered = rows.join(allowed, [group, species]).withColumn("__k", occurrence([group, chain, species], order))
    levels = numbered.groupBy(group, species, "__k").agg(F.count("*").alias("level")).join(chains, group)
    levels = levels.where(F.col("level") >= F.least(F.lit(min_chains), "__chains")).drop("__chains")
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("level"), species, "__k"))
    ranked = levels.withColumn("__r", place).where(F.col("__r") <= max_rows).withColumn("paired_row", (F.col("__r") - 1).cast("bigint")).drop("__r")
    return numbered.join(ranked, [group, species, "__k"]).drop("__k")


def with_gaps(paired: DataFrame, group: str, chain: str, value: str) -> DataFrame:
    """(group, paired_row, chain, value): a row for every chain of the complex in each paired row, null where the chain has no
    row of that species."""
    chains = paired.select(group, chain).distinct()
    every = paired.select(group, "paired_row").distinct().join(chains, group)
    return every.join(paired.select(group, "paired_row", chain, value), [group, "paired_row", chain], "left")
