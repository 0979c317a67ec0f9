"""Alignments of chains, put over the tokens of their structures.

Alignment rows are ``rep`` (the sequence they were made for), ``source``, ``row`` (from 0 in each source), ``aligned`` and
``deletions``, as long as ``aligned``; chains are rows of ``structure``, ``chain`` and ``rep``. An alignment's row stays one
row with arrays throughout, so nothing grows with rows times columns; a task holds a row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.sequences import characters

CHAIN = ["structure", "chain"]


def for_chains(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Alignment rows of representatives for each chain that they stand for."""
    return chains.join(rows, "rep")


def padded(values: Column, length: Column, value: Column) -> Column:
    """An array made longer with a value; an error if it is longer already."""
    short = length - F.size(values)
    return F.when(short < 0, F.raise_error(F.lit("longer than the length to pad to"))).otherwise(F.concat(values, F.array_repeat(value, short)))


def padding_mask(values: Column, length: Column) -> Column:
    """1 for each value of an array and 0 for what padding adds."""
    return padded(F.transform(values, lambda _: F.lit(1)), length, F.lit(0))


def in_source_order(rows: DataFrame, group: list[str], sources: tuple[str, ...], most: int) -> DataFrame:
    """The first ``most`` rows of each group, sources in the order given (others left out), numbered anew as ``row``."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    w = W.partitionBy(*group).orderBy("__place", "row", "aligned")
    ranked = rows.where(F.col("source").isin(*sources)).withColumn("__place", place).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    return ranked.withColumn("row", (F.col("__r") - 1).cast("bigint")).drop("__place", "__r")


def row_counts(rows: DataFrame, chains: DataFrame, paired: tuple[str, ...], main: tuple[str, ...], most: int, most_paired: int) -> DataFrame:
    """(structure, n_rows): the query's, the paired rows kept and those of the largest main alignment, ``most`` at most; a
    structure without alignments has one."""
    counts = rows.groupBy("rep").agg(F.count_if(F.col("source").isin(*paired)).alias("p"), F.count_if(F.col("source").isin(*main)).alias("m"))
    found = chains.join(counts, "rep", "left").groupBy("structure").agg(F.coalesce(F.max("p"), F.lit(0)).alias("p"), F.coalesce(F.max("m"), F.lit(0)).alias("m"))
    return found.select("structure", F.least(1 + F.least("p", F.lit(most_paired)) + F.col("m"), F.lit(most)).cast("bigint").alias("n_rows"))


def deletion_means(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rep, column, mean): deletions before each column, averaged over the rows; zeros for sequences without rows, by
    their ``length`` in ``lengths``."""
    cells = rows.select("rep", F.posexplode("deletions").alias("column", "n")).groupBy("rep", "column").agg(F.avg("n").alias("mean"))
    columns = lengths.where("length > 0").select("rep", F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)).alias("column"))
    return columns.join(cells, ["rep", "column"], "left").select("rep", F.col("column").cast("bigint").alias("column"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def stacked(rows: DataFrame, query: str, paired: tuple[str, ...], main: tuple[str, ...], most: int, most_paired: int) -> DataFrame:
    """Rows of each representative, one above the other: its query's, paired ones up to their limit, main ones up to
    ``most`` in all; ``row`` is the place in the stack."""
    one = rows.where((F.col("source") == query) & (F.col("row") == 0))
    two = in_source_order(rows, ["rep"], paired, most_paired)
    three = in_source_order(rows, ["rep"], main, most)
    part = lambda frame, n: frame.withColumn("__part", F.lit(n))
    w = W.partitionBy("rep").orderBy("__part", "row")
    ranked = part(one, 0).unionByName(part(two, 1)).unionByName(part(three, 2)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    return ranked.withColumn("row", (F.col("__r") - 1).cast("bigint")).drop("__part", "__r")


def over_tokens(stack: DataFrame, chains: DataFrame, tokens: DataFrame, counts: DataFrame, gap: str = "-") -> DataFrame:
    """(structure, chain, row, letters, deletions, mask) for each row up to the structure's number: the letter and the
    deletions of the column of each token's residue (``structure``, ``chain``, ``token``, ``residue`` from 1), in the order
    of tokens. Residues outside the alignment, rows that a chain hasn't, and chains without an alignment are gaps, with a
    mask of 0."""
    residues = tokens.groupBy(*CHAIN).agg(F.array_sort(F.collect_list(F.struct("token", "residue"))).alias("__t"))
    places = chains.join(residues, CHAIN).join(counts, "structure").withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_rows") - 1)))
    both = places.join(stack.select("rep", "row", characters(F.col("aligned")).alias("__a"), F.col("deletions").alias("__d")), ["rep", "row"], "left")
    at = F.transform("__t", lambda t: t["residue"].cast("int") - 1)
    inside = lambda i: F.coalesce((i >= 0) & (i < F.size("__a")), F.lit(False))
    return both.select(
        *CHAIN, "row",
        F.transform(at, lambda i: F.when(inside(i), F.get("__a", i)).otherwise(F.lit(gap))).alias("letters"),
        F.transform(at, lambda i: F.when(inside(i), F.get("__d", i)).otherwise(F.lit(0))).alias("deletions"),
        F.transform(at, lambda i: inside(i).cast("int")).alias("mask"),
    )
