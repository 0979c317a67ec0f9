"""Structural templates of sequences: checks of hits, chains whose sequence holds a hit, the first hits, and residues.

Hits are rows of ``query``, ``index`` (their order within the query), ``entry``, ``chain`` and ``sequence`` (residues
without gaps); entries have a ``released`` date; chains are rows of ``entry``, ``chain``, ``place`` (their order in the
entry) and ``sequence``. Index maps are rows of ``query``, ``entry``, ``q`` and ``t``: residue numbers, -1 at gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.records import residue_numbers
from quarry.operators.sampling import draw, per_group


def index_map(query: Column, hit: Column, query_start: Column, hit_start: Column) -> Column:
    """Residue numbers (q, t) of two aligned strings, column by column; -1 at gaps, columns of two gaps left out. Letters
    in lower case are insertions: counted, but no columns."""
    pairs = F.zip_with(residue_numbers(query, query_start), residue_numbers(hit, hit_start), lambda q, t: F.struct(q.alias("q"), t.alias("t")))
    return F.filter(pairs, lambda p: (p["q"] != -1) | (p["t"] != -1))


def _any(*checks: Column | None) -> Column:
    """Whether any of the checks that are asked for holds, or has no value."""
    out = F.lit(False)
    for c in checks:
        out = out if c is None else out | F.coalesce(c, F.lit(True))
    return out


def fails_sequence_checks(identity: Column, coverage: Column, length: Column, max_identity: float | None = None, min_coverage: float | None = None, min_length: int | None = None) -> Column:
    """A template too like the query, covering too little of it, or too short; nulls fail a check that is asked for."""
    return _any(
        None if max_identity is None else identity > max_identity,
        None if min_coverage is None else coverage < min_coverage,
        None if min_length is None else length < min_length,
    )


def fails_release_checks(released: Column, query_released: Column, latest: str | None = None, min_days: int | None = None) -> Column:
    """A template released after the latest date, or fewer days before the query than asked for; the latest date itself
    passes, and nulls fail a check that is asked for."""
    return _any(
        None if min_days is None else F.datediff(query_released, released) < min_days,
        None if latest is None else released > F.lit(latest).cast("date"),
    )


def matched_chains(hits: DataFrame, chains: DataFrame, key: list[str]) -> DataFrame:
    """Hits with the chain of their entry whose sequence holds theirs: the chain they name, or else the first other one.
    Hits that no chain holds are left out. ``key`` tells hits apart."""
    c = chains.select("entry", F.col("chain").alias("__chain"), F.col("place").alias("__place"), F.col("sequence").alias("__sequence"))
    held = hits.join(c, "entry").where(F.contains("__sequence", "sequence"))
    other = ~F.col("chain").eqNullSafe(F.col("__chain"))
    best = held.groupBy(*key).agg(F.min_by(F.struct("__chain"), F.struct(other, "__place", "__chain")).alias("__found"))
    out = hits.join(best, key)
    found = F.col("__found.__chain")
    return out.withColumn("remapped", ~F.col("chain").eqNullSafe(found)).withColumn("chain", found).drop("__found")


def first_templates(hits: DataFrame, most: int) -> DataFrame:
    """The first hits of each query, in their order, numbered from 1 as ``rank``; filter before."""
    w = W.partitionBy("query").orderBy("index", "entry", "chain")
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most)


def sampled_templates(cached: DataFrame, structures: DataFrame, most: int, top: bool, seed: int = 0) -> DataFrame:
    """Templates of each query of those in ``structures`` (by ``entry``): the first ``most`` by index or, at random, as
    many as a draw from 0 up to one less than there are, ``most`` at most. Draws depend on seed and names alone."""
    there = cached.join(structures.select("entry").distinct(), "entry", "left_semi")
    if top:
        return per_group(there, ["query"], most, [F.col("index"), F.col("entry"), F.col("chain")])
    n = there.groupBy("query").agg(F.count("*").alias("__n"))
    drawn = F.conv(F.substring(draw(seed, "query"), 1, 8), 16, 10).cast("bigint") % F.col("__n")
    counts = n.select("query", F.least(drawn, F.lit(most)).alias("__k")).where("__k > 0")
    order = W.partitionBy("query").orderBy(draw(seed, "query", "index", "entry", "chain"), "index", "entry", "chain")
    # the rank is cut at a constant first, so a task keeps no more than that of a query
    ranked = there.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most)
    return ranked.join(counts, "query").where("__r <= __k").drop("__r", "__k")


def cropped_map(index_maps: DataFrame, residues: DataFrame) -> DataFrame:
    """Index maps without gaps, and without residues of the query that a crop (``query``, ``residue``) left out."""
    kept = residues.select("query", F.col("residue").alias("q")).distinct()
    return index_maps.where("q <> -1 AND t <> -1").join(kept, ["query", "q"], "left_semi")


def tokens_to_template(index_maps: DataFrame, tokens: DataFrame, template_residues: DataFrame) -> DataFrame:
    """(query, entry, token, q, t): tokens of the query (``query``, ``token``, ``residue``) with the template's residue; a
    residue of several tokens is repeated. A template is left out whole if any mapped residue isn't exactly once among its
    own (``entry``, ``residue``, a row for each)."""
    maps = cropped_map(index_maps, tokens)
    once = template_residues.groupBy("entry", F.col("residue").alias("t")).agg(F.count("*").alias("__n"))
    fits = maps.join(once, ["entry", "t"], "left").groupBy("query", "entry").agg(F.bool_and(F.coalesce(F.col("__n") == 1, F.lit(False))).alias("__fits"))
    sound = maps.join(fits.where("__fits").drop("__fits"), ["query", "entry"], "left_semi")
    return sound.join(tokens.select("query", F.col("residue").alias("q"), "token"), ["query", "q"]).select("query", "entry", "token", "q", "t")
