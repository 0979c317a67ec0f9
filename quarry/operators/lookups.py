"""Sequences of entities and chains, scores by kind of molecule, and disorder of structures.

Residues are rows of ``structure``, ``entity``, ``number`` (their order) and ``code``; entities have a ``canonical``
sequence of one-letter codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.sequence import smooth_reflected

ENTITY = ["structure", "entity"]


def entity_codes(residues: DataFrame) -> DataFrame:
    """(structure, entity, codes): the codes of each entity's residues in their order."""
    ordered = residues.groupBy(*ENTITY).agg(F.array_sort(F.collect_list(F.struct("number", "code"))).alias("r"))
    return ordered.select(*ENTITY, F.transform("r", lambda x: x["code"]).alias("codes"))


def entity_sequences(entities: DataFrame, residues: DataFrame, letters: DataFrame, unknown: str = "X") -> DataFrame:
    """(structure, entity, sequence): the canonical sequence, but where a residue's code has a dictionary ``letter`` of
    more than one character the sequence is put together from the dictionary (``code``, ``letter``, codes once), with
    the unknown's letter for those and for codes that it hasn't. Entities without residues keep theirs."""
    one = F.when(F.length("letter") == 1, F.col("letter")).otherwise(F.lit(unknown))
    spelled = residues.join(letters, "code", "left").select(*ENTITY, "number", one.alias("l"), (F.length("letter") > 1).alias("several"))
    built = spelled.groupBy(*ENTITY).agg(F.array_sort(F.collect_list(F.struct("number", "l"))).alias("r"), F.bool_or("several").alias("several"))
    sequence = F.when(F.col("several"), F.array_join(F.transform("r", lambda x: x["l"]), "")).otherwise(F.col("canonical"))
    return entities.join(built, ENTITY, "left").select(*ENTITY, sequence.alias("sequence"))


def chain_sequences(chains: DataFrame, sequences: DataFrame) -> DataFrame:
    """Chains (``structure``, ``chain``, ``entity``) with the sequence of their entity; those without one drop out."""
    return chains.join(sequences, ENTITY).select("structure", "chain", "sequence")


def mean_by_type(atoms: DataFrame, score: Column, types: tuple[str, ...]) -> DataFrame:
    """(structure, complex, one column for each type in small letters): means of a score over a structure's atoms and over
    those of each ``mol_type``; null without such atoms."""
    return atoms.groupBy("structure").agg(F.avg(score).alias("complex"), *(F.avg(F.when(F.col("mol_type") == t, score)).alias(t.lower()) for t in types))


def disorder(residues: DataFrame, value: str, half: int, threshold: float, counted: Column | None = None) -> DataFrame:
    """(structure, disorder, mean): of the residues counted (all, if not said), the share with a smoothed value above the
    threshold and the mean of it; values are smoothed along each chain by ``number``. NaN where none is counted."""
    smooth = smooth_reflected(residues, value, ["structure", "chain"], ["number"], half)
    asked = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    value_ = F.when(asked, F.col("smoothed"))
    found = smooth.groupBy("structure").agg(F.avg((value_ > threshold).cast("double")).alias("d"), F.avg(value_).alias("m"))
    return found.select("structure", F.coalesce("d", F.lit(float("nan"))).alias("disorder"), F.coalesce("m", F.lit(float("nan"))).alias("mean"))
