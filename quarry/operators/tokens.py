"""Tokens over atoms: standard residues of polymers are one token, all else one token an atom.

Atoms are as in ``cleanup``. A structure is one group of the windows here, so a task holds one structure at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from quarry.operators.cleanup import RESIDUE, _ends, is_polymer

#: Atoms of peptide bonds and of those between nucleotides, and residues by what represents them.
PEPTIDE, PHOSPHODIESTER = ("N", "C"), ("P", "O3'", "O5'")
PURINES, PYRIMIDINES = ("A", "G", "DA", "DG"), ("C", "U", "DC", "DT")


def in_order() -> WindowSpec:
    return W.partitionBy("structure").orderBy("idx")


def changed(*columns: str) -> Column:
    """Whether any column differs from the atom before, or there is none."""
    now, before = F.struct(*columns), F.lag(F.struct(*columns)).over(in_order())
    return ~before.eqNullSafe(now)


def running(flag: Column) -> Column:
    """Number of flags up to each atom."""
    return F.sum(flag.cast("bigint")).over(in_order().rowsBetween(W.unboundedPreceding, 0))


def standard_residue_starts(atoms: DataFrame, standard: tuple[str, ...]) -> DataFrame:
    """First atoms of standard residues of polymers."""
    start = changed("chain", "res_id", "res_name")
    return atoms.withColumn("__start", start).where(F.col("__start") & is_polymer() & F.col("res_name").isin(*standard)).drop("__start")


def modified_residues(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Residues with a bond to another one that is neither a peptide bond (both atoms of PEPTIDE) nor one of a nucleic acid's
    backbone (both of PHOSPHODIESTER): both residues of the bond."""
    e = _ends(atoms, bonds, ["chain", "res_id", "atom_name"]).where("NOT (chain_1 <=> chain_2 AND res_id_1 <=> res_id_2)")
    plain = lambda names: F.coalesce(F.col("atom_name_1").isin(*names) & F.col("atom_name_2").isin(*names), F.lit(False))
    e = e.where(~plain(PEPTIDE) & ~plain(PHOSPHODIESTER))
    side = lambda n: e.select("structure", F.col(f"chain_{n}").alias("chain"), F.col(f"res_id_{n}").alias("res_id"))
    return side("1").union(side("2")).distinct()


def tokenize(atoms: DataFrame, standard: tuple[str, ...], modified: DataFrame | None = None, center: tuple[str, ...] = ("CA", "C1'")) -> DataFrame:
    """Adds ``token_id`` from 0 in each structure, ``atomized`` and ``center``: the central atom of a token."""
    whole = is_polymer() & F.coalesce(F.col("res_name").isin(*standard), F.lit(False))
    if modified is not None:
        atoms = atoms.join(modified.withColumn("__modified", F.lit(True)), RESIDUE, "left")
        whole = whole & F.col("__modified").isNull()
    rows = atoms.withColumn("atomized", ~whole)
    rows = rows.withColumn("token_id", running(F.col("atomized") | changed("chain", "res_id", "res_name", "atomized")) - 1)
    return rows.withColumn("center", F.col("atomized") | F.coalesce(F.col("atom_name").isin(*center), F.lit(False))).drop("__modified")


def positions(tokens: DataFrame) -> DataFrame:
    """Adds, from 0, ``token_position``, ``residue_index`` and ``chain_run`` (from 1; a label that returns gets a new run)."""
    return tokens.withColumns({
        "token_position": F.dense_rank().over(W.partitionBy("structure").orderBy("token_id")).cast("bigint") - 1,
        "residue_index": running(changed("chain", "res_id", "res_name")) - 1,
        "chain_run": running(changed("chain")),
    })


def token_counts(tokens: DataFrame) -> DataFrame:
    """(structure, tokens, atoms, most): number of tokens and atoms, and atoms of the largest token."""
    each = tokens.groupBy("structure", "token_id").agg(F.count("*").alias("n"))
    return each.groupBy("structure").agg(F.count("*").alias("tokens"), F.sum("n").alias("atoms"), F.max("n").alias("most"))


def instance_index(tokens: DataFrame, instance: list[str], of: str, base: int) -> Column:
    """Number of ``of`` within each molecule instance, dense, from ``base``."""
    return F.dense_rank().over(W.partitionBy("structure", *instance).orderBy(of)).cast("bigint") - 1 + base


def token_bonds(tokens: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure, token_1, token_2): tokens with a bond between atomized atoms, both ways round, each once."""
    e = _ends(tokens, bonds, ["token_id", "atomized"]).where("atomized_1 AND atomized_2 AND token_id_1 <> token_id_2")
    one = e.select("structure", F.col("token_id_1").alias("token_1"), F.col("token_id_2").alias("token_2"))
    return one.union(e.select("structure", "token_id_2", "token_id_1")).distinct()


def representative(mol_type: Column, res_name: Column, atom_name: Column, atomized: Column) -> Column:
    """Whether an atom represents its token: of proteins CB (CA of glycine), of nucleic acids C4 of purines and C2 of
    pyrimidines, of an atomized token itself; other residues of nucleic acids have none."""
    want = F.when(mol_type == "PROTEIN", F.when(res_name == "GLY", "CA").otherwise("CB"))
    want = want.when(mol_type.isin("DNA", "RNA"), F.when(res_name.isin(*PURINES), "C4").when(res_name.isin(*PYRIMIDINES), "C2"))
    return F.coalesce(atomized | (atom_name == want), F.lit(False))


def atom_offsets(tokens: DataFrame) -> DataFrame:
    """Adds ``offset``: an atom's number in its token, from 0."""
    return tokens.withColumn("offset", F.row_number().over(W.partitionBy("structure", "token_id").orderBy("idx")).cast("bigint") - 1)


def atom_to_token(counts: DataFrame) -> DataFrame:
    """(structure, token_id, atom): one row for each of a token's ``n_atoms`` atoms where its ``mask`` is set, numbered in
    the structure; a masked token has none."""
    each = counts.withColumn("__n", F.when(F.col("mask"), F.col("n_atoms")).otherwise(0)).where("__n > 0")
    each = each.withColumn("__end", F.sum("__n").over(W.partitionBy("structure").orderBy("token_id").rowsBetween(W.unboundedPreceding, 0)))
    return each.select("structure", "token_id", F.explode(F.sequence(F.col("__end") - F.col("__n"), F.col("__end") - 1)).alias("atom"))


def padded(tokens: DataFrame, budget: int, fill: dict[str, object]) -> DataFrame:
    """Rows of (structure, token_id, ...) up to a budget of tokens a structure; added rows hold the values of ``fill``."""
    have = tokens.groupBy("structure").agg((F.max("token_id") + 1).alias("__n")).where(F.col("__n") < budget)
    more = have.select("structure", F.explode(F.sequence(F.col("__n"), F.lit(budget - 1).cast("bigint"))).alias("token_id"))
    for name in (c for c in tokens.columns if c not in ("structure", "token_id")):
        more = more.withColumn(name, F.lit(fill.get(name)).cast(tokens.schema[name].dataType))
    return tokens.where(F.col("token_id") < budget).unionByName(more)
