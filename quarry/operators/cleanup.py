"""Cleaning of structures as tables.

Atoms are rows (structure, chain, res_id, res_name, atom_name, element, mol_type, occupancy, x, y, z, idx), bonds are rows
(structure, idx_1, idx_2, kind) over ``idx``, an atom's number in its structure. A null name matches no list, so its atom
stays; a null chain is no chain to drop. Chains are dropped by anti joins on (structure, chain), whose keys are small next
to the atoms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.graph import smallest_reachable, whole_groups

#: Names of water, hydrogen and of the types that are polymers.
WATERS, HYDROGENS, POLYMERS = ("HOH", "DOD"), ("H", "D"), ("PROTEIN", "DNA", "RNA")
CHAIN, RESIDUE = ["structure", "chain"], ["structure", "chain", "res_id"]


def _without(atoms: DataFrame, name: str, listed: tuple[str, ...]) -> DataFrame:
    return atoms.where(~F.coalesce(F.col(name).isin(*listed), F.lit(False)))


def remove_waters(atoms: DataFrame) -> DataFrame:
    return _without(atoms, "res_name", WATERS)


def remove_hydrogens(atoms: DataFrame) -> DataFrame:
    return _without(atoms, "element", HYDROGENS)


def remove_residues(atoms: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """Without residues of a list, such as crystallization aids."""
    return _without(atoms, "res_name", codes)


def is_polymer(mol_type: Column | str = "mol_type") -> Column:
    return F.coalesce((F.col(mol_type) if isinstance(mol_type, str) else mol_type).isin(*POLYMERS), F.lit(False))


def small_polymer_chains(atoms: DataFrame, max_residues: int = 3) -> DataFrame:
    """Polymer chains of at most so many resolved residues; a chain without any resolved atom isn't judged, and stays."""
    resolved = atoms.where(is_polymer() & (F.col("occupancy") > 0))
    return resolved.groupBy(*CHAIN).agg(F.count_distinct("res_id").alias("n")).where(F.col("n") <= max_residues).select(*CHAIN)


def unknown_polymer_chains(atoms: DataFrame, unknown: str = "UNK") -> DataFrame:
    """Polymer chains all of whose residues are unknown."""
    return atoms.where(is_polymer()).groupBy(*CHAIN).agg(F.bool_and(F.col("res_name") == unknown).alias("all")).where("all").select(*CHAIN)


def small_ligand_chains(atoms: DataFrame, max_atoms: int = 5) -> DataFrame:
    """Chains with ligand atoms, at most so many; what else the chain has isn't counted."""
    return atoms.where(F.col("mol_type") == "LIGAND").groupBy(*CHAIN).agg(F.count("*").alias("n")).where(F.col("n") <= max_atoms).select(*CHAIN)


def small_ligand_mask(atoms: DataFrame, max_atoms: int = 5) -> DataFrame:
    """Atoms with ``small_ligand``: whether their chain is a small ligand."""
    small = small_ligand_chains(atoms, max_atoms).withColumn("__small", F.lit(True))
    return atoms.join(small, CHAIN, "left").withColumn("small_ligand", F.coalesce("__small", F.lit(False))).drop("__small")


def _of_chains(atoms: DataFrame, chains: DataFrame) -> DataFrame:
    """Atoms with ``__of``: whether their chain is one of ``chains``. These are listed by structure, so atoms are joined by
    structure alone and stay where the windows over structures have put them."""
    listed = chains.groupBy("structure").agg(F.collect_set("chain").alias("__chains"))
    return atoms.join(listed, "structure", "left").withColumn("__of", F.coalesce(F.array_contains("__chains", F.col("chain")), F.lit(False))).drop("__chains")


def _attached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole structures (structure, idx_1, idx_2, chain, hetero, of; an atom has no idx_2 and a bond has only it besides),
    the attached ligand atoms: hetero atoms are merged to components, then each chain's atoms with those beside them."""
    for group, table in whole_groups(batches):
        is_bond = table.column("idx_2").is_valid().to_numpy()
        names, place = np.unique(np.concatenate([table.column(c).combine_chunks().fill_null(0).to_numpy() for c in ("idx_1", "idx_2")]), return_inverse=True)
        first, second = (group * np.int64(len(names)) + p for p in np.split(place, 2))
        atom, row = np.unique(first[~is_bond], return_index=True)
        row, n = np.flatnonzero(~is_bond)[row], len(atom)
        if not n:
            continue
        hetero, of = (table.column(c).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)[row] for c in ("hetero", "of"))
        code = table.column("chain").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()[row]
        chain = np.unique(group[row] * np.int64(code.max() + 1) + code, return_inverse=True)[1]
        ends = [np.minimum(np.searchsorted(atom, x[is_bond]), n - 1) for x in (first, second)]
        known = (atom[ends[0]] == first[is_bond]) & (atom[ends[1]] == second[is_bond])
        a, b = ends[0][known], ends[1][known]
        both = hetero[a] & hetero[b]
        node = np.where(hetero, smallest_reachable(a[both], b[both], n), np.arange(n))
        # atoms are in order of structure and number, so a chain's first row is its first atom
        start = np.zeros(chain.max() + 1, np.int64)
        start[chain[::-1]] = node[::-1]
        asked = np.bincount(chain, of) > 0
        asked &= np.bincount(chain, ~hetero) > 0
        sides = [(chain[x], node[x], node[y]) for x, y in ((a, b), (b, a)) for keep in [asked[chain[x]] & (hetero[y] | (chain[x] == chain[y])) & (node[x] != node[y])] for x, y in [(x[keep], y[keep])]]
        part, one, two = (np.concatenate(x) for x in zip(*sides, strict=True))
        starts = np.flatnonzero(asked)
        keys, number = np.unique(np.concatenate([starts * n + start[starts], part * n + one, part * n + two]), return_inverse=True)
        k, m = len(starts), len(part)
        label = smallest_reachable(number[k : k + m], number[k + m :], len(keys))
        home = np.full(len(start), -1)
        home[starts] = label[number[:k]]
        found = np.zeros(n, bool)
        found[keys[label == home[keys // n]] % n] = True
        out = row[hetero & found[node]]
        yield pa.RecordBatch.from_arrays([table.column(i).combine_chunks().take(pa.array(out)) for i in (0, 1)], names=["structure", "idx"])


def attached_ligands(atoms: DataFrame, chains: DataFrame, bonds: DataFrame, hetero: Column) -> DataFrame:
    """(structure, idx): hetero atoms that are connected with the first atom of one of the chains through that chain's atoms
    and hetero atoms alone, over any number of ligands. A chain that is all hetero has none.

    Atoms and bonds are shuffled once, by structure; a task holds one structure, or many small ones side by side."""
    kinds = {c: atoms.schema[c].dataType for c in ("structure", "chain", "idx")}
    own = _of_chains(atoms.select("structure", "chain", "idx", F.coalesce(hetero, F.lit(False)).alias("hetero")).where("idx IS NOT NULL"), chains)
    none = lambda kind: F.lit(None).cast(kind)
    rows = own.select("structure", F.col("idx").cast("bigint").alias("idx_1"), none("bigint").alias("idx_2"), "chain", "hetero", F.col("__of").alias("of"))
    rows = rows.union(bonds.where("idx_1 IS NOT NULL AND idx_2 IS NOT NULL").select("structure", F.col("idx_1").cast("bigint"), F.col("idx_2").cast("bigint"), none(kinds["chain"]), none("boolean"), none("boolean")))
    found = rows.repartition("structure").sortWithinPartitions("structure").mapInArrow(_attached, f"structure {kinds['structure'].simpleString()}, idx bigint")
    return found.select("structure", F.col("idx").cast(kinds["idx"]).alias("idx"))


def drop_chains(atoms: DataFrame, chains: DataFrame, bonds: DataFrame | None = None, hetero: Column | None = None) -> DataFrame:
    """Without some chains and, given bonds, without the ligand atoms connected with them (``hetero``; ligands if not given)."""
    left = _of_chains(atoms, chains).where("NOT __of").drop("__of")
    if bonds is None:
        return left
    return left.join(attached_ligands(atoms, chains, bonds, F.col("mol_type") == "LIGAND" if hetero is None else hetero), ["structure", "idx"], "left_anti")


def _ends(atoms: DataFrame, bonds: DataFrame, columns: list[str]) -> DataFrame:
    """Bonds with columns of both ends, as ``<column>_1`` and ``<column>_2``."""
    for n in ("1", "2"):
        side = atoms.select("structure", F.col("idx").alias(f"idx_{n}"), *(F.col(c).alias(f"{c}_{n}") for c in columns))
        bonds = bonds.join(side, ["structure", f"idx_{n}"])
    return bonds


def bonded_chains(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure, chain, chain_2, type_2): chains joined by a bond, both ways round."""
    e = _ends(atoms, bonds, ["chain", "mol_type"]).where("chain_1 <> chain_2")
    one = e.select("structure", F.col("chain_1").alias("chain"), "chain_2", F.col("mol_type_2").alias("type_2"))
    return one.union(e.select("structure", "chain_2", "chain_1", "mol_type_1")).distinct()


def cross_chain_bonds(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Bonds between chains."""
    return _ends(atoms, bonds, ["chain"]).where("chain_1 <> chain_2")


def remove_defined_only(atoms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Atoms that a dictionary (res_name, atom_name) of residues has."""
    return atoms.join(dictionary.select("res_name", "atom_name").distinct(), ["res_name", "atom_name"], "left_semi")


def canonical_order(atoms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``position``: an atom's place in its structure when the atoms of each residue follow a dictionary (res_name,
    atom_name, place); those it lacks come last, as given."""
    rows = atoms.join(dictionary.select("res_name", "atom_name", "place"), ["res_name", "atom_name"], "left")
    start = F.min("idx").over(W.partitionBy(*RESIDUE))
    order = W.partitionBy("structure").orderBy("__start", F.col("place").asc_nulls_last(), "idx")
    return rows.withColumn("__start", start).withColumn("position", F.row_number().over(order)).drop("__start", "place")


def remove_terminal_atoms(atoms: DataFrame, protein: tuple[str, ...], nucleic: tuple[str, ...]) -> DataFrame:
    """Without OXT of a protein chain's last residue and OP3 of a nucleic acid chain's first, where that residue is standard:
    others are tokens atom by atom and may have ends. The type of a chain is that of its first atom."""
    w = W.partitionBy(*CHAIN)
    end = F.struct("res_id", "res_name")
    rows = atoms.withColumn("__first", F.min_by(F.struct("mol_type", end.alias("r")), "idx").over(w)).withColumn("__last", F.max_by(end, "idx").over(w))
    oxt = (F.col("__first.mol_type") == "PROTEIN") & F.col("__last.res_name").isin(*protein) & (F.col("res_id") == F.col("__last.res_id")) & (F.col("atom_name") == "OXT")
    op3 = F.col("__first.mol_type").isin("DNA", "RNA") & F.col("__first.r.res_name").isin(*nucleic) & (F.col("res_id") == F.col("__first.r.res_id")) & (F.col("atom_name") == "OP3")
    return rows.where(~F.coalesce(oxt, F.lit(False)) & ~F.coalesce(op3, F.lit(False))).drop("__first", "__last")


def selenium_to_sulfur(atoms: DataFrame) -> DataFrame:
    """Selenomethionine as methionine: residue, atom and element names."""
    mse = F.coalesce(F.col("res_name") == "MSE", F.lit(False))
    se = mse & (F.col("atom_name") == "SE")
    changed = {"atom_name": F.when(se, "SD").otherwise(F.col("atom_name")), "element": F.when(se, "S").otherwise(F.col("element")), "res_name": F.when(mse, "MET").otherwise(F.col("res_name"))}
    return atoms.withColumns(changed)


def fix_arginines(atoms: DataFrame) -> DataFrame:
    """Names NH1 and NH2 of an arginine swapped where NH2 is nearer to CD; of repeated names the first atom counts."""
    w = W.partitionBy(*RESIDUE)
    at = lambda name: F.min_by(F.when(F.col("atom_name") == name, F.struct("x", "y", "z")), F.when(F.col("atom_name") == name, F.col("idx"))).over(w)
    rows = atoms.withColumns({"__cd": at("CD"), "__1": at("NH1"), "__2": at("NH2")})
    far = lambda a: sum((F.col(f"{a}.{c}") - F.col(f"__cd.{c}")) * (F.col(f"{a}.{c}") - F.col(f"__cd.{c}")) for c in "xyz")
    swap = F.coalesce((F.col("res_name") == "ARG") & (far("__2") < far("__1")), F.lit(False))
    name = F.when(swap & (F.col("atom_name") == "NH1"), "NH2").when(swap & (F.col("atom_name") == "NH2"), "NH1").otherwise(F.col("atom_name"))
    return rows.withColumn("atom_name", name).drop("__cd", "__1", "__2")


def atomized_bonds(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Bonds with both ends atomized (``atomized`` of the atoms)."""
    return _ends(atoms, bonds, ["atomized"]).where("atomized_1 AND atomized_2").drop("atomized_1", "atomized_2")


def dative_to_single(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Coordination bonds within a residue as single bonds."""
    e = _ends(atoms, bonds, ["chain", "res_id"])
    within = F.coalesce((F.col("chain_1") == F.col("chain_2")) & (F.col("res_id_1") == F.col("res_id_2")), F.lit(False))
    return e.withColumn("kind", F.when(within & (F.col("kind") == "COORDINATION"), "SINGLE").otherwise(F.col("kind"))).select(*bonds.columns)


def remove_covalent_nonprotein(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Without the chains in which an atom that is no protein's has a covalent bond to another chain's protein; a bond of
    coordination, as of a metal, doesn't count."""
    e = _ends(atoms, bonds.where("kind IS NULL OR kind <> 'COORDINATION'"), ["chain", "mol_type"]).where("chain_1 <> chain_2")
    side = lambda a, b: e.where(f"mol_type_{a} <> 'PROTEIN' AND mol_type_{b} = 'PROTEIN'").select("structure", F.col(f"chain_{a}").alias("chain"))
    return atoms.join(side("1", "2").union(side("2", "1")).distinct(), CHAIN, "left_anti")


def bond_tuples(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Bonds told by chain, residue and atom names of both ends."""
    return _ends(atoms, bonds, ["chain", "res_id", "res_name", "atom_name"])
