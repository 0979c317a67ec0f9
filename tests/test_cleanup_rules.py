"""Rules of clean-up and tokens on hand-made structures; the expected rows are written out."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import cleanup, tokens

ATOM = "structure string, chain string, res_id int, res_name string, atom_name string, mol_type string, occupancy double, idx long"
BOND = "structure string, idx_1 long, idx_2 long, kind string"
P, L, R = "PROTEIN", "LIGAND", "RNA"


@pytest.fixture
def build(spark):
    def make(rows, bonds=()):
        """Atoms as (chain, res_id, res_name, atom_name, type, occupancy), numbered in order; bonds as (i, j) or (i, j, kind)."""
        atoms = spark.createDataFrame([("s", *r, i) for i, r in enumerate(rows)], ATOM)
        return atoms, spark.createDataFrame([("s", b[0], b[1], b[2] if len(b) > 2 else "SINGLE") for b in bonds], BOND)

    return make


def left(frame):
    return sorted(r.idx for r in frame.collect())


def test_covalent_chains_go_but_not_those_of_a_coordinated_metal(build):
    atoms, bonds = build(
        [("A", 1, "ASN", "ND2", P, 1.0), ("A", 2, "HIS", "NE2", P, 1.0), ("B", 1, "NAG", "C1", L, 1.0), ("B", 1, "NAG", "C2", L, 1.0), ("C", 1, "ZN", "ZN", L, 1.0), ("D", 1, "MAN", "C1", L, 1.0), ("E", 1, "CYS", "SG", P, 1.0)],
        [(0, 2), (1, 4, "COORDINATION"), (3, 5), (0, 6)],
    )
    assert left(cleanup.remove_covalent_nonprotein(atoms, bonds)) == [0, 1, 4, 5, 6]  # a sugar on a sugar has no bond to protein


def test_terminal_atoms_by_chain_type_and_last_residue(build):
    rows = [("A", 1, "GLY", "OXT", P, 1.0), ("A", 1, "GLY", "OP3", P, 1.0), ("A", 2, "ALA", "CA", P, 1.0), ("A", 2, "ALA", "OXT", P, 1.0)]
    rows += [("B", 1, "ALA", "OXT", P, 1.0), ("B", 2, "SEP", "CA", P, 1.0), ("B", 2, "SEP", "OXT", P, 1.0)]  # ends in a modified residue
    rows += [("C", 1, "A", "OP3", R, 1.0), ("C", 1, "A", "P", R, 1.0), ("C", 2, "G", "OP3", R, 1.0), ("C", 2, "G", "OXT", R, 1.0)]
    rows += [("D", 1, "PSU", "OP3", R, 1.0), ("E", 1, "GLY", "OXT", L, 1.0)]
    atoms, _ = build(rows)
    assert left(cleanup.remove_terminal_atoms(atoms, ("GLY", "ALA"), ("A", "G"))) == [0, 1, 2, 4, 5, 6, 8, 9, 10, 11, 12]


def test_unresolved_chains_are_not_small(build):
    rows = [("A", i, "GLY", "CA", P, 1.0 if i < 2 else 0.0) for i in range(5)] + [("B", i, "GLY", "CA", P, 0.0) for i in range(5)] + [("C", i, "GLY", "CA", P, 1.0) for i in range(4)]
    atoms, _ = build(rows)
    assert {r.chain for r in cleanup.small_polymer_chains(atoms, 3).collect()} == {"A"}


def test_ligands_connected_through_ligands_go_with_a_chain(build):
    rows = [("A", 1, "ASN", "CA", P, 1.0), ("A", 1, "ASN", "ND2", P, 1.0), ("G", 1, "NAG", "C1", L, 1.0), ("G", 2, "NAG", "C1", L, 1.0), ("H", 1, "MAN", "C1", L, 1.0), ("B", 1, "CYS", "SG", P, 1.0), ("M", 1, "HEM", "FE", L, 1.0), ("W", 1, "FAD", "C", L, 1.0)]
    # a sugar on a sugar on A; B, bonded to A, has a ligand of its own
    atoms, bonds = build(rows, [(0, 1), (1, 2), (2, 3), (3, 4), (1, 5), (5, 6)])
    chains = atoms.where("chain = 'A'").select("structure", "chain").distinct()
    assert left(cleanup.drop_chains(atoms, chains, bonds)) == [5, 6, 7]
    both = atoms.where("chain IN ('A', 'B')").select("structure", "chain").distinct()
    assert left(cleanup.drop_chains(atoms, both, bonds)) == [7]
    # only what hangs on the part of the chain that its first atom belongs to, and nothing on a chain that is all ligand
    cut_off = [b for b in [(1, 2), (2, 3), (3, 4)]]
    assert left(cleanup.drop_chains(*build(rows, cut_off)[:1], chains, build(rows, cut_off)[1])) == [2, 3, 4, 5, 6, 7]
    sugar = atoms.where("chain = 'G'").select("structure", "chain").distinct()
    assert left(cleanup.drop_chains(atoms, sugar, bonds)) == [0, 1, 4, 5, 6, 7] and left(cleanup.drop_chains(atoms, chains)) == [2, 3, 4, 5, 6, 7]
    # a hetero residue inside the chain carries a ligand
    marked = cleanup.drop_chains(atoms, chains, bonds, hetero=F.col("mol_type").eqNullSafe("LIGAND") | (F.col("atom_name") == "ND2"))
    assert left(marked) == [5, 6, 7]
    assert left(cleanup.drop_chains(atoms.limit(0), chains, bonds)) == []


def test_modified_residues_ask_both_ends(build):
    rows = [("A", 1, "GLY", "N", P, 1.0), ("A", 1, "GLY", "C", P, 1.0), ("A", 2, "ALA", "N", P, 1.0), ("B", 1, "MYR", "C1", L, 1.0), ("C", 1, "A", "O3'", R, 1.0), ("C", 2, "G", "P", R, 1.0), ("C", 3, "G", "C5", R, 1.0), ("C", 4, "G", "P", R, 1.0)]
    atoms, bonds = build(rows, [(0, 1), (1, 2), (0, 3), (4, 5), (6, 7)])
    found = {(r.chain, r.res_id) for r in tokens.modified_residues(atoms, bonds).collect()}
    assert found == {("A", 1), ("B", 1), ("C", 3), ("C", 4)}  # a lipid on a backbone's N, and a bond that isn't the backbone's
    made = tokens.tokenize(atoms, ("GLY", "ALA", "A", "G"), tokens.modified_residues(atoms, bonds)).orderBy("idx").collect()
    assert [r.token_id for r in made] == [0, 1, 2, 3, 4, 5, 6, 7] and [r.atomized for r in made] == [True, True, False, True, False, False, True, True]


def test_small_ligands_count_their_ligand_atoms(build):
    rows = [("A", 1, "GLY", "CA", P, 1.0)] * 3 + [("A", 9, "ZN", "ZN", L, 1.0)] + [("B", 1, "HEM", f"C{i}", L, 1.0) for i in range(6)] + [("C", 1, "GLY", "CA", P, 1.0)]
    atoms, _ = build(rows)
    assert {r.chain for r in cleanup.small_ligand_chains(atoms, 5).collect()} == {"A"}


def test_representatives(build):
    rows = [("A", 1, "GLY", "CA", P, 1.0), ("A", 2, "UNK", "CB", P, 1.0), ("A", 3, "ALA", "CA", P, 1.0), ("C", 1, "A", "C4", R, 1.0), ("C", 2, "U", "C2", R, 1.0), ("C", 3, "N", "CB", R, 1.0), ("L", 1, "HEM", "CB", L, 1.0)]
    atoms, _ = build(rows)
    got = atoms.select("idx", tokens.representative(F.col("mol_type"), F.col("res_name"), F.col("atom_name"), F.lit(False)).alias("r")).orderBy("idx").collect()
    assert [r.r for r in got] == [True, True, False, True, True, False, False]


def test_attached_ligands_start_no_job_of_their_own(spark, build):
    """Components are found within a task, not in rounds that each store a table (F2)."""
    rows = [("A", "PROTEIN", 1, "CA"), ("L", "LIGAND", 1, "C1"), ("L", "LIGAND", 2, "C1"), ("B", "PROTEIN", 1, "CA")]
    atoms = spark.createDataFrame([("s", c, r, "X", a, "C", m, 1.0, i) for i, (c, m, r, a) in enumerate(rows)], "structure string, chain string, res_id long, res_name string, atom_name string, element string, mol_type string, occupancy double, idx long")
    bonds = spark.createDataFrame([("s", 0, 1), ("s", 2, 1)], "structure string, idx_1 long, idx_2 long")
    spark.sparkContext.setJobGroup("attached", "attached")
    left = cleanup.drop_chains(atoms, spark.createDataFrame([("s", "A")], "structure string, chain string"), bonds)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("attached")
    spark.sparkContext.setJobGroup("others", "others")
    assert [r.idx for r in left.collect()] == [3]
