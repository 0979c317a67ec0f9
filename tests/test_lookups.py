"""Sequences of entities, scores by type and disorder, on hand-made rows with nulls and empty tables."""

import math

from pyspark.sql import functions as F

from quarry.operators import lookups, order

RESIDUES = [(1, 1, 2, "GLY"), (1, 1, 1, "ALA"), (1, 2, 1, "CRO"), (1, 2, 2, "ALA"), (1, 2, 3, "???"), (2, 1, 1, None)]


def test_sequences(spark):
    residues = spark.createDataFrame(RESIDUES, "structure long, entity long, number int, code string")
    entities = spark.createDataFrame([(1, 1, "AG"), (1, 2, "TYGA?"), (2, 1, "K"), (3, 1, "none")], "structure long, entity long, canonical string")
    letters = spark.createDataFrame([("ALA", "A"), ("GLY", "G"), ("CRO", "TYG")], "code string, letter string")
    codes = {(r.structure, r.entity): r.codes for r in lookups.entity_codes(residues).collect()}
    assert codes == {(1, 1): ["ALA", "GLY"], (1, 2): ["CRO", "ALA", "???"], (2, 1): [None]}
    found = lookups.entity_sequences(entities, residues, letters)
    assert {(r.structure, r.entity): r.sequence for r in found.collect()} == {(1, 1): "AG", (1, 2): "XAX", (2, 1): "K", (3, 1): "none"}
    chains = spark.createDataFrame([(1, "A", 1), (1, "B", 1), (1, "C", 9), (2, "A", None)], "structure long, chain string, entity long")
    assert sorted((r.chain, r.sequence) for r in lookups.chain_sequences(chains, found).collect()) == [("A", "AG"), ("B", "AG")]
    assert lookups.entity_sequences(entities.limit(0), residues, letters).count() == 0


def test_means(spark):
    atoms = spark.createDataFrame([(1, "RNA", 1.0), (1, "DNA", 2.0), (1, None, 6.0), (1, "RNA", None)], "structure long, mol_type string, s double")
    r = lookups.mean_by_type(atoms, F.col("s"), ("RNA", "LIGAND")).first()
    assert (r["complex"], r.rna, r.ligand) == (3.0, 1.0, None)


def test_disorder(spark):
    rows = spark.createDataFrame([(1, "A", i, float(i), i > 2) for i in range(1, 5)] + [(2, "A", 1, 5.0, None)], "structure long, chain string, number int, v double, resolved boolean")
    every = {r.structure: (r.disorder, r["mean"]) for r in lookups.disorder(rows, "v", 0, 2.5).collect()}
    assert every == {1: (0.5, 2.5), 2: (1.0, 5.0)}
    some = {r.structure: (r.disorder, r["mean"]) for r in lookups.disorder(rows, "v", 0, 3.5, F.col("resolved")).collect()}
    assert some[1] == (0.5, 3.5) and all(map(math.isnan, some[2]))


def test_positions_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(3, "x", 7), (1, "y", None), (2, None, 9)], "id int, part string, running int")
    got = order.positions(rows, ["id"]).orderBy("id").collect()
    assert [(r.id, r.part, r.running, r.position) for r in got] == [(1, "y", None, 0), (2, None, 9, 1), (3, "x", 7, 2)]
