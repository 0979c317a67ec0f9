"""Atom tables of mmCIF files, and nested metadata documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.cif import read_category

ATOMS = "file string, atom_idx int, hetero boolean, element string, atom_name string, res_name string, chain_id string, entity_id string, res_id int, x double, y double, z double, occupancy double, b_factor double, auth_chain_id string, model int, alt_id string"
#: Columns of the atom table in the order of ATOMS, from element on.
_COLUMNS = ("type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "auth_asym_id", "pdbx_PDB_model_num", "label_alt_id")


def read_mmcif_atoms(spark: SparkSession, path: str | list[str], model: int = 1) -> DataFrame:
    """The atoms of one model; of alternative places of an atom the one with the highest occupancy."""
    rows = read_category(spark, path, "atom_site", ["group_PDB", *_COLUMNS])
    names = [c.strip().split(" ") for c in ATOMS.split(",")][3:]
    values = [F.col(c).cast(kind).alias(name) for c, (name, kind) in zip(_COLUMNS, names, strict=True)]
    atoms = rows.select("file", F.col("row").cast("int").alias("atom_idx"), (F.col("group_PDB") == "HETATM").alias("hetero"), *values)
    atoms = atoms.where(F.col("model") == model)
    site = ["file", "chain_id", "res_id", "auth_chain_id", "res_name", "atom_name", "hetero"]
    best = atoms.where("alt_id IS NOT NULL").groupBy(*site).agg(F.max_by("atom_idx", F.struct("occupancy", -F.col("atom_idx"))).alias("atom_idx"))
    return atoms.where("alt_id IS NULL").unionByName(atoms.join(best.select("file", "atom_idx"), ["file", "atom_idx"], "left_semi"))


METADATA = """_type string, name string, structure_data map<string, struct<release_date: string, status: string, resolution: double, token_count: int,
chains: map<string, struct<alignment_representative_id: string, template_ids: array<string>, index: int, molecule_type: string>>>>,
reference_molecule_data map<string, struct<conformer_gen_strategy: string, fallback_conformer_pdb_id: string, canonical_smiles: string, set_fallback_to_nan: boolean>>"""


def read_metadata(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structures, chains and reference molecules of a nested metadata document, or (``lines``) of one with a part a line."""
    doc = spark.read.schema(METADATA).json(path, multiLine=not lines)
    structures = doc.select(F.explode("structure_data").alias("structure_id", "s"))
    chains = structures.select("structure_id", F.explode("s.chains").alias("chain_id", "c")).select("structure_id", "chain_id", "c.*")
    molecules = doc.select(F.explode("reference_molecule_data").alias("ref_mol_id", "m")).select("ref_mol_id", "m.*")
    return structures.select("structure_id", "s.release_date", "s.status", "s.resolution", "s.token_count"), chains, molecules


def metadata_parts(name: str, structures: DataFrame, chains: DataFrame, molecules: DataFrame) -> DataFrame:
    """The nested document of three tables, a row for each structure and each molecule: written as JSON, a part a line."""
    c = chains.groupBy("structure_id").agg(F.map_from_entries(F.collect_list(F.struct("chain_id", F.struct("alignment_representative_id", "template_ids", "index", "molecule_type")))).alias("chains"))
    head = [F.lit("metadata").alias("_type"), F.lit(name).alias("name")]
    s = structures.join(c, "structure_id", "left").select(*head, F.create_map("structure_id", F.struct("release_date", "status", "resolution", "token_count", "chains")).alias("structure_data"))
    m = molecules.select(*head, F.create_map("ref_mol_id", F.struct("conformer_gen_strategy", "fallback_conformer_pdb_id", "canonical_smiles", "set_fallback_to_nan")).alias("reference_molecule_data"))
    return s.unionByName(m, allowMissingColumns=True)
