"""Structure clean-up and tokens over lineitems as atoms: an order is a structure, its lines are atoms, the supplier gives
the chain, the line number the residue, and part and quantity the names. Bonds join atoms that follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import records
from quarry.operators import cleanup, tokens
from quarry.operators.durable import stored
from quarry.operators.durable import dealt
from quarry.sources.tables import read_table

#: The proxy tables, in SQL that Spark and DuckDB read alike.
ATOMS = """SELECT l_orderkey AS structure, l_suppkey % 3 AS chain, l_linenumber AS res_id,
    CASE l_partkey % 8 WHEN 0 THEN 'HOH' WHEN 1 THEN 'UNK' WHEN 2 THEN 'MSE' WHEN 3 THEN 'GLY' WHEN 4 THEN 'ARG' WHEN 5 THEN 'ARG' WHEN 6 THEN 'ALA' ELSE 'DOD' END AS res_name,
    CASE CAST(l_quantity AS INT) % 11 WHEN 0 THEN 'CA' WHEN 1 THEN 'SE' WHEN 2 THEN 'OXT' WHEN 3 THEN 'CD' WHEN 4 THEN 'NH1' WHEN 5 THEN 'NH2' WHEN 6 THEN 'N' WHEN 7 THEN 'C' WHEN 8 THEN 'P' WHEN 9 THEN 'OP3' ELSE 'CB' END AS atom_name,
    CASE CAST(l_quantity AS INT) % 9 WHEN 0 THEN 'H' WHEN 1 THEN 'SE' WHEN 2 THEN 'D' ELSE 'C' END AS element,
    CASE l_suppkey % 3 WHEN 0 THEN 'PROTEIN' WHEN 1 THEN 'LIGAND' ELSE 'RNA' END AS mol_type, l_tax AS occupancy, l_extendedprice AS x, l_discount AS y, l_tax AS z,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax) AS idx FROM {lineitem}"""
BONDS = "SELECT structure, idx AS idx_1, idx + 1 AS idx_2, CASE WHEN idx % 3 = 0 THEN 'COORDINATION' ELSE 'SINGLE' END AS kind FROM ({atoms}) AS a"
STANDARD, NUCLEIC = ("GLY", "ARG", "ALA"), ("ARG", "ALA")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ATOMS, lineitem=dealt(read_table(spark, sf_dir, "lineitem"), "l_orderkey"))


def atoms_and_bonds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = atoms(spark, sf_dir)
    return a, bonds_between(a)


def bonds_between(a: DataFrame) -> DataFrame:
    """Bonds of atoms that follow each other; the last atom's leads nowhere."""
    return a.select("structure", F.col("idx").alias("idx_1"), (F.col("idx") + 1).alias("idx_2"), F.when(F.col("idx") % 3 == 0, "COORDINATION").otherwise("SINGLE").alias("kind"))


def dictionary(a: DataFrame) -> DataFrame:
    """Atoms of each residue, all but OXT, placed against the alphabet."""
    from pyspark.sql import Window as W

    known = a.where("atom_name <> 'OXT'").select("res_name", "atom_name").distinct()
    return known.withColumn("place", F.row_number().over(W.partitionBy("res_name").orderBy(F.desc("atom_name"))))


def atom_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms without waters, hydrogens and glycines, with arginines and selenomethionines renamed."""
    a = cleanup.selenium_to_sulfur(cleanup.fix_arginines(atoms(spark, sf_dir)))
    return cleanup.remove_residues(cleanup.remove_hydrogens(cleanup.remove_waters(a)), ("GLY",)).select("structure", "idx", "res_name", "atom_name", "element")


def polymer_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms without small and unknown polymer chains and the ligand atoms connected with them."""
    a = stored(atoms(spark, sf_dir).select("structure", "chain", "res_id", "res_name", "mol_type", "occupancy", "idx"), "atoms")
    bonds = bonds_between(a)
    gone = cleanup.small_polymer_chains(a, 1).union(cleanup.unknown_polymer_chains(a)).distinct()
    return cleanup.drop_chains(a, gone, bonds).select("structure", "idx")


def small_ligands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.small_ligand_mask(atoms(spark, sf_dir), 2).select("structure", "idx", "small_ligand")


def covalent_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.remove_covalent_nonprotein(*atoms_and_bonds(spark, sf_dir)).select("structure", "idx")


def defined_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms that the dictionary has, placed in its order."""
    a = atoms(spark, sf_dir)
    words = dictionary(a)
    return cleanup.canonical_order(cleanup.remove_defined_only(a, words), words).select("structure", "idx", F.col("position").cast("bigint").alias("position"))


def terminal_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.remove_terminal_atoms(atoms(spark, sf_dir), STANDARD, NUCLEIC).select("structure", "idx")


def single_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.dative_to_single(*atoms_and_bonds(spark, sf_dir)).select("structure", "idx_1", "kind")


def bond_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds by the names of their ends, and whether they join two chains."""
    b = cleanup.bond_tuples(*atoms_and_bonds(spark, sf_dir))
    return b.select("structure", "idx_1", "res_name_1", "atom_name_1", "res_name_2", "atom_name_2", (F.col("chain_1") != F.col("chain_2")).alias("across"))


def atom_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens.positions(tokens.tokenize(atoms(spark, sf_dir), STANDARD))
    return t.select("structure", "idx", "token_id", "atomized", "center", "token_position", "residue_index", "chain_run")


def structure_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(tokens.tokenize(atoms(spark, sf_dir), STANDARD))


def token_bond_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, bonds = atoms_and_bonds(spark, sf_dir)
    return tokens.token_bonds(tokens.tokenize(a, STANDARD), bonds)


def atomized_bond_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, bonds = atoms_and_bonds(spark, sf_dir)
    return cleanup.atomized_bonds(tokens.tokenize(a, STANDARD), bonds).select("structure", "idx_1")


def token_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each atom's number in its token, and whether it represents the token."""
    t = tokens.atom_offsets(tokens.tokenize(atoms(spark, sf_dir), STANDARD))
    return t.select("structure", "idx", "offset", tokens.representative(F.col("mol_type"), F.col("res_name"), F.col("atom_name"), F.col("atomized")).alias("representative"))


def token_atoms_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of each unmasked token; tokens padded to nine a structure."""
    t = tokens.tokenize(atoms(spark, sf_dir), STANDARD)
    counts = t.groupBy("structure", "token_id").agg(F.count("*").alias("n_atoms"), F.bool_or("center").alias("mask"))
    counts = tokens.padded(counts, 9, {"n_atoms": 1, "mask": False})
    n = tokens.atom_to_token(counts).groupBy("structure").agg(F.count("*").alias("atoms"), F.max("atom").alias("last"))
    return counts.groupBy("structure").agg(F.count("*").alias("tokens"), F.count_if("mask").alias("real")).join(n, "structure", "left").na.fill({"atoms": 0, "last": -1})


def standard_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.standard_residue_starts(atoms(spark, sf_dir), STANDARD).select("structure", "idx")


def modified_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.modified_residues(*atoms_and_bonds(spark, sf_dir))


def modified_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens where residues with unusual bonds are taken apart as well."""
    a, bonds = atoms_and_bonds(spark, sf_dir)
    return tokens.tokenize(a, STANDARD, tokens.modified_residues(a, bonds)).select("structure", "idx", "token_id", "atomized", "center")


def record_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as aligned strings, and their numbers as texts."""
    c, segment = read_table(spark, sf_dir, "customer"), F.col("c_mktsegment")
    gapped = F.translate(segment, "IO", "--")
    return c.select(
        "c_custkey",
        records.is_integer_like(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(segment)).alias("integer"),
        records.with_unknown(segment, {"BUILDING": 1, "MACHINERY": 2}, 0).alias("code"),
        F.array_join(records.letter_indices(gapped, "ABCDEFGHX", "X"), ",").alias("letters"),
        F.array_join(records.residue_numbers(gapped, F.lit(5)), ",").alias("numbers"),
        records.first_number(F.when(F.col("c_custkey") % 3 == 0, "?").otherwise(F.col("c_custkey").cast("string")), F.lit("2.5")).alias("resolution"),
        records.relative_accessibility(F.col("c_custkey").cast("double"), F.when(F.col("c_custkey") % 2 == 0, 200.0)).alias("accessible"),
        records.fails_legacy_sequence_check(F.lit(100), F.col("c_custkey") % 100, F.col("c_custkey") % 40).alias("fails"),
    )


QUERIES = {f.__name__: f for f in (
    atom_cleanup, polymer_cleanup, small_ligands, covalent_cleanup, defined_atoms, terminal_atoms, single_bonds, bond_records, atom_tokens, structure_token_counts,
    token_bond_pairs, atomized_bond_pairs, token_representatives, token_atoms_padded, standard_starts, modified_residues, modified_tokens, record_functions,
)}

_A = f"atoms AS ({ATOMS.format(lineitem='lineitem')}), bonds AS ({BONDS.format(atoms='SELECT * FROM atoms')})"
_E = "e AS (SELECT b.*, p.chain AS chain_1, q.chain AS chain_2, p.res_id AS res_id_1, q.res_id AS res_id_2, p.res_name AS res_name_1, q.res_name AS res_name_2, p.atom_name AS atom_name_1, q.atom_name AS atom_name_2, p.mol_type AS mol_type_1, q.mol_type AS mol_type_2 FROM bonds b JOIN atoms p ON p.structure = b.structure AND p.idx = idx_1 JOIN atoms q ON q.structure = b.structure AND q.idx = idx_2)"
_WHOLE = "(mol_type IN ('PROTEIN', 'DNA', 'RNA') AND res_name IN ('GLY', 'ARG', 'ALA'))"
_T = f"""s AS (SELECT *, NOT {_WHOLE} AS atomized, lag(chain) OVER o IS DISTINCT FROM chain AS new_chain, lag(chain) OVER o IS DISTINCT FROM chain OR lag(res_id) OVER o IS DISTINCT FROM res_id OR lag(res_name) OVER o IS DISTINCT FROM res_name AS new_res FROM atoms WINDOW o AS (PARTITION BY structure ORDER BY idx)),
    t AS (SELECT *, atomized OR atom_name = 'CA' AS center, CAST(count(*) FILTER (atomized OR new_res) OVER o AS BIGINT) - 1 AS token_id, CAST(count(*) FILTER (new_res) OVER o AS BIGINT) - 1 AS residue_index, CAST(count(*) FILTER (new_chain) OVER o AS BIGINT) AS chain_run
        FROM s WINDOW o AS (PARTITION BY structure ORDER BY idx ROWS UNBOUNDED PRECEDING))"""
_M = """f AS (SELECT * FROM e WHERE (chain_1 <> chain_2 OR res_id_1 <> res_id_2) AND NOT (atom_name_1 IN ('N', 'C') AND atom_name_2 IN ('N', 'C')) AND NOT (atom_name_1 = 'P' AND atom_name_2 = 'P')),
    m AS (SELECT structure, chain_1 AS chain, res_id_1 AS res_id FROM f UNION SELECT structure, chain_2, res_id_2 FROM f)"""
_FAR = "(({a}.x - cd.x) * ({a}.x - cd.x) + ({a}.y - cd.y) * ({a}.y - cd.y) + ({a}.z - cd.z) * ({a}.z - cd.z))"

ORACLE_SQL = {
    "atom_cleanup": f"""
        WITH {_A}, n AS (SELECT *, arg_min({{'x': x, 'y': y, 'z': z}}, idx) FILTER (atom_name = 'CD') OVER w AS cd, arg_min({{'x': x, 'y': y, 'z': z}}, idx) FILTER (atom_name = 'NH1') OVER w AS n1,
            arg_min({{'x': x, 'y': y, 'z': z}}, idx) FILTER (atom_name = 'NH2') OVER w AS n2 FROM atoms WINDOW w AS (PARTITION BY structure, chain, res_id)),
        r AS (SELECT * EXCLUDE (atom_name), CASE WHEN res_name = 'ARG' AND {_FAR.format(a='n2')} < {_FAR.format(a='n1')} AND atom_name IN ('NH1', 'NH2') THEN CASE atom_name WHEN 'NH1' THEN 'NH2' ELSE 'NH1' END ELSE atom_name END AS atom_name FROM n),
        m AS (SELECT structure, idx, CASE res_name WHEN 'MSE' THEN 'MET' ELSE res_name END AS res_name, CASE WHEN res_name = 'MSE' AND atom_name = 'SE' THEN 'SD' ELSE atom_name END AS atom_name, CASE WHEN res_name = 'MSE' AND atom_name = 'SE' THEN 'S' ELSE element END AS element FROM r)
        SELECT * FROM m WHERE res_name NOT IN ('HOH', 'DOD', 'GLY') AND element NOT IN ('H', 'D')""",
    # all atoms of a structure are one path, on which the ligand chain lies between the others
    "polymer_cleanup": f"""
        WITH {_A}, n AS (SELECT structure, chain, count(DISTINCT res_id) FILTER (occupancy > 0) AS n, bool_and(res_name = 'UNK') AS unknown FROM atoms WHERE mol_type <> 'LIGAND' GROUP BY 1, 2),
        g AS (SELECT structure, chain FROM n WHERE n = 1 OR unknown)
        SELECT structure, idx FROM atoms WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.structure = atoms.structure AND (g.chain = atoms.chain OR mol_type = 'LIGAND'))""",
    "small_ligands": f"WITH {_A} SELECT structure, idx, count(*) FILTER (mol_type = 'LIGAND') OVER (PARTITION BY structure, chain) BETWEEN 1 AND 2 AS small_ligand FROM atoms",
    "covalent_cleanup": f"""
        WITH {_A}, {_E}, k AS (SELECT * FROM e WHERE chain_1 <> chain_2 AND kind <> 'COORDINATION' AND (mol_type_1 = 'PROTEIN') <> (mol_type_2 = 'PROTEIN')),
        c AS (SELECT structure, CASE WHEN mol_type_1 = 'PROTEIN' THEN chain_2 ELSE chain_1 END AS chain FROM k)
        SELECT structure, idx FROM atoms ANTI JOIN c USING (structure, chain)""",
    "defined_atoms": f"""
        WITH {_A}, k AS (SELECT DISTINCT res_name, atom_name FROM atoms WHERE atom_name <> 'OXT'), p AS (SELECT *, row_number() OVER (PARTITION BY res_name ORDER BY atom_name DESC) AS place FROM k),
        r AS (SELECT structure, idx, place, min(idx) OVER (PARTITION BY structure, chain, res_id) AS start FROM atoms JOIN p USING (res_name, atom_name))
        SELECT structure, idx, row_number() OVER (PARTITION BY structure ORDER BY start, place, idx) AS position FROM r""",
    "terminal_atoms": f"""
        WITH {_A}, l AS (SELECT structure, chain, res_id, res_name, mol_type FROM atoms QUALIFY row_number() OVER (PARTITION BY structure, chain ORDER BY idx DESC) = 1),
        f AS (SELECT structure, chain, res_id, res_name, mol_type FROM atoms QUALIFY row_number() OVER (PARTITION BY structure, chain ORDER BY idx) = 1)
        SELECT a.structure, idx FROM atoms a JOIN l USING (structure, chain) JOIN f USING (structure, chain)
        WHERE NOT (a.atom_name = 'OXT' AND a.res_id = l.res_id AND f.mol_type = 'PROTEIN' AND l.res_name IN ('GLY', 'ARG', 'ALA')) AND NOT (a.atom_name = 'OP3' AND a.res_id = f.res_id AND f.mol_type IN ('RNA', 'DNA') AND f.res_name IN ('ARG', 'ALA'))""",
    "single_bonds": f"WITH {_A}, {_E} SELECT structure, idx_1, CASE WHEN chain_1 = chain_2 AND res_id_1 = res_id_2 THEN 'SINGLE' ELSE kind END AS kind FROM e",
    "bond_records": f"WITH {_A}, {_E} SELECT structure, idx_1, res_name_1, atom_name_1, res_name_2, atom_name_2, chain_1 <> chain_2 AS across FROM e",
    "atom_tokens": f"WITH {_A}, {_T} SELECT structure, idx, token_id, atomized, center, dense_rank() OVER (PARTITION BY structure ORDER BY token_id) - 1 AS token_position, residue_index, chain_run FROM t",
    "structure_token_counts": f"WITH {_A}, {_T}, n AS (SELECT structure, token_id, count(*) AS n FROM t GROUP BY 1, 2) SELECT structure, count(*) AS tokens, CAST(sum(n) AS BIGINT) AS atoms, max(n) AS most FROM n GROUP BY 1",
    "token_bond_pairs": f"""
        WITH {_A}, {_T}, p AS (SELECT b.structure, x.token_id AS a, y.token_id AS b FROM bonds b JOIN t x ON x.structure = b.structure AND x.idx = idx_1 JOIN t y ON y.structure = b.structure AND y.idx = idx_2 WHERE x.atomized AND y.atomized AND x.token_id <> y.token_id)
        SELECT structure, a AS token_1, b AS token_2 FROM p UNION SELECT structure, b, a FROM p""",
    "atomized_bond_pairs": f"WITH {_A}, {_T} SELECT b.structure, idx_1 FROM bonds b JOIN t x ON x.structure = b.structure AND x.idx = idx_1 JOIN t y ON y.structure = b.structure AND y.idx = idx_2 WHERE x.atomized AND y.atomized",
    "token_representatives": f"""
        WITH {_A}, {_T} SELECT structure, idx, row_number() OVER (PARTITION BY structure, token_id ORDER BY idx) - 1 AS "offset", atomized OR (mol_type = 'PROTEIN' AND atom_name = CASE res_name WHEN 'GLY' THEN 'CA' ELSE 'CB' END) AS representative FROM t""",
    "token_atoms_padded": f"""
        WITH {_A}, {_T}, c AS (SELECT structure, token_id, count(*) AS n, bool_or(center) AS mask FROM t GROUP BY 1, 2)
        SELECT structure, CAST(9 AS BIGINT) AS tokens, count(*) FILTER (mask) AS real, CAST(coalesce(sum(n) FILTER (mask), 0) AS BIGINT) AS atoms, CAST(coalesce(sum(n) FILTER (mask), 0) AS BIGINT) - 1 AS last FROM c WHERE token_id < 9 GROUP BY 1""",
    "standard_starts": f"WITH {_A}, {_T} SELECT structure, idx FROM t WHERE new_res AND {_WHOLE}",
    "modified_residues": f"WITH {_A}, {_E}, {_M} SELECT * FROM m",
    "modified_tokens": f"""
        WITH {_A}, {_E}, {_M}, q AS (SELECT a.*, NOT {_WHOLE} OR m.res_id IS NOT NULL AS atomized FROM atoms a LEFT JOIN m USING (structure, chain, res_id)),
        s AS (SELECT *, lag(chain) OVER o IS DISTINCT FROM chain OR lag(res_id) OVER o IS DISTINCT FROM res_id OR lag(res_name) OVER o IS DISTINCT FROM res_name AS new_res FROM q WINDOW o AS (PARTITION BY structure ORDER BY idx))
        SELECT structure, idx, CAST(count(*) FILTER (atomized OR new_res) OVER (PARTITION BY structure ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS token_id, atomized, atomized OR atom_name = 'CA' AS center FROM s""",
    "record_functions": """
        WITH c AS (SELECT *, translate(c_mktsegment, 'IO', '--') AS g FROM customer), l AS (SELECT *, string_split(g, '') AS s FROM c)
        SELECT c_custkey, c_custkey % 2 = 0 AS integer, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code,
            array_to_string(list_transform(s, lambda x: CASE WHEN x = '-' THEN 9 WHEN instr('ABCDEFGHX', x) > 0 THEN instr('ABCDEFGHX', x) - 1 ELSE 8 END), ',') AS letters,
            array_to_string(list_transform(s, lambda x, i: CASE WHEN x = '-' THEN -1 ELSE 4 + len(list_filter(s[1:i], lambda y: y <> '-')) END), ',') AS numbers,
            CAST(CASE WHEN c_custkey % 3 = 0 THEN 2.5 ELSE c_custkey END AS DOUBLE) AS resolution, greatest(0.0, least(1.0, c_custkey / CASE WHEN c_custkey % 2 = 0 THEN 200.0 ELSE 113.0 END)) AS accessible,
            c_custkey % 100 / 100 > 0.95 OR c_custkey % 40 / 100 < 0.1 OR c_custkey % 100 < 10 AS fails FROM l""",
}
