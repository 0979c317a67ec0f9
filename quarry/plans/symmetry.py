"""Symmetric molecules; lines of a supplier stand for chains, and lines that follow each other are bonded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators import symmetry
from quarry.sources.tables import read_table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of a supplier with their number of atoms, first atom, and the chain that follows if it is bonded."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("structure"), *LINE, "l_returnflag", "l_linestatus")
    w = W.partitionBy("structure").orderBy(*LINE)
    rows = rows.withColumn("atoms", 1 + F.col("l_linenumber") % 2).withColumn("chain", F.row_number().over(w).cast("bigint"))
    rows = rows.withColumn("first", F.sum("atoms").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("atoms"))
    after = F.lead(F.struct("first", "atoms", "l_orderkey")).over(w)
    return rows.withColumn("after", F.when((F.col("l_orderkey") + after["l_orderkey"]) % 3 == 0, after))


def atoms_and_bonds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Atoms by chain, and bonds between the last atoms of chains that follow each other."""
    rows = chains(spark, sf_dir)
    own = rows.select("structure", "chain", "first", "l_returnflag", "l_linestatus", F.explode(F.sequence(F.lit(0), F.col("atoms") - 1)).alias("i"))
    atoms = own.select("structure", "chain", (F.col("first") + F.col("i")).alias("atom"), F.concat(F.lit("C"), F.col("i")).alias("atom_name"), F.col("l_linestatus").alias("res_name"), F.col("l_returnflag").alias("entity"))
    last = lambda c: F.col(f"{c}first") + F.col(f"{c}atoms") - 1
    bonds = rows.where("after IS NOT NULL").select("structure", last("").alias("atom_1"), last("after.").alias("atom_2"))
    return atoms, bonds


def molecule_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecular entities, instances and places of chains."""
    return symmetry.symmetric_molecules(*atoms_and_bonds(spark, sf_dir))


QUERIES = {"molecule_symmetry": molecule_symmetry}

#: These molecules are paths, so a graph is its chains read forwards or backwards, whichever comes first.
ORACLE_SQL = {
    "molecule_symmetry": """
        WITH c AS (SELECT l_suppkey AS structure, l_orderkey AS o, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS chain, 1 + l_linenumber % 2 AS atoms, l_returnflag AS entity, l_returnflag || l_linestatus || (1 + l_linenumber % 2) AS label FROM lineitem),
        f AS (SELECT *, sum(atoms) OVER (PARTITION BY structure ORDER BY chain ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - atoms AS first, coalesce((o + lag(o) OVER (PARTITION BY structure ORDER BY chain)) % 3 <> 0, true) AS begins FROM c),
        g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY structure ORDER BY chain ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f),
        m AS (SELECT structure, run, CAST(min(first) AS BIGINT) AS molecule, array_to_string(list_sort(list(DISTINCT entity)), ',') AS entities, sum(atoms) AS size, array_to_string(list(label ORDER BY first), ' ') AS forward, array_to_string(list(label ORDER BY first DESC), ' ') AS back FROM g GROUP BY 1, 2),
        k AS (SELECT *, least(forward, back) AS kind, min(molecule) OVER (PARTITION BY structure, entities, size) AS first_group, min(molecule) OVER (PARTITION BY structure, entities, size, least(forward, back)) AS first_one,
            first_value(forward) OVER (PARTITION BY structure, entities, size, least(forward, back) ORDER BY molecule) AS model FROM m),
        e AS (SELECT *, dense_rank() OVER (PARTITION BY structure ORDER BY first_group, first_one) AS mol_entity_id, row_number() OVER (PARTITION BY structure, first_one ORDER BY molecule) AS mol_sym_id FROM k),
        o AS (SELECT *, row_number() OVER (PARTITION BY structure, run ORDER BY first) - 1 AS own, count(*) OVER (PARTITION BY structure, run) AS n FROM g)
        SELECT structure, chain, molecule, mol_entity_id, mol_sym_id, CASE WHEN forward = model THEN own ELSE n - 1 - own END AS slot FROM o JOIN e USING (structure, run)""",
}
