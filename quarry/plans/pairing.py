"""Pairing of rows across the chains of a complex; lines of a supplier stand for rows, line numbers for chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import pairing
from quarry.sources.tables import read_table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_orderkey")
    return rows.withColumn("species", F.concat(F.lit("S"), F.col("l_orderkey") % 12))


def multi_chain_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels from seven chains down to three, residual counts carried on, at most 25 paired rows a supplier and no species
    with more than eight rows in a chain."""
    paired = pairing.pair_rows(lines(spark, sf_dir), "l_suppkey", "l_linenumber", "species", ["l_orderkey"], max_rows=25, min_chains=3, most=8)
    return paired.select("l_suppkey", "l_linenumber", "l_orderkey", "species", "paired_row", "level")


def paired_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains in the paired rows of each supplier, those without a row too."""
    paired = pairing.pair_rows(lines(spark, sf_dir), "l_suppkey", "l_linenumber", "species", ["l_orderkey"], max_rows=25, min_chains=3, most=8)
    full = pairing.with_gaps(paired, "l_suppkey", "l_linenumber", "l_orderkey")
    return full.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n_rows"), F.count("l_orderkey").alias("n_filled"))


def heteromer_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.heteromers(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", F.col("l_linestatus") == "F")


QUERIES = {"multi_chain_pairing": multi_chain_pairing, "paired_with_gaps": paired_with_gaps, "heteromer_suppliers": heteromer_suppliers}

#: The levels one by one: at level n the species of exactly n chains give up their fewest rows, and the rest stays.
_LEVELS = """
    RECURSIVE c AS (SELECT l_suppkey, 'S' || l_orderkey % 12 AS species, l_linenumber AS chain, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
    m AS (SELECT l_suppkey, species, map_from_entries(list((chain, n))) AS left_over FROM c GROUP BY 1, 2 HAVING count(*) > 1 AND max(n) <= 8),
    v AS (SELECT l_suppkey, species, 8 AS level, left_over, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS fewest, CAST([] AS INTEGER[]) AS chains FROM m
        UNION ALL SELECT l_suppkey, species, level - 1,
            map_from_entries(list_transform(map_entries(left_over), lambda e: {'k': e.key, 'v': CASE WHEN e.value > 0 AND has = level - 1 THEN e.value - least_left ELSE e.value END})),
            taken + fewest, CASE WHEN has = level - 1 THEN least_left ELSE 0 END, CASE WHEN has = level - 1 THEN held ELSE [] END
        FROM (SELECT *, len(list_filter(map_values(left_over), lambda x: x > 0)) AS has, coalesce(list_min(list_filter(map_values(left_over), lambda x: x > 0)), 0) AS least_left,
            list_transform(list_filter(map_entries(left_over), lambda e: e.value > 0), lambda e: e.key) AS held FROM v WHERE level > 3)),
    p AS (SELECT l_suppkey, species, level, taken + i AS k, chains FROM v, LATERAL (SELECT unnest(range(1, fewest + 1)) AS i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY level DESC, species, k) - 1 AS paired_row FROM p QUALIFY paired_row < 25),
    o AS (SELECT l_suppkey, l_linenumber, l_orderkey, 'S' || l_orderkey % 12 AS species, row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_orderkey % 12 ORDER BY l_orderkey) AS k FROM lineitem),
    x AS (SELECT l_suppkey, l_linenumber, l_orderkey, species, paired_row, level FROM (SELECT * EXCLUDE chains, unnest(chains) AS l_linenumber FROM r) JOIN o USING (l_suppkey, l_linenumber, species, k))"""
ORACLE_SQL = {
    "multi_chain_pairing": f"WITH {_LEVELS} SELECT l_suppkey, l_linenumber, l_orderkey, species, paired_row, CAST(level AS BIGINT) AS level FROM x",
    "paired_with_gaps": f"""WITH {_LEVELS}, n AS (SELECT l_suppkey, count(DISTINCT paired_row) AS n_rows FROM x GROUP BY 1)
        SELECT l_suppkey, l_linenumber, any_value(n_rows) AS n_rows, count(*) AS n_filled FROM x JOIN n USING (l_suppkey) GROUP BY 1, 2""",
    "heteromer_suppliers": "SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1",
}
