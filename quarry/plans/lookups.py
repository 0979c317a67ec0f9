"""Sequences, scores by type and disorder over lineitems: an order is a structure, its lines are residues or atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import lookups, order
from quarry.operators.durable import dealt
from quarry.sources.tables import read_table

#: The proxy tables, in SQL that Spark and DuckDB read alike.
LINES = """SELECT l_orderkey AS structure, l_suppkey % 2 AS entity, l_suppkey % 4 AS chain, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS number,
    CASE l_partkey % 5 WHEN 0 THEN 'ALA' WHEN 1 THEN 'GLY' WHEN 2 THEN 'ARG' WHEN 3 THEN 'ZZZ' ELSE 'CRO' END AS code,
    CASE l_partkey % 3 WHEN 0 THEN 'PROTEIN' WHEN 1 THEN 'LIGAND' ELSE 'RNA' END AS mol_type, l_discount AS score, l_tax AS area, l_returnflag AS flag FROM {lineitem}"""
LETTERS = (("ALA", "A"), ("GLY", "G"), ("ARG", "R"), ("CRO", "TYG"))
TYPES, THRESHOLD, HALF = ("PROTEIN", "LIGAND", "RNA", "DNA"), 0.041, 2


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES, lineitem=dealt(read_table(spark, sf_dir, "lineitem"), "l_orderkey"))


def entity_code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.entity_codes(lines(spark, sf_dir))
    return found.select("structure", "entity", F.array_join("codes", ",").alias("codes"))


def chain_sequence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of chains by their entities; entities of orders that are not open have none."""
    rows = lines(spark, sf_dir)
    open_ = read_table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("structure"), F.concat(F.lit("SEQ"), "o_orderkey").alias("canonical"))
    entities = rows.select("structure", "entity").distinct().join(open_, "structure")
    letters = spark.createDataFrame(LETTERS, "code string, letter string")
    return lookups.chain_sequences(rows.select("structure", "chain", "entity").distinct(), lookups.entity_sequences(entities, rows, letters))


def score_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.mean_by_type(lines(spark, sf_dir), F.col("score"), TYPES)
    return found.select("structure", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


def structure_disorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share and mean of smoothed values over the residues that were returned; not a number where none was."""
    found = lookups.disorder(lines(spark, sf_dir), "area", HALF, THRESHOLD, F.col("flag") == "R")
    return found.select("structure", F.round("disorder", 6).alias("disorder"), F.round("mean", 6).alias("mean"))


def validation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of orders by their number of lines; those without lines first."""
    counts = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("token_count"))
    return order.positions(orders, ["token_count", "o_orderkey"]).select("o_orderkey", "token_count", "position")


_L = LINES.format(lineitem="lineitem")
QUERIES = {f.__name__: f for f in (entity_code_lists, chain_sequence_lookup, score_by_type, structure_disorder, validation_order)}
ORACLE_SQL = {
    "entity_code_lists": f"SELECT structure, entity, string_agg(code, ',' ORDER BY number) AS codes FROM ({_L}) GROUP BY 1, 2",
    "chain_sequence_lookup": f"""
        WITH l AS ({_L}), e AS (SELECT structure, entity, bool_or(code = 'CRO') AS several, string_agg(CASE code WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'ARG' THEN 'R' ELSE 'X' END, '' ORDER BY number) AS spelled FROM l GROUP BY 1, 2)
        SELECT DISTINCT l.structure, l.chain, CASE WHEN several THEN spelled ELSE 'SEQ' || o_orderkey END AS sequence
        FROM l JOIN e ON l.structure = e.structure AND l.entity = e.entity JOIN orders ON o_orderkey = l.structure WHERE o_orderstatus <> 'F'""",
    "score_by_type": f"SELECT structure, round(avg(score), 6) AS complex, {', '.join(f'''round(avg(score) FILTER (mol_type = '{t}'), 6) AS {t.lower()}''' for t in TYPES)} FROM ({_L}) GROUP BY 1",
    "structure_disorder": f"""
        WITH l AS (SELECT *, row_number() OVER (PARTITION BY structure, chain ORDER BY number) - 1 AS i, count(*) OVER (PARTITION BY structure, chain) AS n FROM ({_L})),
        k AS (SELECT *, greatest(2 * (n - 1), 1) AS period, unnest(range({-HALF}, {HALF + 1})) AS o FROM l),
        p AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE least((((i + o) % period) + period) % period, period - (((i + o) % period) + period) % period) END AS j FROM k),
        s AS (SELECT p.structure, p.chain, p.i, any_value(p.flag) AS flag, avg(q.area) AS v FROM p JOIN l AS q ON q.structure = p.structure AND q.chain = p.chain AND q.i = p.j GROUP BY 1, 2, 3)
        SELECT structure, coalesce(round(avg(CASE WHEN v > {THRESHOLD} THEN 1.0 ELSE 0.0 END) FILTER (flag = 'R'), 6), 'NaN'::DOUBLE) AS disorder, coalesce(round(avg(v) FILTER (flag = 'R'), 6), 'NaN'::DOUBLE) AS mean FROM s GROUP BY 1""",
    "validation_order": """
        WITH c AS (SELECT o_orderkey, count(l_orderkey) AS token_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY token_count, o_orderkey) - 1 AS position FROM c""",
}
