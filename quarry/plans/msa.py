"""Alignments over the test tables: twenty parts are the alignment of one sequence, a supplier is a chain, and three
suppliers are a structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import msa
from quarry.sources.tables import read_table

WIDTH, MOST, MOST_PAIRED = 16, 9, 4
PAIRED, MAIN = ("near", "far"), ("main",)
#: The proxy tables, in SQL that Spark and DuckDB read alike. Each fifth chain has no alignment.
ROWS = f"""SELECT p_partkey // 20 AS rep, p_partkey, p_size, p_partkey % 20 AS row, rpad(replace(upper(p_name), ' ', '-'), {WIDTH}, '-') AS aligned,
    CASE WHEN p_partkey % 20 = 0 THEN 'query' WHEN p_size % 3 = 0 THEN 'main' WHEN p_size % 3 = 1 THEN 'far' ELSE 'near' END AS source FROM {{part}}"""
CHAINS = "SELECT s_suppkey // 3 AS structure, s_suppkey % 3 AS chain, CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE s_suppkey // 2 END AS rep FROM {supplier}"
TOKENS = "SELECT s_suppkey // 3 AS structure, s_suppkey % 3 AS chain, i AS token, (s_suppkey + i * i) % 18 + 1 AS residue FROM {supplier} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS v(i)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.sql(ROWS.replace("//", "div"), part=read_table(spark, sf_dir, "part"))
    deletions = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: ((F.col("p_size") + i * F.col("p_partkey")) % 4).cast("int"))
    return table.withColumn("deletions", deletions).drop("p_partkey", "p_size")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CHAINS.replace("//", "div"), supplier=read_table(spark, sf_dir, "supplier"))


def msa_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.row_counts(rows(spark, sf_dir), chains(spark, sf_dir), PAIRED, MAIN, MOST, MOST_PAIRED)


def msa_paired_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired rows of each chain, near ones first."""
    found = msa.in_source_order(msa.for_chains(rows(spark, sf_dir), chains(spark, sf_dir)), msa.CHAIN, PAIRED, MOST_PAIRED)
    return found.select("structure", "chain", "row", "source", "aligned")


def msa_deletion_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean deletions of main rows by column; sequences without any have zeros."""
    r = rows(spark, sf_dir)
    lengths = r.where("source = 'query'").select("rep", F.length("aligned").alias("length"))
    return msa.deletion_means(r.where(F.col("source").isin(*MAIN)), lengths).withColumn("mean", F.round("mean", 6))


def msa_over_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters, deletions and mask of each row of the stack over the tokens of its chain, as strings."""
    r, c = rows(spark, sf_dir), chains(spark, sf_dir)
    counts = msa.row_counts(r, c, PAIRED, MAIN, MOST, MOST_PAIRED)
    tokens = spark.sql(TOKENS.replace("//", "div"), supplier=read_table(spark, sf_dir, "supplier"))
    found = msa.over_tokens(msa.stacked(r, "query", PAIRED, MAIN, MOST, MOST_PAIRED), c, tokens, counts)
    return found.select("structure", "chain", "row", *(F.array_join(x, "").alias(x) for x in ("letters", "deletions", "mask")))


_R, _C, _T = (x.format(part="part", supplier="supplier") for x in (ROWS, CHAINS, TOKENS))
_PLACE = "CASE source WHEN 'near' THEN 1 WHEN 'far' THEN 2 END"
_COUNTS = f"""SELECT structure, CAST(least({MOST}, 1 + least({MOST_PAIRED}, max(p)) + max(m)) AS BIGINT) AS n_rows FROM (
    SELECT structure, chain, count(*) FILTER (source IN ('near', 'far')) AS p, count(*) FILTER (source = 'main') AS m FROM ({_C}) AS c LEFT JOIN ({_R}) AS r USING (rep) GROUP BY 1, 2) GROUP BY 1"""
QUERIES = {f.__name__: f for f in (msa_row_counts, msa_paired_order, msa_deletion_means, msa_over_tokens)}
ORACLE_SQL = {
    "msa_row_counts": _COUNTS,
    "msa_paired_order": f"""
        SELECT structure, chain, row_number() OVER w - 1 AS row, source, aligned FROM ({_C}) AS c JOIN ({_R}) AS r USING (rep) WHERE source IN ('near', 'far')
        WINDOW w AS (PARTITION BY structure, chain ORDER BY {_PLACE}, r.row) QUALIFY row_number() OVER w <= {MOST_PAIRED}""",
    "msa_deletion_means": f"""
        WITH r AS ({_R}), q AS (SELECT rep, unnest(range({WIDTH})) AS "column" FROM r WHERE source = 'query')
        SELECT q.rep, q."column", round(coalesce(avg((r.p_size + q."column" * r.p_partkey) % 4), 0), 6) AS mean FROM q LEFT JOIN r ON q.rep = r.rep AND r.source = 'main' GROUP BY 1, 2""",
    "msa_over_tokens": f"""
        WITH r AS ({_R}), p AS (SELECT *, row_number() OVER (PARTITION BY rep, source IN ('near', 'far') ORDER BY {_PLACE}, row) AS k FROM r),
        s AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY CASE source WHEN 'query' THEN 0 WHEN 'main' THEN 2 ELSE 1 END, {_PLACE}, row) - 1 AS place FROM p WHERE source IN ('query', 'main') OR k <= {MOST_PAIRED}),
        n AS ({_COUNTS}), c AS (SELECT c.*, unnest(range(n_rows)) AS place FROM ({_C}) AS c JOIN n USING (structure)),
        t AS (SELECT c.structure, c.chain, c.place, t.token, t.residue, s.p_size, s.p_partkey, s.aligned, s.aligned IS NOT NULL AND t.residue <= {WIDTH} AS inside
            FROM c JOIN ({_T}) AS t USING (structure, chain) LEFT JOIN s ON s.rep = c.rep AND s.place = c.place)
        SELECT structure, chain, place AS row, string_agg(CASE WHEN inside THEN substr(aligned, CAST(residue AS INT), 1) ELSE '-' END, '' ORDER BY token) AS letters,
            string_agg(CASE WHEN inside THEN CAST((p_size + (residue - 1) * p_partkey) % 4 AS STRING) ELSE '0' END, '' ORDER BY token) AS deletions,
            string_agg(CASE WHEN inside THEN '1' ELSE '0' END, '' ORDER BY token) AS mask FROM t GROUP BY 1, 2, 3""",
}
