"""Templates over the test tables: an order is a query, its lines are hits in the order of their numbers, a part is an
entry of three chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.sequences import identity_and_coverage
from quarry.operators import templates
from quarry.sources.tables import read_table

#: The proxy tables, in SQL that Spark and DuckDB read alike.
HITS = """SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS index,
    l_partkey AS entry, CAST(l_suppkey % 3 AS STRING) AS chain, CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'widget' WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'small' ELSE 'STANDARD' END AS sequence,
    l_discount * 10 AS identity, l_tax * 10 AS coverage, CAST(l_shipdate AS DATE) AS query_released FROM {lineitem}"""
CHAINS = "SELECT p_partkey AS entry, c AS chain, CAST(c AS INT) AS place, CASE WHEN (p_partkey + CAST(c AS INT)) % 2 = 0 THEN p_name ELSE p_type END AS sequence FROM {part} CROSS JOIN (VALUES ('0'), ('1'), ('2')) AS v(c)"
MAPS = """SELECT l_orderkey AS query, l_suppkey % 2 AS entry, CASE WHEN l_quantity % 5 = 0 THEN -1 ELSE l_linenumber END AS q, CASE WHEN l_quantity % 7 = 0 THEN -1 ELSE CAST(l_partkey % 40 AS INT) END AS t FROM {lineitem}"""
TOKENS = "SELECT l_orderkey AS query, l_linenumber AS residue, l_partkey % 10 AS token FROM {lineitem} WHERE l_discount > 0.02"
RESIDUES = "SELECT p_partkey % 2 AS entry, CAST(p_partkey AS INT) AS residue FROM {part} WHERE p_partkey < 36 UNION ALL SELECT 0 AS entry, 5 AS residue"
SEED, MOST, LATEST, DAYS = 11, 4, "2001-01-01", 60


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HITS, lineitem=read_table(spark, sf_dir, "lineitem"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release date of each part, on a day that its number gives."""
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 2500).cast("int")).alias("released"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CHAINS, part=read_table(spark, sf_dir, "part"))


def template_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four hits of each query that pass the checks of sequence and release and are held by a chain."""
    fine = hits(spark, sf_dir).where(~templates.fails_sequence_checks(F.col("identity"), F.col("coverage"), F.length("sequence"), 0.95, 0.1, 6))
    dated = fine.join(entries(spark, sf_dir), "entry").where(~templates.fails_release_checks(F.col("released"), F.col("query_released"), LATEST, DAYS))
    found = templates.first_templates(templates.matched_chains(dated, chains(spark, sf_dir), ["query", "index"]), MOST)
    return found.select("query", "index", "entry", "chain", "remapped", "rank")


def template_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits of each query that have a structure."""
    there = read_table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("entry"))
    return templates.sampled_templates(hits(spark, sf_dir), there, 2, True).select("query", "index", "entry")


def template_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random number of hits of each query, of those that have a structure."""
    there = read_table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("entry"))
    return templates.sampled_templates(hits(spark, sf_dir), there, MOST, False, SEED).select("query", "index", "entry")


def template_index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues of the names of parts against those of their types, padded with gaps to equal length; the vowels and
    spaces of the first are gaps."""
    name, kind = F.translate(F.upper("p_name"), " AEIOU", "------"), F.translate(F.upper("p_type"), "NM", "--")
    width = F.greatest(F.length(name), F.length(kind))
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.rpad(name, width, F.lit("-")).alias("a"), F.rpad(kind, width, F.lit("-")).alias("b"))
    identity, coverage = identity_and_coverage(F.col("a"), F.col("b"))
    pairs = rows.select("p_partkey", F.round(identity, 6).alias("identity"), F.round(coverage, 6).alias("coverage"), F.explode(templates.index_map(F.col("a"), F.col("b"), F.lit(1), F.lit(10))).alias("p"))
    return pairs.select("p_partkey", "identity", "coverage", "p.q", "p.t")


def template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of orders with the residue of each template."""
    lines, part = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    return templates.tokens_to_template(spark.sql(MAPS, lineitem=lines), spark.sql(TOKENS, lineitem=lines), spark.sql(RESIDUES, part=part))


def _sql(text: str) -> str:
    return text.format(lineitem="lineitem", part="part")


def _md5(*columns: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(columns)}))"


_THERE = f"t AS (SELECT h.* FROM ({_sql(HITS)}) AS h SEMI JOIN (SELECT * FROM part WHERE p_size > 10) p ON entry = p_partkey)"
QUERIES = {f.__name__: f for f in (template_selection, template_top, template_sample, template_index_map, template_tokens)}
ORACLE_SQL = {
    "template_selection": f"""
        WITH h AS (SELECT h.*, DATE '1995-01-01' + CAST(p_partkey % 2500 AS INT) AS released FROM ({_sql(HITS)}) AS h JOIN part ON entry = p_partkey),
        f AS (SELECT * FROM h WHERE identity <= 0.95 AND coverage >= 0.1 AND length(sequence) >= 6 AND query_released - released >= {DAYS} AND released <= DATE '{LATEST}'),
        m AS (SELECT f.query, f.index, f.entry, c.chain, f.chain <> c.chain AS remapped FROM f JOIN ({_sql(CHAINS)}) AS c ON f.entry = c.entry AND contains(c.sequence, f.sequence)
            QUALIFY row_number() OVER (PARTITION BY f.query, f.index ORDER BY f.chain <> c.chain, c.place) = 1)
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY index) AS rank FROM m QUALIFY rank <= {MOST}""",
    "template_top": f"WITH {_THERE} SELECT query, index, entry FROM t QUALIFY row_number() OVER (PARTITION BY query ORDER BY index) <= 2",
    "template_sample": f"""
        WITH {_THERE}, n AS (SELECT query, least({MOST}, CAST('0x' || substr({_md5('query')}, 1, 8) AS BIGINT) % count(*)) AS k FROM t GROUP BY query),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {_md5('query', 'index', 'entry', 'chain')}) AS r FROM t)
        SELECT query, index, entry FROM r JOIN n USING (query) WHERE r <= k""",
    "template_index_map": """
        WITH s AS (SELECT p_partkey, translate(upper(p_name), ' AEIOU', '------') AS a, translate(upper(p_type), 'NM', '--') AS b FROM part),
        c AS (SELECT p_partkey, unnest(range(1, greatest(length(a), length(b)) + 1)) AS i, a, b FROM s),
        l AS (SELECT p_partkey, i, coalesce(nullif(substr(a, CAST(i AS INT), 1), ''), '-') AS x, coalesce(nullif(substr(b, CAST(i AS INT), 1), ''), '-') AS y FROM c),
        n AS (SELECT *, CASE WHEN x = '-' THEN -1 ELSE count(*) FILTER (x <> '-') OVER w END AS q, CASE WHEN y = '-' THEN -1 ELSE 9 + count(*) FILTER (y <> '-') OVER w END AS t,
            round(count(*) FILTER (x = y AND x <> '-') OVER p / count(*) FILTER (x <> '-') OVER p, 6) AS identity, round(count(*) FILTER (x <> '-' AND y <> '-') OVER p / count(*) FILTER (x <> '-') OVER p, 6) AS coverage
            FROM l WINDOW w AS (PARTITION BY p_partkey ORDER BY i), p AS (PARTITION BY p_partkey))
        SELECT p_partkey, identity, coverage, CAST(q AS INT) AS q, CAST(t AS INT) AS t FROM n WHERE q <> -1 OR t <> -1""",
    "template_tokens": f"""
        WITH k AS ({_sql(TOKENS)}), r AS (SELECT entry, residue, count(*) AS n FROM ({_sql(RESIDUES)}) GROUP BY 1, 2),
        m AS (SELECT * FROM ({_sql(MAPS)}) AS m WHERE q <> -1 AND t <> -1 AND EXISTS (SELECT 1 FROM k WHERE k.query = m.query AND k.residue = m.q)),
        bad AS (SELECT DISTINCT m.query, m.entry FROM m LEFT JOIN r ON m.entry = r.entry AND m.t = r.residue WHERE r.n IS NULL OR r.n <> 1)
        SELECT m.query, m.entry, k.token, m.q, m.t FROM m JOIN k ON k.query = m.query AND k.residue = m.q WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.query = m.query AND bad.entry = m.entry)""",
}
