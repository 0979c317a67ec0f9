"""Weights and samples that are the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators import order, sampling
from quarry.operators.durable import dealt
from quarry.plans.relational import KEY
from quarry.sources.tables import read_table

SEED = 17


def datapoint_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for single lines and for pairs of adjacent lines, weighted by their types over the size of their cluster."""
    lines = read_table(spark, sf_dir, "lineitem")
    single = lines.groupBy("l_partkey").agg(F.count("*").alias("n_clust"))
    a = lines.join(single, "l_partkey").select(F.lit("chain").alias("kind"), *KEY, "n_clust", (F.lit(0.5) / F.col("n_clust") * F.when(F.col("l_returnflag") == "R", 1.0).otherwise(3.0)).alias("w"))
    after = F.lead(F.struct("l_returnflag", "l_partkey")).over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    pairs = lines.withColumn("next", after).where("next IS NOT NULL").withColumn("cluster", F.concat_ws("_", F.least(F.col("l_partkey") % 50, F.col("next.l_partkey") % 50), F.greatest(F.col("l_partkey") % 50, F.col("next.l_partkey") % 50)))
    sizes = pairs.groupBy("cluster").agg(F.count("*").alias("n_clust"))
    heavy = lambda c: F.when(c == "R", 1.0).otherwise(3.0)
    b = pairs.join(sizes, "cluster").select(F.lit("interface").alias("kind"), *KEY, "n_clust", (F.lit(1.0) / F.col("n_clust") * (heavy(F.col("l_returnflag")) + heavy(F.col("next.l_returnflag")))).alias("w"))
    return a.unionByName(b).select("kind", *KEY, "n_clust", F.round("w", 8).alias("weight"))


def stratified_topn_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return sampling.per_group(lines, ["l_partkey"], 2, [sampling.draw(SEED, *KEY), *map(F.col, KEY)]).select(*KEY)


def two_stage_cluster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    quota = F.when(F.col("l_returnflag") == "A", 40).when(F.col("l_returnflag") == "R", 100)
    return sampling.clusters_then_members(lines, "l_returnflag", "l_partkey", quota, SEED, list(KEY)).select("l_returnflag", *KEY)


def quota_sample_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of adjacent lines by type of pair, each type up to its quota."""
    lines = dealt(read_table(spark, sf_dir, "lineitem").select(*KEY, "l_returnflag"), "l_orderkey")
    after = F.lead("l_returnflag").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    pairs = lines.withColumn("next", after).where("next IS NOT NULL").withColumn("pair_type", F.concat_ws("-", F.least("l_returnflag", "next"), F.greatest("l_returnflag", "next")))
    quotas = [("A-A", 60), ("A-N", 30), ("N-N", 25), ("R-R", 10), ("A-R", 45)]
    quota = spark.createDataFrame(quotas, "pair_type string, quota int")
    rank = F.row_number().over(W.partitionBy("pair_type").orderBy("drawn", *KEY))
    # no type has more than the largest quota: a constant, by which Spark cuts each task's rows before they are shuffled
    first = pairs.select("pair_type", *KEY, sampling.draw(SEED, *KEY).alias("drawn")).withColumn("r", rank).where(F.col("r") <= max(q for _, q in quotas))
    return first.join(F.broadcast(quota), "pair_type").where("r <= quota").select("pair_type", *KEY)


def weighted_cdf_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").withColumn("weight", F.col("l_quantity").cast("bigint"))
    return sampling.by_weight(lines, "weight", list(KEY), 500, 2654435761).select("draw", *KEY)


def cyclic_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return order.cyclic(docs, ["doc_id"], 900, 1500).select("place", "doc_id", "lang")


def pad_to_world_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.pad_to_multiple(read_table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"], 64)


_PAIRS = """lineitem_next AS (SELECT *, lead(l_returnflag) OVER w AS nf, lead(l_partkey) OVER w AS np FROM lineitem
            WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""
_HASH = f"md5(concat_ws('|', '{SEED}', l_orderkey, l_linenumber, l_partkey, l_suppkey))"
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
NAMES = "datapoint_weights stratified_topn_by_hash two_stage_cluster_sample quota_sample_by_type weighted_cdf_sample cyclic_slice pad_to_world_size".split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLE_SQL = {
    "datapoint_weights": f"""
        WITH {_PAIRS}, p AS (SELECT *, concat_ws('_', least(l_partkey % 50, np % 50), greatest(l_partkey % 50, np % 50)) AS cluster FROM lineitem_next WHERE nf IS NOT NULL)
        SELECT 'chain' AS kind, {_KEY}, count(*) OVER (PARTITION BY l_partkey) AS n_clust,
            round(0.5 / count(*) OVER (PARTITION BY l_partkey) * CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 3.0 END, 8) AS weight FROM (SELECT * FROM lineitem)
        UNION ALL SELECT 'interface', {_KEY}, count(*) OVER (PARTITION BY cluster),
            round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY cluster) * (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 3 END + CASE WHEN nf = 'R' THEN 1 ELSE 3 END), 8) FROM p""",
    "stratified_topn_by_hash": f"SELECT {_KEY} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {_HASH}, {_KEY}) <= 2",
    "two_stage_cluster_sample": f"""
        WITH one AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_partkey ORDER BY {_HASH}, {_KEY}) = 1)
        SELECT l_returnflag, {_KEY} FROM one QUALIFY l_returnflag = 'N' OR
            row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat_ws('|', '{SEED + 1}', l_returnflag, l_partkey)), l_partkey) <= CASE WHEN l_returnflag = 'A' THEN 40 ELSE 100 END""",
    "quota_sample_by_type": f"""
        WITH {_PAIRS}, t AS (SELECT *, least(l_returnflag, nf) || '-' || greatest(l_returnflag, nf) AS pair_type FROM lineitem_next WHERE nf IS NOT NULL),
        q(pair_type, quota) AS (VALUES ('A-A', 60), ('A-N', 30), ('N-N', 25), ('R-R', 10), ('A-R', 45))
        SELECT pair_type, {_KEY} FROM t JOIN q USING (pair_type) QUALIFY row_number() OVER (PARTITION BY pair_type ORDER BY {_HASH}, {_KEY}) <= quota""",
    "weighted_cdf_sample": f"""
        WITH c AS (SELECT *, CAST(l_quantity AS BIGINT) AS w, sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_KEY} ROWS UNBOUNDED PRECEDING) AS r FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 0),
        p AS (SELECT i AS draw, i * 2654435761 % (SELECT sum(w) FROM c) AS point FROM range(500) t(i))
        SELECT draw, {_KEY} FROM p JOIN c ON point >= r - w AND point < r""",
    "cyclic_slice": """
        WITH d AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
        SELECT place, doc_id, lang FROM range(1500) t(place) JOIN d ON i = (900 + place) % n""",
    "pad_to_world_size": """
        WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark), m AS (SELECT (64 - count(*) % 64) % 64 AS missing FROM benchmark)
        SELECT item_id, false AS repeated_sample FROM b UNION ALL SELECT item_id, true FROM m, range(64) t(k), b WHERE k < missing AND i = k % n""",
}
