"""Similar parts by the trigrams of their descriptions, as fingerprints of 256 bits; every hundredth part is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import fingerprints
from quarry.sources.tables import read_table

BITS = 256


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt to more tasks than the small file has; the shuffle also keeps Spark from making the text again for each gram
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_size")).alias("text")
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text).repartition(4 * spark.sparkContext.defaultParallelism)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 2, F.lit(1))), lambda i: F.substring("text", i, F.lit(3)))
    return fingerprints.folded(rows.select("id", grams.alias("features")), BITS)


def part_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's fingerprint, its bits counted and listed again."""
    rows = parts(spark, sf_dir)
    return rows.select("id", fingerprints.popcount(F.col("fingerprint")).alias("n"), F.array_join(fingerprints.unpacked(F.col("fingerprint")), ",").alias("bits"))


def tanimoto_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are 0.85 alike or more to a query, itself included."""
    rows = parts(spark, sf_dir)
    return fingerprints.similar(rows.where("id % 100 = 0"), rows, 0.85).select("query", "target", F.round("similarity", 6).alias("similarity"))


def tanimoto_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts more than 0.5 alike to a query, counted."""
    rows = parts(spark, sf_dir)
    return fingerprints.count_similar(rows.where("id % 100 = 0"), rows, 0.5, strict=True)


QUERIES = {"part_fingerprints": part_fingerprints, "tanimoto_search": tanimoto_search, "tanimoto_above": tanimoto_above}
_BITS = f"""p AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size) AS s FROM part),
    b AS (SELECT DISTINCT id, CAST(('0x' || substr(md5(substr(s, i, 3)), 1, 8))::UBIGINT % {BITS} AS INT) AS bit FROM p, LATERAL (SELECT unnest(range(1, greatest(length(s) - 1, 2))) AS i)),
    n AS (SELECT id, count(*) AS n FROM b GROUP BY 1),
    s AS (SELECT q.id AS query, t.id AS target, count(*) AS k FROM b q JOIN b t ON q.bit = t.bit WHERE q.id % 100 = 0 GROUP BY 1, 2),
    r AS (SELECT query, target, k / (x.n + y.n - k) AS similarity FROM s JOIN n x ON x.id = query JOIN n y ON y.id = target)"""
ORACLE_SQL = {
    "part_fingerprints": f"WITH {_BITS} SELECT id, count(*) AS n, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM b GROUP BY 1",
    "tanimoto_search": f"WITH {_BITS} SELECT query, target, round(similarity, 6) AS similarity FROM r WHERE similarity >= 0.85",
    "tanimoto_above": f"WITH {_BITS} SELECT query, count(*) AS n FROM r WHERE similarity > 0.5 GROUP BY 1",
}
