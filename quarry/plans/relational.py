"""Metadata filters, lookups, set operations and summaries.

Orders stand for parent records (date, status, price as their resolution) and lineitems for their children (return flag
as type, part as reference). A lineitem's key is (l_orderkey, l_linenumber, l_partkey, l_suppkey).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators import filters
from quarry.sources.tables import read_table

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def metadata_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, price, date, number of children, total quantity: in this order, each bound inclusive."""
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    kept = orders.where(F.col("o_orderstatus") != "P").where(filters.within(F.col("o_totalprice"), high=300000))
    kept = kept.where(filters.within(F.col("o_orderdate"), F.lit("1995-06-01").cast("timestamp"), F.lit("2000-12-31").cast("timestamp")))
    kept = filters.having_at_most(kept, lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", F.col("l_returnflag").isin("A", "N"), 4)
    size = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"))
    kept = kept.join(size, "o_orderkey", "left").where(F.coalesce("quantity", F.lit(0.0)) <= 150)
    return kept.groupBy("o_orderstatus", F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count("*").alias("n_orders"))


def having_max_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return filters.having_at_most(read_table(spark, sf_dir, "orders"), lines, "o_orderkey", F.col("l_returnflag") != "R", 2).select("o_orderkey", "o_orderstatus")


def forall_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return filters.for_all(read_table(spark, sf_dir, "orders"), lines, "o_orderkey", (F.col("l_returnflag") != "A") | (F.col("l_discount") <= 0.05)).select("o_orderkey")


def exact_representative_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's representative (the last id with that text) and the size of its class."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    classes = docs.groupBy("h").agg(F.max("doc_id").alias("representative_id"), F.count("*").alias("class_size"))
    return docs.join(classes, "h").select("doc_id", "representative_id", "class_size")


def left_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return read_table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).cast("double").alias("fit"))


def fallback_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's fallback (its first order) is later than the cutoff; an unknown fallback counts as later."""
    first = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("fallback"))
    orders = read_table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("fallback"), "o_orderdate")
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    flag = F.when(F.col("fallback").isNull(), False).otherwise(F.coalesce(F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp"), F.lit(True)))
    return parts.join(first, "l_partkey", "left").join(orders, "fallback", "left").select(F.col("l_partkey").alias("p_partkey"), "fallback", flag.alias("set_to_nan"))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of a line: its part's name for type A, its part for type N, else unknown; with the cluster's size."""
    lines = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size"), "l_partkey", "left")
    cluster = F.when((F.col("l_returnflag") == "A") & (F.col("p_size") >= 10), F.concat(F.lit("name:"), "p_name")).when(F.col("l_returnflag") != "R", F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).otherwise("UNKNOWN")
    lines = lines.select(*KEY, cluster.alias("cluster_id"))
    known = lines.where("cluster_id <> 'UNKNOWN'")  # the others, a third of all, are not shuffled
    sizes = known.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    alone = lines.where("cluster_id = 'UNKNOWN'").withColumn("cluster_size", F.lit(1).cast("long"))
    return known.join(sizes, "cluster_id").select(*KEY, "cluster_id", "cluster_size").unionByName(alone)


def eligibility_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low discount, and for type R neither an excluded brand nor a part larger than 40."""
    lines = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "left")
    excluded = F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33")
    ok = (F.col("l_discount") <= 0.06) & ((F.col("l_returnflag") != "R") | (~F.coalesce(excluded, F.lit(False)) & (F.coalesce("p_size", F.lit(99)) <= 40)))
    return lines.select(*KEY, ok.alias("metric_eligible"))


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    a = orders.agg(F.count("*").alias("n_entries"))
    b = lines.agg(
        F.count("*").alias("n_chains"),
        F.count_if(F.col("l_discount") <= 0.05).alias("n_low"),
        F.count_if((F.col("l_discount") <= 0.05) & (F.col("l_tax") <= 0.04)).alias("n_scored"),
        F.count_distinct(F.when(F.col("l_returnflag") == "A", F.col("l_orderkey"))).alias("n_parents_a"),
    )
    return a.join(b)


def semi_join_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed pairs of adjacent lines keep their lines and parents."""
    lines = read_table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 AND l_quantity >= 40")
    wanted = lines.where("l_linenumber = 1").join(lines.where("l_linenumber = 2").select("l_orderkey").distinct(), "l_orderkey", "left_semi").select("l_orderkey").distinct()
    kept = read_table(spark, sf_dir, "orders").join(wanted, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return kept.select("o_orderkey", "o_custkey")


def only_ll_rescue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with a scored line that isn't of type R, or two scored types; any scored A or N rescues."""
    lines = read_table(spark, sf_dir, "lineitem").where("l_tax <= 0.04")
    kept = lines.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") != "R").alias("rescued"), F.count("*").alias("n_scored")).where("rescued")
    return read_table(spark, sf_dir, "orders").join(kept, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n_scored")


def union_caches_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two caches with numbered keys; of equal reference rows the last cache's wins."""
    orders = read_table(spark, sf_dir, "orders")
    parts = [orders.where(f"o_orderkey % 3 {op} 0").withColumn("cache", F.lit(i)) for i, op in enumerate(("=", "<>"))]
    both = parts[0].unionByName(parts[1])
    rows = both.select(F.format_string("%d%04d", F.col("o_orderkey"), F.col("cache")).alias("entry"), "o_custkey", "cache", "o_totalprice")
    last = both.groupBy("o_custkey").agg(F.max(F.struct("cache", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.cache").alias("last_cache"))
    return rows.join(last, "o_custkey").select("entry", "o_custkey", F.col("last_cache").cast("int").alias("last_cache"))


def id_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in documents, labels and long documents; and the symmetric difference, by left-padded text."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), read_table(spark, sf_dir, "labels").select("doc_id")
    long = docs.where("n_chars > 2000").select("doc_id")
    both = docs.select("doc_id").intersect(labels).intersect(long).withColumn("part", F.lit("all"))
    lone = long.subtract(labels).union(labels.subtract(long)).withColumn("part", F.lit("one"))
    return both.union(lone).select("doc_id", "part", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("sort_key"))


def template_topk_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four lines of each part, by ship date, that are old enough."""
    lines = read_table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") <= F.lit("1999-06-30").cast("timestamp")) & (F.col("l_quantity") >= 10))
    rank = F.row_number().over(W.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"))
    return lines.withColumn("rank", rank).where("rank <= 4").select(*KEY, F.col("rank").cast("bigint").alias("rank"))


def date_diff_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate")
    return both.where(days >= 60).groupBy("o_orderstatus", "l_returnflag").agg(F.count("*").alias("n"), F.min(days).cast("bigint").alias("least_days"))


def qc_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per check with the number of offenders."""
    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    from quarry.operators import quality

    checks = [
        quality.no_nan(lines, "no_nan", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
        quality.holds(lines, "discount_in_range", F.col("l_discount").between(0, 0.1)),
        quality.holds(lines, "type_implies_tax", (F.col("l_returnflag") != "A") | (F.col("l_tax") <= 0.05)),
        quality.determines(lines, "one_supplier_per_part", ["l_partkey"], ["l_suppkey"]),
        quality.unique(lines, "unique_line", list(KEY)),
        quality.unique(orders, "unique_order", ["o_orderkey"]),
        quality.contained(lines, orders, "line_has_order", "l_orderkey", "o_orderkey"),
        quality.at_most(lines, "max_children", ["l_orderkey"], 10),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


def wide_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    aggs = [F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct("l_partkey").alias("n_parts")]
    for flag in ("A", "N", "R"):
        here = F.col("l_returnflag") == flag
        aggs += [F.count_if(here).alias(f"n_{flag.lower()}"), F.round(F.avg(F.when(here, F.col("l_quantity"))), 4).alias(f"mean_quantity_{flag.lower()}"), F.max(F.when(here, F.col("l_extendedprice"))).alias(f"max_price_{flag.lower()}")]
    return lines.groupBy("l_linestatus").agg(*aggs, F.round(F.stddev_samp("l_extendedprice"), 2).alias("spread"))


def json_query_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values of a JSON document column."""
    events = read_table(spark, sf_dir, "events").where("props IS NOT NULL")
    props = F.from_json("props", "map<string,string>")
    return events.select("event_id", F.explode(props).alias("name", "value"))


NAMES = """metadata_filter_chain having_max_children forall_anti_join exact_representative_join left_lookup_default fallback_flag cluster_sizes
eligibility_labels validation_summary semi_join_prune only_ll_rescue_filter union_caches_suffix id_set_ops template_topk_after_filter date_diff_band
qc_assertions wide_statistics json_query_explode""".split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLE_SQL = {
    "metadata_filter_chain": """
        WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag IN ('A','N')) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
        SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n_orders FROM orders LEFT JOIN c ON o_orderkey = l_orderkey
        WHERE o_orderstatus <> 'P' AND o_totalprice <= 300000 AND o_orderdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '2000-12-31'
          AND coalesce(n, 0) <= 4 AND coalesce(q, 0) <= 150 GROUP BY 1, 2""",
    "having_max_children": """
        SELECT o_orderkey, o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON l_orderkey = o_orderkey
        WHERE coalesce(n, 0) <= 2""",
    "forall_anti_join": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_returnflag <> 'A' OR l_discount <= 0.05))",
    "exact_representative_join": "SELECT doc_id, max(doc_id) OVER w AS representative_id, count(*) OVER w AS class_size FROM documents WINDOW w AS (PARTITION BY text)",
    "left_lookup_default": "SELECT doc_id, CAST(coalesce(q, 0) AS DOUBLE) AS fit FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)",
    "fallback_flag": """
        WITH f AS (SELECT l_partkey, min(l_orderkey) AS fallback FROM lineitem GROUP BY 1)
        SELECT p_partkey, fallback, CASE WHEN fallback IS NULL THEN false ELSE coalesce(o_orderdate > TIMESTAMP '1998-01-01', true) END AS set_to_nan
        FROM part LEFT JOIN f ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON fallback = o_orderkey""",
    "cluster_sizes": """
        WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' AND p_size >= 10 THEN 'name:' || p_name
                WHEN l_returnflag <> 'R' THEN 'part:' || l_partkey ELSE 'UNKNOWN' END AS cluster_id FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
        SELECT *, CASE WHEN cluster_id = 'UNKNOWN' THEN 1 ELSE count(*) OVER (PARTITION BY cluster_id) END AS cluster_size FROM c""",
    "eligibility_labels": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount <= 0.06 AND (l_returnflag <> 'R' OR (NOT coalesce(p_brand IN ('Brand#11','Brand#22','Brand#33'), false)
            AND coalesce(p_size, 99) <= 40)) AS metric_eligible FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "validation_summary": """
        SELECT (SELECT count(*) FROM orders) AS n_entries, count(*) AS n_chains, count(*) FILTER (l_discount <= 0.05) AS n_low,
            count(*) FILTER (l_discount <= 0.05 AND l_tax <= 0.04) AS n_scored, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END) AS n_parents_a FROM lineitem""",
    "semi_join_prune": """
        WITH l AS (SELECT * FROM lineitem WHERE l_linenumber <= 2 AND l_quantity >= 40)
        SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l WHERE l_linenumber = 1) AND o_orderkey IN (SELECT l_orderkey FROM l WHERE l_linenumber = 2)""",
    "only_ll_rescue_filter": """
        SELECT o_orderkey, n_scored FROM orders JOIN (SELECT l_orderkey, count(*) AS n_scored FROM lineitem WHERE l_tax <= 0.04 GROUP BY 1 HAVING bool_or(l_returnflag <> 'R')) ON l_orderkey = o_orderkey""",
    "union_caches_suffix": """
        WITH b AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS cache FROM orders)
        SELECT printf('%d%04d', o_orderkey, cache) AS entry, o_custkey, max(cache) OVER (PARTITION BY o_custkey) AS last_cache FROM b""",
    "id_set_ops": """
        WITH l AS (SELECT doc_id FROM documents WHERE n_chars > 2000), x AS (
            SELECT doc_id, 'all' AS part FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM l)
            UNION ALL SELECT doc_id, 'one' FROM ((SELECT doc_id FROM l EXCEPT SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM l)))
        SELECT doc_id, part, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS sort_key FROM x""",
    "template_topk_after_filter": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS rank
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-06-30' AND l_quantity >= 10 QUALIFY rank <= 4""",
    "date_diff_band": """
        SELECT o_orderstatus, l_returnflag, count(*) AS n, min(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS least_days FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) >= 60 GROUP BY 1, 2""",
    "qc_assertions": """
        SELECT 'no_nan' AS check, count(*) FILTER (isnan(l_quantity) OR isnan(l_extendedprice) OR isnan(l_discount) OR isnan(l_tax) OR isinf(l_quantity) OR isinf(l_extendedprice) OR isinf(l_discount) OR isinf(l_tax)) AS offenders FROM lineitem
        UNION ALL SELECT 'discount_in_range', count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.1) FROM lineitem
        UNION ALL SELECT 'type_implies_tax', count(*) FILTER (l_returnflag = 'A' AND l_tax > 0.05) FROM lineitem
        UNION ALL SELECT 'one_supplier_per_part', count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1)
        UNION ALL SELECT 'unique_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey HAVING count(*) > 1)
        UNION ALL SELECT 'unique_order', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
        UNION ALL SELECT 'line_has_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'max_children', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 10)""",
    "wide_statistics": """
        SELECT l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts, """
    + ", ".join(
        f"count(*) FILTER (l_returnflag = '{f}') AS n_{f.lower()}, round(avg(l_quantity) FILTER (l_returnflag = '{f}'), 4) AS mean_quantity_{f.lower()}, max(l_extendedprice) FILTER (l_returnflag = '{f}') AS max_price_{f.lower()}"
        for f in "ANR"
    )
    + ", round(stddev_samp(l_extendedprice), 2) AS spread FROM lineitem GROUP BY 1",
    "json_query_explode": "SELECT event_id, name, json_extract_string(props, '$.' || name) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS name FROM events WHERE props IS NOT NULL)",
}
