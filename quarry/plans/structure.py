"""Structure building: crops, bonds, tokens, masks and sequence clusters. Lineitems stand for atoms (order, part, line) and
documents for sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators import metrics, sampling, similarity, spatial, structure
from quarry.plans.relational import KEY
from quarry.plans.spatial import AXES, atoms
from quarry.sources.tables import read_table

SEED = 23


def majority_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.majority(read_table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag")


def fill_missing_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.missing_positions(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.max("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber")


def contiguous_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 30 lines of each supplier, from its lines by return flag (the chains)."""
    return structure.contiguous_crop(read_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey"], 30, SEED).select(*KEY)


def spatial_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight points of each label nearest to a drawn point of it."""
    a = atoms(spark, sf_dir)
    center = sampling.per_group(a, ["label"], 1, [sampling.draw(SEED, "vec_id"), F.col("vec_id")])
    near = spatial.nearest(a, center, 8, "label", AXES, ["vec_id"])
    return near.select("label", "vec_id", F.col("rank").cast("bigint").alias("rank"))


def bond_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent lines of an order as bonds."""
    lines = read_table(spark, sf_dir, "lineitem")
    after = F.lead(F.struct("l_returnflag", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")).over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    bonds = lines.withColumn("n", after).where("n IS NOT NULL").select(
        *KEY, F.col("l_returnflag").alias("chain_1"), F.col("n.l_returnflag").alias("chain_2"), F.col("l_linenumber").alias("res_1"), F.col("n.l_linenumber").alias("res_2"),
        F.when((F.col("l_partkey") + F.col("n.l_partkey")) % 5 == 0, "COORDINATION").otherwise("SINGLE").alias("kind"), (F.col("l_returnflag") != "R").alias("polymer_1"),
        (F.col("n.l_returnflag") != "R").alias("polymer_2"), F.abs(F.col("l_quantity") - F.col("n.l_quantity")).alias("length"),
    )
    return structure.filter_bonds(bonds, 24.0).select(*KEY)


def symmetry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").withColumn("entity", F.col("l_suppkey") % 4)
    return structure.symmetry_ids(lines, "l_orderkey", "entity")


def token_scatter_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked mean of each part's quantities, given back to its lines."""
    lines = read_table(spark, sf_dir, "lineitem")
    means = lines.groupBy("l_partkey").agg(structure.masked_mean(F.col("l_quantity"), F.col("l_discount") <= 0.05).alias("m"))
    return lines.join(means, "l_partkey").select(*KEY, F.round("m", 6).alias("token_mean"))


def distogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of pair distances in ten bins, by label."""
    both = metrics.pairs(atoms(spark, sf_dir), "label", "vec_id", list(AXES))
    d = metrics.distance([F.col(f"a.{x}") for x in AXES], [F.col(f"b.{x}") for x in AXES])
    return both.groupBy("label", structure.distance_bin(d, 0.05, 0.95, 10).alias("bin")).agg(F.count("*").alias("n"))


def pair_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric list of pairs of nations that trade (customer and supplier of a line), each both ways."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    p = lines.join(c, "o_custkey").join(s, "l_suppkey").select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()
    return p.union(p.select("b", "a")).distinct()


def loss_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One, but zero where the resolution is null or outside its range; not a number passes, as written."""
    lines = read_table(spark, sf_dir, "lineitem")
    resolution = F.when(F.col("l_quantity") == 7, F.lit(None).cast("double")).when(F.col("l_quantity") == 9, F.lit(float("nan"))).otherwise(F.col("l_quantity") / 10)
    rows = lines.select(*KEY, resolution.alias("r"))
    weight = F.when(F.col("r").isNull(), 0.0).when(F.isnan("r"), 1.0).when((F.col("r") < 0.1) | (F.col("r") > 4.0), 0.0).otherwise(1.0)
    return rows.select(*KEY, weight.alias("weight"))


def msa_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: the first text, up to five of two sources, then all others, 40 rows in all."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    first = docs.groupBy("lang").agg(F.min("doc_id").alias("doc_id"))
    rest = docs.join(first.select("doc_id"), "doc_id", "left_anti")
    query = docs.join(first.select("doc_id"), "doc_id", "left_semi")
    paired = rest.where("source IN ('src1', 'src2')")
    return structure.stacked([(query, 1), (paired, 5), (rest.where("source NOT IN ('src1', 'src2')"), None)], ["lang"], ["doc_id"], 40).select("lang", "doc_id", F.col("source_no").cast("int").alias("source_no"), "row_idx")


def relative_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of clipped offsets between lines of an order."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    other = lines.select("l_orderkey", F.col("l_linenumber").alias("n"))
    offset = F.greatest(F.lit(-3), F.least(F.lit(3), F.col("l_linenumber") - F.col("n"))).cast("bigint")
    return lines.join(other, "l_orderkey").groupBy(offset.alias("offset")).agg(F.count("*").alias("n"))


def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the line of the highest price, the first of equals."""
    lines = read_table(spark, sf_dir, "lineitem")
    order = F.struct(-F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    return lines.groupBy("l_orderkey").agg(F.min_by("l_partkey", order).alias("best_part"), F.max("l_extendedprice").alias("best_price"))


def type_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score by type and by pairs of types, and the share above a threshold."""
    lines = read_table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.coalesce(F.col("l_returnflag"), F.lit("-")).alias("kind")).agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("above"))


def sequence_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of texts whose four-word shingles are alike; texts of fewer than nine cluster with equal ones only."""
    from quarry.llm import ngram_join  # here, as the other queries work without it

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", similarity.has_shingles(F.col("text"), 4, 9).alias("long"))
    groups = ngram_join.similar_groups(docs.select("doc_id", F.when(F.col("long"), F.lower("text")).alias("text")), n=4, percent=80)
    members = groups.where("n_shingles > 0").select("doc_id", F.col("component_id").alias("cluster"))
    equal = F.min("doc_id").over(W.partitionBy("h"))
    return members.union(docs.where("NOT long").select("doc_id", F.sha2("text", 256).alias("h")).select("doc_id", equal.alias("cluster")))


_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_ATOMS = "atoms AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_D = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"
NAMES = """majority_type fill_missing_positions contiguous_crop spatial_crop bond_filters symmetry_ids token_scatter_gather distogram pair_mask
loss_weights msa_stack relative_positions best_model type_means sequence_clusters""".split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLE_SQL = {
    "majority_type": "SELECT l_partkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_returnflag) = 1",
    "fill_missing_positions": """
        SELECT l_orderkey, CAST(i AS INTEGER) AS l_linenumber FROM (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) g, LATERAL (SELECT unnest(range(1, m + 1)) AS i)
        WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = g.l_orderkey AND l.l_linenumber = i)""",
    "contiguous_crop": f"""
        WITH s AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
        u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY md5(concat_ws('|', '{SEED}', l_suppkey, l_returnflag)), l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s),
        t AS (SELECT *, least(n, greatest(30 - used, 0)) AS take FROM u),
        v AS (SELECT *, CAST(CAST('0x' || substr(md5(concat_ws('|', '{SEED + 1}', l_suppkey, l_returnflag)), 1, 8) AS BIGINT) AS HUGEINT) % (n - take + 1) AS start FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM lineitem)
        SELECT {_K} FROM r JOIN v USING (l_suppkey, l_returnflag) WHERE pos >= start AND pos < start + take""",
    "spatial_crop": f"""
        WITH {_ATOMS}, b AS (SELECT * FROM atoms QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}|' || vec_id), vec_id) = 1)
        SELECT a.label, a.vec_id, row_number() OVER (PARTITION BY a.label ORDER BY {_D}, a.vec_id) AS rank FROM atoms a JOIN b ON a.label = b.label QUALIFY rank <= 8""",
    "bond_filters": f"""
        WITH n AS (SELECT *, lead(l_returnflag) OVER w AS f, lead(l_linenumber) OVER w AS r, lead(l_quantity) OVER w AS q, lead(l_partkey) OVER w AS p FROM lineitem
            WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
        SELECT {_K} FROM n WHERE f IS NOT NULL AND NOT (l_returnflag <> f AND (l_partkey + p) % 5 = 0) AND NOT (l_returnflag <> f AND l_returnflag <> 'R' AND f <> 'R')
            AND NOT (l_returnflag = f AND l_returnflag <> 'R' AND abs(l_linenumber - r) > 1) AND abs(l_quantity - q) <= 24""",
    "symmetry_ids": """
        WITH m AS (SELECT l_orderkey, md5(concat_ws('|', string_agg(DISTINCT CAST(l_suppkey % 4 AS VARCHAR), ',' ORDER BY CAST(l_suppkey % 4 AS VARCHAR)), count(*))) AS kind FROM lineitem GROUP BY 1)
        SELECT l_orderkey, kind, row_number() OVER (PARTITION BY kind ORDER BY l_orderkey) AS number FROM m""",
    "token_scatter_gather": f"""
        SELECT {_K}, round(sum(CASE WHEN l_discount <= 0.05 THEN l_quantity ELSE 0 END) OVER (PARTITION BY l_partkey) / (count(*) FILTER (l_discount <= 0.05) OVER (PARTITION BY l_partkey) + CAST(1e-4 AS DOUBLE)), 6) AS token_mean FROM lineitem""",
    "distogram": f"""
        WITH {_ATOMS} SELECT a.label, CAST(greatest(0, least(10, ceil(({_D} - CAST(0.05 AS DOUBLE)) / ((CAST(0.95 AS DOUBLE) - CAST(0.05 AS DOUBLE)) / 9)))) AS BIGINT) AS bin, count(*) AS n
        FROM atoms a JOIN atoms b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2""",
    "pair_mask": """
        WITH p AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
        SELECT a, b FROM p UNION SELECT b, a FROM p""",
    "loss_weights": f"SELECT {_K}, CAST(CASE WHEN l_quantity = 7 THEN 0 WHEN l_quantity = 9 THEN 1 WHEN l_quantity / 10 < 0.1 OR l_quantity / 10 > 4.0 THEN 0 ELSE 1 END AS DOUBLE) AS weight FROM lineitem",
    "msa_stack": """
        WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY lang) THEN 0 WHEN source IN ('src1', 'src2') THEN 1 ELSE 2 END AS source_no FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source_no ORDER BY doc_id) AS r FROM d),
        p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source_no, r) AS row_idx FROM r WHERE source_no <> 1 OR r <= 5)
        SELECT lang, doc_id, source_no, row_idx FROM p WHERE row_idx <= 40""",
    "relative_positions": "SELECT CAST(greatest(-3, least(3, a.l_linenumber - b.l_linenumber)) AS BIGINT) AS \"offset\", count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY 1",
    "best_model": "SELECT l_orderkey, l_partkey AS best_part, l_extendedprice AS best_price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) = 1",
    "type_means": "SELECT l_returnflag AS kind, round(avg(l_discount), 6) AS mean, round(avg(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END), 6) AS above FROM lineitem GROUP BY 1",
    "sequence_clusters": r"""
        WITH RECURSIVE w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 2)) AS i)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 9),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id WHERE a.doc_id IN (SELECT doc_id FROM n) AND b.doc_id IN (SELECT doc_id FROM n) GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.8),
        r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
        SELECT node AS doc_id, min(root) AS cluster FROM r GROUP BY 1
        UNION ALL SELECT doc_id, min(doc_id) OVER (PARTITION BY text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)""",
}
