"""Metrics over predicted and true points. Numbers 0 to 2 of an embedding are the true coordinates, 3 to 5 the predicted
ones, 10 to 17 logits over eight bins, and the label is the structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators import metrics
from quarry.sources.tables import read_table


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(6)]
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "label", *at)


def lddt_gdt_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    d = metrics.distance([F.col(f"e{i}") * 10 for i in range(3)], [F.col(f"e{i}") * 10 for i in range(3, 6)])
    single = p.groupBy("label").agg(F.round(metrics.gdt_ts(d), 6).alias("gdt_ts"), F.round(metrics.gdt_ha(d), 6).alias("gdt_ha"), F.round(metrics.rmsd(d), 6).alias("rmsd"))
    both = metrics.pairs(p, "label", "vec_id", [f"e{i}" for i in range(6)])
    true, made = (metrics.distance([F.col(f"a.e{i}") * 10 for i in r], [F.col(f"b.e{i}") * 10 for i in r]) for r in (range(3), range(3, 6)))
    both = both.select("label", true.alias("true"), made.alias("made"))
    pair = both.groupBy("label").agg(
        F.round(metrics.lddt(F.col("true"), F.col("made"), 4.0), 6).alias("lddt"),
        F.round(metrics.drmsd(F.col("true"), F.col("made")), 6).alias("drmsd"),
        F.round(metrics.steric_clash(F.col("made"), 1.1), 6).alias("clash"),
    )
    return single.join(pair, "label")


def ptm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label and chain: mean expected score of the bins under the scale of the label's size; best row of each."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 7).alias("chain"), F.transform(F.slice("embedding", 11, 8), lambda x: x.cast("double")).alias("logits"))
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    rows = e.withColumn("p", metrics.softmax(F.col("logits"))).join(n, "label").withColumn("d0", metrics.tm_scale(F.col("n")))
    term = F.transform("p", lambda p, i: p / (1 + F.pow((i + F.lit(0.5)) * 4 / F.col("d0"), F.lit(2.0))))
    scored = rows.withColumn("score", F.aggregate(term, F.lit(0.0), lambda s, x: s + x)).withColumn("error", metrics.expected(F.col("p"), 0.0, 32.0, 8))
    return scored.groupBy("label", "chain").agg(F.round(F.max("score"), 6).alias("ptm"), F.round(F.avg("error"), 6).alias("expected_error"))


def gpde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean expected error weighted by the probability of a contact (the two lowest bins)."""
    e = read_table(spark, sf_dir, "embeddings").select("label", metrics.softmax(F.transform(F.slice("embedding", 11, 8), lambda x: x.cast("double"))).alias("p"))
    contact = F.get("p", 0) + F.get("p", 1)
    error = metrics.expected(F.col("p"), 0.0, 32.0, 8)
    return e.select("label", contact.alias("c"), error.alias("e")).groupBy("label").agg(F.round(F.sum(F.col("c") * F.col("e")) / (F.sum("c") + 1e-8), 6).alias("gpde"))


def _residue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order's lines as residues: expected error and distances, chains (by supplier) and types."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("row"), (F.col("l_suppkey") % 3).alias("chain"), F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("price"), "l_quantity")
    sizes = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = lines.join(sizes, "l_orderkey")
    other = lines.select("l_orderkey", *(F.col(c).alias(f"{c}_2") for c in ("row", "chain", "kind", "price", "l_quantity")))
    both = rows.join(other, "l_orderkey").where("row <> row_2")
    return both.withColumns({"error": F.abs(F.col("price") - F.col("price_2")) / 1000, "true": F.abs(F.col("price") - F.col("price_2")) / 4000, "made": F.abs(F.col("l_quantity") - F.col("l_quantity_2")) / 2})


def chain_pair_iptm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score between each chain and each other one of a structure: its best residue's mean over the other chain."""
    pairs = _residue_pairs(spark, sf_dir).where("chain <> chain_2")
    return metrics.aligned_scores(pairs, "l_orderkey", "row", "n", "error", ["chain", "chain_2"]).withColumn("score", F.round("score", 6))


def structure_ptm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole structures, and of their chains alone and against all others."""
    pairs = _residue_pairs(spark, sf_dir)
    of = lambda rows, by, name: metrics.aligned_scores(rows, "l_orderkey", "row", "n", "error", by).select("l_orderkey", (F.col("chain") if by else F.lit(-1)).cast("bigint").alias("chain"), F.lit(name).alias("kind"), F.round("score", 6).alias("score"))
    return of(pairs, [], "ptm").union(of(pairs.where("chain <> chain_2"), [], "iptm")).union(of(pairs.where("chain = chain_2"), ["chain"], "chain_ptm")).union(of(pairs.where("chain <> chain_2"), ["chain"], "chain_iptm"))


def typed_lddt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance tests by the types of both residues, within chains and between them, with clashes."""
    pairs = _residue_pairs(spark, sf_dir).withColumn("between", F.col("chain") != F.col("chain_2"))
    return pairs.groupBy("kind", "kind_2", "between").agg(
        F.count("*").alias("pairs"), F.round(metrics.lddt(F.col("true"), F.col("made"), 15.0), 6).alias("lddt"), F.round(metrics.drmsd(F.col("true"), F.col("made")), 6).alias("drmsd"),
        F.round(metrics.steric_clash(F.col("made"), 1.1), 6).alias("clash"),
    )


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: half the discount at the lowest tax (first of equals) and half the best discount."""
    lines = read_table(spark, sf_dir, "lineitem")
    order = F.struct("l_tax", "l_orderkey", "l_linenumber", "l_suppkey")
    out = lines.groupBy("l_partkey").agg(F.min_by("l_discount", order).alias("at"), F.max("l_discount").alias("best"))
    return out.select("l_partkey", F.round(0.5 * (F.col("at") + F.col("best")), 6).alias("selection"))


def sample_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples (orders) of each customer ranked by a weighted sum of scores."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_discount").alias("iptm"), F.max("l_tax").alias("ptm"), F.max("l_quantity").alias("q"))
    orders = read_table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    score = metrics.ranking(F.col("iptm"), F.col("ptm"), F.lit(0.0), (F.col("q") > 45).cast("double"), (0.8, 0.2, 0.5, 1.0))
    rows = orders.select("o_custkey", "o_orderkey", F.round(score, 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey")).cast("bigint"))


_P = "p AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 10 AS e{i}" for i in range(6)) + " FROM embeddings)"
_SOFT = """l AS (SELECT vec_id, label, vec_id % 7 AS chain, i - 1 AS i, exp(CAST(embedding[10 + i] AS DOUBLE)) AS x FROM embeddings, range(1, 9) r(i)),
        s AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS p, count(*) OVER (PARTITION BY label) / 8 AS n FROM l)"""
_PAIRS = """a AS (SELECT l_orderkey AS k, md5(concat_ws('|', l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS row, l_suppkey % 3 AS chain, l_returnflag AS kind, l_extendedprice AS x, l_quantity AS q, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
        p AS (SELECT a.k, a.row, a.chain, b.chain AS c2, a.kind, b.kind AS k2, abs(a.x - b.x) / 4000 AS t, abs(a.q - b.q) / 2 AS m, 1 / (1 + pow(abs(a.x - b.x) / 1000 / (1.24 * pow(greatest(a.n, 19) - 15, CAST(1 AS DOUBLE) / 3) - 1.8), 2)) AS score FROM a JOIN a b ON a.k = b.k AND a.row <> b.row)"""
_SHARE = lambda cuts: "round((" + " + ".join(f"avg(CASE WHEN d <= {c} THEN 1 ELSE 0 END)" for c in cuts) + f") / {len(cuts)}, 6)"
NAMES = "lddt_gdt_rmsd ptm_scores gpde chain_pair_iptm structure_ptm typed_lddt model_selection sample_ranking".split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLE_SQL = {
    "lddt_gdt_rmsd": f"""
        WITH {_P}, d AS (SELECT label, sqrt((e0-e3)*(e0-e3)+(e1-e4)*(e1-e4)+(e2-e5)*(e2-e5)) AS d FROM p),
        a AS (SELECT label, {_SHARE((1, 2, 4, 8))} AS gdt_ts, {_SHARE((0.5, 1, 2, 4))} AS gdt_ha, round(sqrt(avg(d*d)), 6) AS rmsd FROM d GROUP BY 1),
        b AS (SELECT x.label, sqrt((x.e0-y.e0)*(x.e0-y.e0)+(x.e1-y.e1)*(x.e1-y.e1)+(x.e2-y.e2)*(x.e2-y.e2)) AS t, sqrt((x.e3-y.e3)*(x.e3-y.e3)+(x.e4-y.e4)*(x.e4-y.e4)+(x.e5-y.e5)*(x.e5-y.e5)) AS m
            FROM p x JOIN p y ON x.label = y.label AND x.vec_id <> y.vec_id),
        c AS (SELECT label, round(avg(CASE WHEN t < 4 THEN ((abs(t-m) < 0.5)::INT + (abs(t-m) < 1)::INT + (abs(t-m) < 2)::INT + (abs(t-m) < 4)::INT) / 4 END), 6) AS lddt,
            round(sqrt(avg((t-m)*(t-m))), 6) AS drmsd, round(avg(greatest(0, 1.1 - m) / 1.1), 6) AS clash FROM b GROUP BY 1)
        SELECT * FROM a JOIN c USING (label)""",
    "ptm_scores": f"""
        WITH {_SOFT}, t AS (SELECT label, chain, vec_id, sum(p / (1 + pow((i + 0.5) * 4 / (1.24 * pow(greatest(n, 19) - 15, CAST(1 AS DOUBLE) / 3) - 1.8), 2))) AS score, sum(p * (i + 0.5) * 4) AS e FROM s GROUP BY 1, 2, 3)
        SELECT label, chain, round(max(score), 6) AS ptm, round(avg(e), 6) AS expected_error FROM t GROUP BY 1, 2""",
    "gpde": f"""
        WITH {_SOFT}, t AS (SELECT label, vec_id, sum(p) FILTER (i < 2) AS c, sum(p * (i + 0.5) * 4) AS e FROM s GROUP BY 1, 2)
        SELECT label, round(sum(c * e) / (sum(c) + 1e-8), 6) AS gpde FROM t GROUP BY 1""",
    "chain_pair_iptm": f"WITH {_PAIRS}, r AS (SELECT k, chain, c2, row, avg(score) AS m FROM p WHERE chain <> c2 GROUP BY ALL) SELECT k AS l_orderkey, chain, c2 AS chain_2, round(max(m), 6) AS score FROM r GROUP BY ALL",
    "structure_ptm": f"""
        WITH {_PAIRS}, ga AS (SELECT k, row, avg(score) AS m FROM p GROUP BY ALL), gb AS (SELECT k, row, avg(score) AS m FROM p WHERE chain <> c2 GROUP BY ALL),
        gc AS (SELECT k, chain, row, avg(score) AS m FROM p WHERE chain = c2 GROUP BY ALL), gd AS (SELECT k, chain, row, avg(score) AS m FROM p WHERE chain <> c2 GROUP BY ALL)
        SELECT k AS l_orderkey, CAST(-1 AS BIGINT) AS chain, 'ptm' AS kind, round(max(m), 6) AS score FROM ga GROUP BY k UNION ALL SELECT k, -1, 'iptm', round(max(m), 6) FROM gb GROUP BY k
        UNION ALL SELECT k, chain, 'chain_ptm', round(max(m), 6) FROM gc GROUP BY k, chain UNION ALL SELECT k, chain, 'chain_iptm', round(max(m), 6) FROM gd GROUP BY k, chain""",
    "typed_lddt": f"""
        WITH {_PAIRS} SELECT kind, k2 AS kind_2, chain <> c2 AS between, count(*) AS pairs, round(avg(CASE WHEN t < 15 THEN ((abs(t - m) < 0.5)::INT + (abs(t - m) < 1)::INT + (abs(t - m) < 2)::INT + (abs(t - m) < 4)::INT) / 4 END), 6) AS lddt,
            round(sqrt(avg((t - m) * (t - m))), 6) AS drmsd, round(avg(greatest(0, 1.1 - m) / 1.1), 6) AS clash FROM p GROUP BY 1, 2, 3""",
    "model_selection": """
        SELECT l_partkey, round(0.5 * (arg_min(l_discount, ROW(l_tax, l_orderkey, l_linenumber, l_suppkey)) + max(l_discount)), 6) AS selection FROM lineitem GROUP BY 1""",
    "sample_ranking": """
        WITH s AS (SELECT l_orderkey, max(l_discount) AS i, max(l_tax) AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1),
        r AS (SELECT o_custkey, o_orderkey, round(0.8 * i + 0.2 * p - CASE WHEN q > 45 THEN 1 ELSE 0 END, 6) AS score FROM orders JOIN s ON l_orderkey = o_orderkey)
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS rank FROM r""",
}
