"""Sequences: runs, occurrences, profiles, identities, headers, pairing. Texts stand for sequences, users for species."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions import sequences as fs
from quarry.operators import order, sequence
from quarry.operators.durable import cut, stored
from quarry.sources.tables import read_table

#: First texts of languages that are broadcast; of more, the join shuffles.
QUERIES_SENT = 100


def running_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: runs of equal event types are one token, but each purchase is its own."""
    events = read_table(spark, sf_dir, "events")
    own = F.when(F.col("event_type") == "purchase", F.concat(F.lit("#"), F.col("event_id").cast("string"))).otherwise(F.col("event_type"))
    return sequence.run_number(events, own, ["user_id"], ["ts", "event_id"], "token_id").select("event_id", "user_id", "token_id")


def uniquify_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = sequence.occurrence(["user_id", "event_type"], ["ts", "event_id"])
    return read_table(spark, sf_dir, "events").select("event_id", F.concat_ws("_", "event_type", k.cast("string")).alias("unique_id"))


def sym_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running number of a line among those of its order with the same supplier."""
    k = sequence.occurrence(["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"])
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", k.cast("bigint").alias("sym_id"))


def residue_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("length(text) > 0")
    return sequence.profile(docs, ["lang"], F.lower("text")).withColumn("share", F.round("share", 8))


def identity_coverage_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and coverage of each text to its language's first text, letter by letter; best first."""
    gapped = F.regexp_replace("text", r"[ \n]", "-")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", gapped.alias("s"))
    # the smallest ids first, so no text is sorted or shuffled but the chosen ones
    first = cut(docs.where("s IS NOT NULL").groupBy("lang").agg(F.min("doc_id").alias("doc_id")).where("lang IS NOT NULL AND doc_id IS NOT NULL"))
    few = first.count() <= QUERIES_SENT
    chosen = docs.join(F.broadcast(first) if few else first, ["lang", "doc_id"]).where("s IS NOT NULL").groupBy("lang").agg(F.min("s").alias("q"))
    query = cut(chosen.withColumn("residues", F.length(F.replace("q", F.lit("-"), F.lit(""))).cast("long")))
    both = docs.join(F.broadcast(query) if few else query, "lang").where("length(q) > 0 OR length(s) > 0")
    # no more of the query than the text has, so a row is no longer than its text allows
    short = both.select("doc_id", "lang", "residues", F.expr("substring(q, 1, coalesce(length(s), 0))").alias("q"), "s")
    share = lambda k: F.round(F.when(F.col("residues") > 0, F.col(k) / F.nullif("residues", F.lit(0).cast("long"))), 6)
    rows = stored(sequence.compared(short, "q", "s").select("doc_id", "lang", share("matches").alias("identity"), share("covered").alias("coverage")), "identities")
    return order.ranks(rows.withColumn("worse", -F.col("identity")), ["lang"], ["worse", "doc_id"], "rank").drop("worse")


def species_pairing_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    paired = sequence.paired_rows(rows, "event_type", "user_id", ["ts", "event_id"], 5, 600)
    return paired.select("event_id", "user_id", "event_type", F.col("k").cast("bigint").alias("k"), "level")


def main_minus_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the main sources, in order of source, that equal no paired row of their group."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").alias("s"))
    paired = docs.where("source IN ('src0', 'src1', 'src2')").select("lang", "s").distinct()
    main = docs.where("source NOT IN ('src0', 'src1', 'src2')").join(paired, ["lang", "s"], "left_anti")
    return main.withColumn("row_idx", F.row_number().over(W.partitionBy("lang").orderBy("source", "doc_id")).cast("bigint")).select("doc_id", "lang", "row_idx")


def header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = fs.header_fields(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", F.size(fields).cast("bigint").alias("n_fields"), F.coalesce(F.get(fields, 3), F.lit("")).alias("fourth"))


def query_seed_cross_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in order of size, once for each seed, with their place."""
    size = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("size"))
    seeds = F.explode(F.array(F.lit(42), F.lit(43))).alias("seed")
    return order.positions(size.select("conv_id", "size", seeds), ["size", "conv_id", "seed"]).select("conv_id", "size", "seed", "position")


def skip_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations for which some expected turn (0 to 3, by two seeds) is missing."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    expected = turns.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("turn"))
    return expected.join(turns.distinct(), ["conv_id", "turn"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("n_missing"))


def collab_dedup_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: distinct texts and an order-independent digest of their digests, where there are several."""
    docs = read_table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("rep")).distinct()
    lanes = [F.sum(F.conv(F.substring("rep", at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 16, 31, 46)]
    groups = docs.groupBy("source").agg(F.count("*").alias("n_texts"), F.sha2(F.concat_ws("|", *lanes), 256).alias("complex_id"))
    return groups.where("n_texts > 1").select("source", "n_texts", "complex_id")


def smooth_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return sequence.smooth_reflected(events, "value", ["user_id"], ["ts", "event_id"], 3).select("event_id", F.round("smoothed", 6).alias("smoothed"))


def lead_gap_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without a gap of more than a year between consecutive shipments."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate").distinct()
    gap = F.datediff(F.lead("l_shipdate").over(W.partitionBy("l_partkey").orderBy("l_shipdate")), "l_shipdate")
    return lines.withColumn("gap", gap).groupBy("l_partkey").agg(F.coalesce(F.max("gap"), F.lit(0)).cast("bigint").alias("max_gap")).where("max_gap <= 365")


NAMES = """running_token_index uniquify_ids sym_id residue_profile identity_coverage_sort species_pairing_level main_minus_paired header_split
query_seed_cross_sorted skip_completed collab_dedup_sha smooth_reflect lead_gap_removal""".split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLE_SQL = {
    "running_token_index": """
        WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN '#' || event_id ELSE event_type END AS v FROM events),
        s AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM v THEN 1 ELSE 0 END AS b FROM e)
        SELECT event_id, user_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS token_id FROM s""",
    "uniquify_ids": "SELECT event_id, event_type || '_' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS unique_id FROM events",
    "sym_id": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS sym_id FROM lineitem",
    "residue_profile": """
        WITH t AS (SELECT lang, lower(text) AS s, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE length(text) > 0),
        c AS (SELECT lang, n, i - 1 AS "column", substr(s, CAST(i AS INT), 1) AS residue FROM t, LATERAL (SELECT unnest(range(1, length(s) + 1)) AS i))
        SELECT lang, "column", residue, round(count(*) / any_value(n), 8) AS share FROM c GROUP BY 1, 2, 3""",
    "identity_coverage_sort": f"""
        WITH d AS (SELECT doc_id, lang, regexp_replace(text, '[ \\n]', '-', 'g') AS s FROM documents),
        q AS (SELECT lang, arg_min(s, doc_id) AS q FROM d GROUP BY 1),
        c AS (SELECT doc_id, lang, coalesce(nullif(substr(q, CAST(i AS INT), 1), ''), '-') AS a, coalesce(nullif(substr(s, CAST(i AS INT), 1), ''), '-') AS b FROM d JOIN q USING (lang), LATERAL (SELECT unnest(range(1, greatest(length(q), length(s)) + 1)) AS i)),
        m AS (SELECT doc_id, lang, round(count(*) FILTER (a = b AND a <> '-') / count(*) FILTER (a <> '-'), 6) AS identity, round(count(*) FILTER (a <> '-' AND b <> '-') / count(*) FILTER (a <> '-'), 6) AS coverage FROM c GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY identity DESC, doc_id) AS rank FROM m""",
    "species_pairing_level": """
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events),
        l AS (SELECT *, count(*) OVER (PARTITION BY user_id, k) AS level, max(c) OVER (PARTITION BY user_id) AS m FROM n)
        SELECT event_id, user_id, event_type, k, level FROM l WHERE level BETWEEN 2 AND 5 AND m <= 600""",
    "main_minus_paired": f"""
        WITH d AS (SELECT doc_id, lang, source, text AS s FROM documents)
        SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS row_idx FROM d
        WHERE source NOT IN ('src0', 'src1', 'src2') AND NOT EXISTS (SELECT 1 FROM d p WHERE p.source IN ('src0', 'src1', 'src2') AND p.lang = d.lang AND p.s = d.s)""",
    "header_split": "SELECT page_id, CAST(len(f) AS BIGINT) AS n_fields, coalesce(f[4], '') AS fourth FROM (SELECT page_id, string_split_regex(url, '[|_/:-]') AS f FROM pages)",
    "query_seed_cross_sorted": "SELECT conv_id, CAST(size AS BIGINT) AS size, CAST(seed AS INTEGER) AS seed, row_number() OVER (ORDER BY size, conv_id, seed) - 1 AS position FROM (SELECT conv_id, sum(length(text)) AS size FROM conversations GROUP BY 1), (VALUES (42), (43)) s(seed)",
    "skip_completed": """
        SELECT conv_id, count(*) AS n_missing FROM (SELECT DISTINCT conv_id FROM conversations) c, range(4) t(turn)
        WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = t.turn) GROUP BY 1""",
    "collab_dedup_sha": """
        SELECT source, count(*) AS n_texts, sha256(concat_ws('|', """
    + ", ".join(f"CAST(sum(('0x' || substr(r, {at}, 15))::HUGEINT) AS VARCHAR)" for at in (1, 16, 31, 46))
    + """)) AS complex_id FROM (SELECT DISTINCT source, sha256(text) AS r FROM documents) GROUP BY 1 HAVING count(*) > 1""",
    "smooth_reflect": """
        WITH e AS (SELECT event_id, user_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        p AS (SELECT event_id, user_id, CASE WHEN n = 1 THEN 0 ELSE (n - 1) - abs((n - 1) - ((i + d) % (2 * (n - 1)) + 2 * (n - 1)) % (2 * (n - 1))) END AS j FROM e, range(-3, 4) t(d))
        SELECT p.event_id, round(avg(e.value), 6) AS smoothed FROM p JOIN e ON e.user_id = p.user_id AND e.i = p.j GROUP BY 1""",
    "lead_gap_removal": """
        WITH d AS (SELECT DISTINCT l_partkey, l_shipdate FROM lineitem), g AS (SELECT l_partkey, date_diff('day', CAST(l_shipdate AS DATE), CAST(lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS DATE)) AS gap FROM d)
        SELECT l_partkey, coalesce(max(gap), 0) AS max_gap FROM g GROUP BY 1 HAVING coalesce(max(gap), 0) <= 365""",
}
