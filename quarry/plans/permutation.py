"""Symmetric instances put into the order of a prediction; 24 vectors stand for a structure, their first numbers for points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import permutation
from quarry.plans.spatial import atoms
from quarry.sources.tables import read_table


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six points of one entity, and three instances of six points of another."""
    at = F.col("vec_id") % 24
    rows = atoms(spark, sf_dir).withColumn("structure", F.floor(F.col("vec_id") / 24))
    rows = rows.withColumn("entity", F.when(at < 6, 0).otherwise(1).cast("long")).withColumn("sym", F.when(at < 6, 0).otherwise(F.floor(at / 6) - 1).cast("long"))
    return rows.select("vec_id", "structure", "entity", "sym", (at % 6).alias("token"), "x", "y", "z", (F.col("vec_id") % 11 != 0).alias("resolved"), F.lit(False).alias("ligand"))


def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole structures of the truth, turned by a right angle and moved, their instances dealt round by the structure's number."""
    rows = truth(spark, sf_dir)
    whole = rows.groupBy("structure").agg(F.count("*").alias("n")).where("n = 24").select("structure")
    rows = rows.join(whole, "structure").withColumn("sym", F.when(F.col("entity") == 1, (F.col("sym") + F.col("structure")) % 3).otherwise(F.col("sym")))
    return rows.select("structure", "entity", "sym", "token", (F.col("y") + 3).alias("x"), (-F.col("x")).alias("y"), (F.col("z") - 1).alias("z"))


def instance_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true instance of each predicted one, and the turn back."""
    found = permutation.molecule_permutation(truth(spark, sf_dir), prediction(spark, sf_dir))
    turn = F.array_join(F.transform("rotation", lambda x: F.round(x).cast("int").cast("string")), ",")
    return found.select("structure", "entity", "sym", "true_sym", "anchor_entity", turn.alias("turn"))


def permuted_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each prediction is from the truth that it stands for, once turned back."""
    true, pred = truth(spark, sf_dir), prediction(spark, sf_dir)
    found = permutation.molecule_permutation(true, pred)
    pairs = permutation.permuted_rows(pred, true, found).join(found.select("structure", "entity", "sym", "rotation", "shift"), ["structure", "entity", "sym"])
    x, y, z = permutation.moved(pairs, ("x", "y", "z"))
    at = pairs.select("structure", "true_resolved", "true_x", "true_y", "true_z", x, y, z)
    square = sum(((F.col(c) - F.col(f"true_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return at.groupBy("structure").agg(F.count("*").alias("n"), F.count_if("true_resolved").alias("n_resolved"), F.round(F.sqrt(F.avg(F.when(F.col("true_resolved"), square))), 3).alias("rmsd"))


def best_atom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as components: the order, of three, in which a part's first four lines come nearest to their places by quantity."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("structure"), F.col("l_linenumber").alias("component"), "l_quantity", "l_discount")
    sums = rows.groupBy("structure", "component").agg(*(F.sum(F.when(F.floor(F.col("l_quantity")) % 4 == i, F.col("l_quantity"))).cast("double").alias(f"q{i}") for i in range(4)))
    point = lambda i, x: F.struct(F.lit(i).alias("atom"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), x.isNotNull().alias("resolved"))
    true = sums.select("structure", "component", F.explode(F.array(*(point(i, F.col(f"q{i}")) for i in range(4)))).alias("p")).select("structure", "component", "p.*")
    pred = true.withColumn("x", F.lit(100.0) * ((F.col("atom") + F.col("structure")) % 4)).drop("resolved")
    orders = sums.select("structure", "component", F.explode(F.array(*(F.struct(F.lit(k).alias("order_no"), F.array(*map(F.lit, o)).alias("order")) for k, o in enumerate(ORDERS)))).alias("o"))
    best = permutation.best_orders(pred, true, orders.select("structure", "component", "o.*"))
    return best.select("structure", "component", F.col("order_no").cast("long").alias("order_no"))


ORDERS = ((0, 1, 2, 3), (1, 2, 3, 0), (3, 2, 1, 0))
QUERIES = {"instance_permutation": instance_permutation, "permuted_distance": permuted_distance, "best_atom_order": best_atom_order}

#: The prediction is the truth under a known deal, turn and shift, so what must come out is known.
_WHOLE = "w AS (SELECT CAST(floor(vec_id / 24) AS BIGINT) AS structure FROM embeddings GROUP BY 1 HAVING count(*) = 24)"
ORACLE_SQL = {
    "instance_permutation": f"""WITH {_WHOLE}, s(entity, sym) AS (VALUES (0, 0), (1, 0), (1, 1), (1, 2))
        SELECT structure, CAST(entity AS BIGINT) AS entity, CAST(sym AS BIGINT) AS sym, CASE WHEN entity = 0 THEN 0 ELSE (sym + 2 * structure) % 3 END AS true_sym, CAST(0 AS BIGINT) AS anchor_entity, '0,-1,0,1,0,0,0,0,1' AS turn FROM w, s""",
    "permuted_distance": f"""WITH {_WHOLE} SELECT structure, count(*) AS n, count(*) FILTER (vec_id % 11 <> 0) AS n_resolved, CAST(0 AS DOUBLE) AS rmsd
        FROM embeddings JOIN w ON structure = floor(vec_id / 24) GROUP BY 1""",
    "best_atom_order": """
        WITH s AS (SELECT l_suppkey AS structure, l_linenumber AS component, """
    + ", ".join(f"CAST(sum(l_quantity) FILTER (floor(l_quantity) % 4 = {i}) AS DOUBLE) AS q{i}" for i in range(4))
    + """ FROM lineitem GROUP BY 1, 2),
        t AS (SELECT structure, component, [q0, q1, q2, q3] AS q, (CASE WHEN q0 IS NULL THEN 0 ELSE 1 END + CASE WHEN q1 IS NULL THEN 0 ELSE 1 END + CASE WHEN q2 IS NULL THEN 0 ELSE 1 END + CASE WHEN q3 IS NULL THEN 0 ELSE 1 END) AS n FROM s),
        o(order_no, o) AS (VALUES (0, [1, 2, 3, 4]), (1, [2, 3, 4, 1]), (2, [4, 3, 2, 1])),
        c AS (SELECT structure, component, order_no, sum((100 * ((i - 1 + structure) % 4) - q[o[i]]) ** 2) / nullif(max(n), 0) AS cost FROM t, o, (SELECT unnest(range(1, 5)) AS i) GROUP BY 1, 2, 3)
        SELECT structure, component, CAST(order_no AS BIGINT) AS order_no FROM c QUALIFY row_number() OVER (PARTITION BY structure, component ORDER BY coalesce(cost, -1), order_no) = 1""",
}
