"""Functions in plain SQL, readers by extension, fingerprints, and the cursor of a stream across restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import sequences, session
from quarry.operators import fingerprints, templates
from quarry.streaming import cursor


def test_functions_in_sql(spark):
    names = session.register(spark)
    assert {"parse_a3m", "index_map", "cigar_positions"} <= set(names)
    spark.createDataFrame([("f", "# note\n>q x\nACD-E\n>h/1-4\nA-ab\nDFE\n\n"), ("g", "")], "file string, content string").createOrReplaceTempView("files")
    got = spark.sql("SELECT file, p.* FROM files, LATERAL parse_a3m(content) p ORDER BY row_idx").collect()
    assert [(r.file, r.row_idx, r.header, r.aligned, r.deletions) for r in got] == [("f", 0, "q x", "ACD-E", [0] * 5), ("f", 1, "h/1-4", "A-DFE", [0, 0, 2, 0, 0])]
    both = spark.sql("SELECT q, t, c FROM VALUES ('A--CD', '-T-GE', '3M2I1D2X'), ('ACD', 'ACD', '5M'), (NULL, 'A', NULL) AS v(q, t, c)")
    same = both.select(
        F.expr("index_map(q, t, 3, 7)").alias("a"), templates.index_map(F.col("q"), F.col("t"), F.lit(3), F.lit(7)).alias("b"),
        F.expr("cigar_positions(c, 1, 2)").alias("x"), sequences.cigar_positions(F.col("c"), F.lit(1), F.lit(2)).alias("y"),
    ).collect()
    plain = lambda rows: None if rows is None else [tuple(r) for r in rows]
    assert all(plain(r.a) == plain(r.b) and plain(r.x) == plain(r.y) for r in same) and plain(same[0].x)[:4] == [(1, 2), (2, 3), (3, 4), (4, -1)]
    assert spark.sql("SELECT header_species('tr|A0A1|A0A1_9BACT/19-121') AS s").first().s == "9BACT"


def test_readers_by_extension(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a\nAC\n")
    (tmp_path / "x.tab").write_text("1\t2\n")
    assert session.read(spark, str(tmp_path / "x.fasta")).first().sequence == "AC"
    with pytest.raises(ValueError, match="no reader"):
        session.read(spark, str(tmp_path / "x.tab"))
    session.register_reader(".tab", lambda s, p: s.read.csv(p, sep="\t"))
    assert tuple(session.read(spark, str(tmp_path / "x.tab")).first()) == ("1", "2")
    with pytest.raises(ValueError):
        session.register_reader("tab", None)


def test_fingerprints_against_sets(spark):
    rng = np.random.default_rng(5)
    base = [set(rng.choice(128, 30, replace=False).tolist()) for _ in range(12)]
    sets = [set(b) ^ set(rng.choice(128, k, replace=False).tolist()) for b in base for k in (0, 0, 1, 3, 8, 40)] + [set(), {0}, {0}, {63, 64, 127}]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id int, numbers array<int>").select("id", fingerprints.packed(F.col("numbers"), 128).alias("fingerprint"), "numbers")
    assert all(r.b == r.numbers for r in rows.select("numbers", fingerprints.unpacked(F.col("fingerprint")).alias("b")).collect())
    rows = rows.unionByName(rows.limit(1).select(F.lit(999).alias("id"), F.lit(None).cast("array<bigint>").alias("fingerprint"), "numbers"))
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else None
    for threshold, strict in ((0.85, False), (0.4, True), (1.0, False), (0.5, False)):
        queries = rows.where("id % 5 = 0 OR id > 70")
        got = {(r["query"], r.target): r.similarity for r in fingerprints.similar(queries, rows, threshold, strict).collect()}
        want = {(i, j): s for i, a in enumerate(sets) if i % 5 == 0 or i > 70 for j, b in enumerate(sets) if (s := alike(a, b)) is not None and (s > threshold if strict else s >= threshold)}
        assert got == pytest.approx(want)
    assert fingerprints.similar(rows.limit(0), rows, 0.5).count() == 0
    with pytest.raises(ValueError):
        fingerprints.similar(rows, rows, 0.0)


def test_cursor_goes_on_after_a_restart(spark, tmp_path):
    asked, state, out = (str(tmp_path / x) for x in ("asked", "state", "out"))
    schema = "dataset string, request long, count long"

    def serve(rows, sizes):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(asked)
        stream = cursor.in_order(spark.readStream.schema(schema).parquet(asked), sizes)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return {(r.dataset, r.request): [] for r in spark.read.parquet(out).collect()}

    serve([("a", 1, 3), ("b", 1, 2), ("a", 0, 2), ("a", 9, None), (None, 1, 1)], {"a": 7, "b": 100})
    serve([("a", 2, 4), ("b", 2, 1)], {"a": 7, "b": 100})  # another run from the same checkpoint
    rows = spark.read.parquet(out).orderBy("dataset", "request", "place").collect()
    assert [(r.request, r.position, r.epoch) for r in rows if r.dataset == "a"] == [(0, 0, 0), (0, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 0), (2, 5, 0), (2, 6, 0), (2, 0, 1), (2, 1, 1)]
    assert [r.position for r in rows if r.dataset == "b"] == [0, 1, 2]
    with pytest.raises(Exception, match="but 7 when its place was kept"):
        serve([("a", 3, 1)], {"a": 8, "b": 100})
    with pytest.raises(Exception, match="not among those"):
        serve([("c", 1, 1)], {"a": 7, "b": 100})
