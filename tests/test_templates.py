"""Templates: readers, checks, chains, samples and residues, on hand-made rows with nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import templates as t
from quarry.sources import alignments

HIT = "query long, index int, entry string, chain string, sequence string"


def test_readers_agree_on_hits(spark, tmp_path):
    (tmp_path / "a.a3m").write_text(">q\nACDE-F\n>1abc_A/5-9 mol:protein length:9\nA-DxEKF\n")
    (tmp_path / "b.sto").write_text("# STOCKHOLM 1.0\n#=GS 1abc_A/5-9 DE mol:protein length:9\nq AC.DE\n1abc_A/5-9 AKYDE\n//\n")
    (tmp_path / "c.txt").write_text("none")
    (tmp_path / "d.a3m").write_text("")
    rows = alignments.read_template_hits(spark, str(tmp_path)).orderBy("file", "index").collect()
    assert [(r.file, r["index"], r.entry_id, r.chain_id, r.start, r.aligned) for r in rows] == [
        ("a.a3m", 0, "q", "1", 1, "ACDE-F"), ("a.a3m", 1, "1abc", "A", 5, "A-DxEKF"), ("b.sto", 0, "q", "1", 1, "ACDE"), ("b.sto", 1, "1abc", "A", 5, "AKyDE"),
    ]
    assert alignments.read_template_hits(spark, str(tmp_path), 0).count() == 2
    maps = alignments.read_template_hits(spark, str(tmp_path / "a.a3m")).where("index = 1").select(t.index_map(F.col("query"), F.col("aligned"), F.lit(1), F.col("start")).alias("m")).first().m
    assert [tuple(p) for p in maps] == [(1, 5), (2, -1), (3, 6), (4, 8), (-1, 9), (5, 10)]
    (tmp_path / "e.a3m").write_text(">q\nAC\n>1abc_A/1-2 mol:na\nAC\n")
    (tmp_path / "f.a3m").write_text(">q\nAC\n>plain mol:protein\nAC\n>2xyz_B/1-2 mol:protein\nAC\n")
    rows = alignments.read_template_hits(spark, [str(tmp_path / x) for x in ("e.a3m", "f.a3m")]).where("index > 0").orderBy("file", "index").collect()
    assert [(r.entry_id, r.reason) for r in rows] == [(None, "no protein"), (None, "no residues in its name"), ("2xyz", None)]


def test_index_map_drops_columns_of_two_gaps(spark):
    m = spark.range(1).select(t.index_map(F.lit("A--C"), F.lit("-T-G"), F.lit(3), F.lit(7)).alias("m")).first().m
    assert [tuple(p) for p in m] == [(3, -1), (-1, 7), (4, 8)]


def test_checks(spark):
    rows = spark.createDataFrame([(0.95, 0.1, 10, "2020-01-01"), (0.96, 0.5, 20, "2020-01-02"), (0.5, 0.05, 20, None), (None, 0.5, 20, "2019-12-01")], "i double, c double, n int, d string")
    got = rows.select(
        t.fails_sequence_checks(F.col("i"), F.col("c"), F.col("n"), 0.95, 0.1, 10).alias("s"), t.fails_sequence_checks(F.col("i"), F.col("c"), F.col("n")).alias("none"),
        t.fails_release_checks(F.col("d").cast("date"), F.lit("2020-03-01").cast("date"), "2020-01-01", 60).alias("r"),
    ).collect()
    assert [r.s for r in got] == [False, True, True, True] and not any(r.none for r in got)
    assert [r.r for r in got] == [False, True, True, False]


def test_chains(spark):
    hits = spark.createDataFrame([(1, 1, "e", "B", "CD"), (1, 2, "e", "A", "CD"), (1, 3, "e", None, "CD"), (1, 4, "e", "A", "XX"), (2, 1, "f", "A", "CD"), (2, 2, "e", "B", None)], HIT)
    chains = spark.createDataFrame([("e", "A", 0, "AAA"), ("e", "C", 2, "ACDE"), ("e", "B", 1, "CDE"), ("e", "D", 3, None)], "entry string, chain string, place int, sequence string")
    got = t.matched_chains(hits, chains, ["query", "index"]).orderBy("query", "index").collect()
    assert [(r["query"], r["index"], r.chain, r.remapped) for r in got] == [(1, 1, "B", False), (1, 2, "B", True), (1, 3, "B", True)]
    assert t.matched_chains(hits.limit(0), chains, ["query", "index"]).count() == 0


def test_first_and_samples(spark):
    hits = spark.createDataFrame([(q, i, f"e{i % 6}", "A", "X") for q in range(40) for i in range(1, 9)] + [(99, 1, "e1", "A", "X")], HIT)
    assert [r["index"] for r in t.first_templates(hits, 2).where("query = 3").orderBy("rank").collect()] == [1, 2]
    there = spark.createDataFrame([("e1",), ("e2",), ("e2",), ("e5",)], "entry string")
    top = t.sampled_templates(hits, there, 2, True)
    assert [r["index"] for r in top.where("query = 3").orderBy("index").collect()] == [1, 2]
    drawn = [r.n for r in t.sampled_templates(hits, there, 3, False).groupBy("query").agg(F.count("*").alias("n")).collect()]
    # each query has five; from none to four are drawn, three at most; of a single one none
    assert set(drawn) == {1, 2, 3} and len(drawn) < 40 and t.sampled_templates(hits, there, 3, False).where("query = 99").count() == 0
    assert sorted(t.sampled_templates(hits, there, 3, False).collect()) == sorted(t.sampled_templates(hits.repartition(7), there, 3, False).collect())


def test_residues_of_tokens(spark):
    maps = spark.createDataFrame([(1, "a", 1, 10), (1, "a", 2, -1), (1, "a", -1, 11), (1, "a", 3, 12), (1, "a", 9, 99), (1, "b", 1, 10), (1, "c", 1, 77)], "query long, entry string, q int, t int")
    tokens = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 3), (1, 3, 2)], "query long, token int, residue int")
    residues = spark.createDataFrame([("a", 10), ("a", 12), ("b", 10), ("b", 10), ("c", 1)], "entry string, residue int")
    got = t.tokens_to_template(maps, tokens, residues).collect()
    # b has residue 10 twice, c hasn't 77: both go; residue 9 is not in the crop
    assert sorted((r.entry, r.token, r.q, r.t) for r in got) == [("a", 0, 1, 10), ("a", 1, 3, 12), ("a", 2, 3, 12)]
    assert t.tokens_to_template(maps.limit(0), tokens, residues).count() == 0
