"""Alignments over tokens, on hand-made rows with nulls, chains without alignments, and empty tables."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import msa

ROWS = [("x", "query", 0, "ACD", [0, 0, 0]), ("x", "main", 0, "A-D", [1, 0, 2]), ("x", "main", 1, "AC-", [0, 0, 4]), ("x", "far", 0, "GGG", [0, 0, 0]), ("x", "near", 0, "TTT", [9, 0, 0]), ("y", "query", 0, "KL", [0, 0])]


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.createDataFrame(ROWS, "rep string, source string, row long, aligned string, deletions array<int>")
    chains = spark.createDataFrame([(1, "A", "x"), (1, "B", "y"), (1, "C", None), (2, "A", "z")], "structure long, chain string, rep string")
    return rows, chains


def test_padding(spark):
    frame = spark.createDataFrame([(["A", "C"],), ([],)], "a array<string>")
    got = frame.select(msa.padded(F.col("a"), F.lit(3), F.lit("-")).alias("p"), msa.padding_mask(F.col("a"), F.lit(3)).alias("m")).collect()
    assert [(r.p, r.m) for r in got] == [(["A", "C", "-"], [1, 1, 0]), (["-"] * 3, [0, 0, 0])]
    with pytest.raises(Exception, match="longer than"):
        frame.select(msa.padded(F.col("a"), F.lit(1), F.lit("-"))).collect()


def test_counts(tables):
    rows, chains = tables
    count = lambda most, paired: {r.structure: r.n_rows for r in msa.row_counts(rows, chains, ("near", "far"), ("main",), most, paired).collect()}
    assert count(9, 9) == {1: 5, 2: 1} and count(9, 1) == {1: 4, 2: 1} and count(2, 9) == {1: 2, 2: 1}
    assert msa.row_counts(rows, chains.limit(0), ("near",), ("main",), 9, 9).count() == 0


def test_means(spark, tables):
    lengths = spark.createDataFrame([("x", 3), ("w", 2), ("v", 0)], "rep string, length int")
    got = msa.deletion_means(tables[0].where("source = 'main'"), lengths).orderBy("rep", "column").collect()
    assert [(r.rep, r.column, r["mean"]) for r in got] == [("w", 0, 0.0), ("w", 1, 0.0), ("x", 0, 0.5), ("x", 1, 0.0), ("x", 2, 3.0)]


def test_order_and_stack(tables):
    rows, chains = tables
    paired = msa.in_source_order(msa.for_chains(rows, chains), msa.CHAIN, ("near", "far"), 1).collect()
    assert [(r.chain, r.row, r.aligned) for r in paired] == [("A", 0, "TTT")]
    stack = lambda most: [(r.row, r.aligned) for r in msa.stacked(rows, "query", ("far", "near"), ("main",), most, 9).where("rep = 'x'").orderBy("row").collect()]
    assert stack(9) == [(0, "ACD"), (1, "GGG"), (2, "TTT"), (3, "A-D"), (4, "AC-")] and stack(2) == [(0, "ACD"), (1, "GGG")]


def test_tokens(spark, tables):
    rows, chains = tables
    tokens = spark.createDataFrame([(1, "A", 0, 3), (1, "A", 1, 1), (1, "A", 2, 1), (1, "A", 3, 7), (1, "B", 4, 2), (1, "C", 5, 1), (2, "A", 0, None)], "structure long, chain string, token int, residue int")
    counts = spark.createDataFrame([(1, 2), (2, 1)], "structure long, n_rows long")
    stack = msa.stacked(rows, "query", (), ("main",), 9, 0)
    got = {(r.structure, r.chain, r.row): ("".join(r.letters), r.deletions, r["mask"]) for r in msa.over_tokens(stack, chains, tokens, counts).collect()}
    assert got == {
        (1, "A", 0): ("DAA-", [0, 0, 0, 0], [1, 1, 1, 0]), (1, "A", 1): ("DAA-", [2, 1, 1, 0], [1, 1, 1, 0]), (1, "B", 0): ("L", [0], [1]), (1, "B", 1): ("-", [0], [0]),
        (1, "C", 0): ("-", [0], [0]), (1, "C", 1): ("-", [0], [0]), (2, "A", 0): ("-", [0], [0]),
    }
