"""Writers: CIF texts that read back, a file for each sample, and counts of failures."""

import glob

import pytest
from pyspark.sql import functions as F

from quarry.sources import structures, writers

ATOM = "file string, atom_idx int, hetero boolean, element string, atom_name string, res_name string, chain_id string, entity_id string, res_id int, x double, y double, z double, occupancy double, b_factor double, auth_chain_id string, model int, alt_id string"
ROWS = [
    ("a", 0, False, "N", "N", "MET", "A", "1", 1, 1.5, -2.0, 3.25, 1.0, 10.0, "A", 1, None),
    ("a", 1, True, "P", "O5'", "L G", "B b", "2", None, 9.0, 9.0, 9.0, 0.5, None, "", 1, None),
    ("a", 2, True, "C", 'C"1', "_X", "?", ".", 3, 0.0, 0.0, 1e-7, 1.0, 0.0, "loop_", 1, None),
    ("b c", 0, False, "C", "CA", "ALA", "A", "1", 1, 0.0, 0.0, 0.0, 1.0, 1.0, "A", 1, None),
]


def test_structures_read_back(spark, tmp_path):
    atoms = spark.createDataFrame(ROWS, ATOM)
    texts = writers.cif_text(atoms.repartition(3))
    out = str(tmp_path / "out")
    writers.write_samples(texts.withColumn("name", F.translate("file", " ", "_")), out, ["name"])
    files = glob.glob(f"{out}/*/*.txt")
    assert len(files) == 2 and glob.glob(f"{out}/_SUCCESS")
    back = structures.read_mmcif_atoms(spark, sorted(files))
    got = sorted(tuple(r)[1:] for r in back.collect())
    assert got == sorted(r[1:] for r in ROWS)
    assert writers.cif_text(atoms.limit(0)).count() == 0
    for bad in ("two\nlines", "both' and\" "):
        with pytest.raises(Exception, match="can't hold"):
            spark.range(1).select(writers.cif_value(F.lit(bad))).collect()
    with pytest.raises(ValueError, match="more than one text"):
        writers.write_samples(texts.withColumn("name", F.lit("x")), str(tmp_path / "twice"), ["name"])


def test_summary_counts_failures(spark):
    rows = spark.createDataFrame([("q", 1, True, None), ("q", 2, False, "memory"), ("q", 3, False, "memory"), ("q", 4, None, None), ("r", 1, True, None)], "query string, seed int, ok boolean, reason string")
    got = {r["query"]: (r.samples, r.failures, r.reasons) for r in writers.summary(rows, ["query"], ~F.col("ok")).collect()}
    assert got == {"q": (4, 3, {"memory": 2, "unknown": 1}), "r": (1, 0, None)}
    assert writers.summary(rows.limit(0), ["query"], ~F.col("ok")).count() == 0
