"""Operators, readers and streams on hand-made inputs, with nulls, NaN, ties, empty tables and large n."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import sequences as fs
from quarry.operators import filters, geometry, graph, metrics, order, quality, sampling, sequence, similarity, spatial
from quarry.sources import alignments, structures
from quarry.streaming import events


@pytest.mark.parametrize(("n", "size", "expected"), [(15, 16, 16), (1, None, 1), (10, 4, 12), (1, 1, 1), (3, 1, 3), (1, 4, 4), (0, 4, 0)])
def test_padding(spark, n, size, expected):
    got = order.pad_to_multiple(spark.range(n).select(F.col("id").alias("a")), ["a"], size).collect()
    assert len(got) == expected and sum(r.repeated_sample for r in got) == expected - n
    assert sorted(r.a for r in got if r.repeated_sample) == sorted(i % n for i in range(expected - n)) if n else not got


def test_positions_and_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5).alias("w")).repartition(7)
    got = {r.k: r.position for r in order.positions(df, ["k"]).collect()}
    assert got == {i: i for i in range(1000)}
    weights = {r.k: r.w for r in df.collect()}
    running, _ = order.prefix_sum(df, ["k"], F.col("w"))
    total, want = 0, {}
    for k in range(1000):
        total += weights[k]
        want[k] = total
    assert {r.k: r.running for r in running.collect()} == want
    assert [r.place for r in order.cyclic(df, ["k"], 995, 12).orderBy("place").collect()] == list(range(12))
    assert order.positions(df.where("false"), ["k"]).count() == 0
    drawn = sampling.by_weight(df, "w", ["k"], 200, 2654435761).collect()
    assert len(drawn) == 200 and all(r.w > 0 for r in drawn) and sampling.by_weight(df.where("w = 0"), "w", ["k"], 5, 3).count() == 0


def test_filters(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    children = spark.createDataFrame([(1, "A"), (1, None), (2, "B"), (2, "B")], "k int, t string")
    assert {r.k for r in filters.having_at_most(parents, children, "k", F.col("t") == "B", 1).collect()} == {1, 3}
    assert {r.k for r in filters.for_all(parents, children, "k", F.col("t").isNotNull()).collect()} == {2, 3}
    values = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "v double")
    assert [r.v for r in values.where(filters.within(F.col("v"), high=4.0)).collect()] == [1.0, 4.0]
    kept, before, after = filters.observed(values, "nulls", lambda d: d.where("v IS NOT NULL"))
    assert kept.count() == 3 and before.get["n"] == 4 and after.get["n"] == 3


def test_sampling(spark):
    df = spark.createDataFrame([(k, c, i) for k in "AB" for c in range(10) for i in range(3)], "kind string, cluster int, i int")
    quota = F.when(F.col("kind") == "A", 4)
    one, two = (sampling.clusters_then_members(df.repartition(n), "kind", "cluster", quota, 7, ["kind", "cluster", "i"]).collect() for n in (1, 5))
    assert sorted(one) == sorted(two) and sum(r.kind == "A" for r in one) == 4 and sum(r.kind == "B" for r in one) == 10
    assert sampling.per_group(df, ["kind"], 999, [F.col("cluster"), F.col("i")]).count() == 60


def test_space(spark):
    rng = np.random.default_rng(0)
    at = rng.uniform(-1, 1, (120, 3))
    rows = [(i, *map(float, p)) for i, p in enumerate(at)] + [(900, float("nan"), 0.0, 0.0), (901, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, x double, y double, z double")
    got = {(r.a, r.b) for r in spatial.radius_join(df, df, 0.3).where("l.i < r.i").select(F.col("l.i").alias("a"), F.col("r.i").alias("b")).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if np.linalg.norm(at[i] - at[j]) <= 0.3}
    assert spatial.radius_join(df.where("false"), df, 0.3).count() == 0


def test_radius_pairs_once_from_half_of_the_cells(spark):
    rng = np.random.default_rng(5)
    points = [(int(i), *map(float, x)) for i, x in zip(rng.permutation(60), rng.uniform(-1, 1, (60, 3)), strict=True)]
    df = spark.createDataFrame([*points, (60, None, 0.0, 0.0), (61, float("nan"), 0.0, 0.0), points[0], (None, 0.0, 0.0, 0.0)], "i long, x double, y double, z double")
    pairs = spatial.radius_pairs(df, 0.4, "i")
    whole = spatial.radius_join(df, df, 0.4).where("l.i < r.i")
    columns = ("l.i", "r.i", "distance")
    got = sorted(map(tuple, pairs.select(*columns).collect()))
    assert got and got == sorted(map(tuple, whole.select(*columns).collect()))
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1  # not one for each axis
    assert spatial.radius_pairs(df.where("false"), 0.4, "i").count() == 0


def test_superposition_ignores_rigid_motion(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(30, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    noise = rng.normal(scale=0.1, size=(30, 3))
    rows = [("moved", *map(float, [*a, *b])) for a, b in zip(p, p @ q.T + 5, strict=True)] + [("noisy", *map(float, [*a, *b])) for a, b in zip(p, (p + noise) @ q.T - 2, strict=True)] + [("one", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double, e double, f double")
    got = {r.g: r.rmsd for r in geometry.aligned_rmsd(df, "g", ("a", "b", "c"), ("d", "e", "f")).collect()}
    assert got["moved"] < 1e-6 and got["one"] < 1e-6 and 0 < got["noisy"] <= math.sqrt((noise**2).sum() / 30) + 1e-9


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[101] == got[102] == 100
    assert graph.components(edges.where("false")).count() == 0


def test_jaccard(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f"), (3, "A b C d e"), (4, None), (5, "z")], "id int, t string").select("id", similarity.shingles(F.col("t"), 1).alias("items"))
    got = {(r.x, r.y): round(r.similarity, 4) for r in similarity.jaccard_join(df.withColumnRenamed("id", "x"), df.withColumnRenamed("id", "y"), 0.6, "x", "y").where("x < y").collect()}
    assert got == {(1, 2): 0.6667, (1, 3): 1.0, (2, 3): 0.6667}


def test_sequences(spark):
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate("aabbac")] + [("w", 0, None)], "g string, i int, v string")
    runs = sequence.run_number(df, F.col("v"), ["g"], ["i"], "run").orderBy("g", "i").collect()
    assert [r.run for r in runs] == [0, 0, 1, 1, 2, 3, 0]
    values = spark.createDataFrame([("n", i, float(i * i)) for i in range(5)] + [("one", 0, 3.0)], "g string, i int, x double")
    for half in (1, 3, 9):
        got = {(r.g, r.i): r.smoothed for r in sequence.smooth_reflected(values, "x", ["g"], ["i"], half).collect()}
        period = [0, 1, 2, 3, 4, 3, 2, 1]
        for i in range(5):
            assert got["n", i] == pytest.approx(np.mean([period[(i + d) % 8] ** 2 for d in range(-half, half + 1)]))
        assert got["one", 0] == pytest.approx(3.0)
    row = spark.range(1).select(
        fs.without_insertions(F.lit("ABcdE-f")).alias("kept"), fs.deletions_before(F.lit("ABcdE-f")).alias("deletions"), fs.cigar_positions(F.lit("2M1I1D2M"), F.lit(5), F.lit(9)).alias("at"),
        fs.group_digest(F.array(F.lit("b"), F.lit("a"))).alias("d1"), fs.group_digest(F.array(F.lit("a"), F.lit("b"))).alias("d2"), fs.one_hot(F.lit(2), 4).alias("hot"), fs.nearest_bin(F.lit(1.5), [0, 1, 2]).alias("bin"),
    ).first()
    assert row.kept == "ABE-" and row.deletions == [0, 0, 2, 0] and row.d1 == row.d2 and row.hot == [0, 0, 1, 0] and row.bin == 1
    assert [tuple(p) for p in row.at] == [(5, 9), (6, 10), (7, -1), (-1, 11), (8, 12), (9, 13)]


def test_metrics(spark):
    p = spark.createDataFrame([("s", i, float(i), 0.0, 0.0) for i in range(4)], "g string, k int, x double, y double, z double")
    both = metrics.pairs(p, "g", "k", ["x", "y", "z"])
    d = metrics.distance([F.col(f"a.{c}") for c in "xyz"], [F.col(f"b.{c}") for c in "xyz"])
    row = both.select(d.alias("d")).agg(metrics.lddt(F.col("d"), F.col("d"), 15.0).alias("l"), metrics.drmsd(F.col("d"), F.col("d") + 1).alias("r"), metrics.steric_clash(F.col("d"), 2.0).alias("c")).first()
    assert row.l == 1.0 and row.r == 1.0 and row.c == pytest.approx(6 * 0.5 / 12)
    even = spark.range(1).select(metrics.expected(metrics.softmax(F.array(*[F.lit(0.0)] * 5)), 0.0, 1.0, 5).alias("e")).first()
    assert even.e == pytest.approx(0.5)
    assert spark.createDataFrame([(0.5,), (3.0,), (9.0,)], "v double").agg(metrics.gdt_ts(F.col("v")).alias("g")).first().g == pytest.approx((1 + 1 + 2 + 2) / 12)


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", float("nan")), (2, "c", float("inf"))], "k int, v string, x double")
    suite = [quality.no_nan(df, "nan", ["x"]), quality.determines(df, "fd", ["k"], ["v"]), quality.unique(df, "key", ["k"]), quality.holds(df, "pos", F.col("x") > 0), quality.contained(df, df.where("k = 1"), "in", "k", "k")]
    assert [r.offenders for c in suite for r in c.collect()] == [2, 1, 1, 0, 1]


def test_alignment_files(spark, tmp_path):
    (tmp_path / "a.a3m").write_text(">q\nACD-E\n>h/1-4\nA-abDFE\n")
    (tmp_path / "b.sto").write_text("# STOCKHOLM 1.0\nq  AC-D\nh  ACFD\n\nq  EF\nh  -F\n//\n")
    got = {(r.file, r.row_idx): (r.header, r.aligned, r.deletions) for r in alignments.read_msa(spark, str(tmp_path)).collect()}
    assert got["a.a3m", 1] == ("h/1-4", "A-DFE", [0, 0, 2, 0, 0])
    assert got["b.sto", 0] == ("q", "ACDEF", [0] * 5) and got["b.sto", 1] == ("h", "ACD-F", [0, 0, 1, 0, 0])
    assert alignments.read_msa(spark, str(tmp_path), max_rows=1).count() == 2
    (tmp_path / "f.fasta").write_text(">x\nAC\nDE\n\n#note\n>y\nFG\n>x\nZZ\n")
    assert [(r.header, r.sequence) for r in alignments.first_by_header(alignments.read_fasta(spark, str(tmp_path / "f.fasta"))).orderBy("header").collect()] == [("x", "ACDE"), ("y", "FG")]
    (tmp_path / "h.m8").write_text("q\t1abc_A\t0.9\t5\t0\t0\t1\t5\t1\t5\t1e-3\t50\t5M\nq\t2xyz\t0.5\t5\t0\t0\t1\t5\t1\t5\t1e-9\t60\t5M\n")
    assert [(r.entry_id, r.chain_id, r["index"]) for r in alignments.read_m8(spark, str(tmp_path / "h.m8")).orderBy("index").collect()] == [("2xyz", "1", 1), ("1abc", "A", 2)]
    assert alignments.hit_header("1abc_A/5-80 mol:protein") == ("1abc", "A", 5, 80) and alignments.hit_header("plain") is None


def test_files_split_anywhere(spark, tmp_path):
    """Records and lines keep their numbers when a file is read in many blocks."""
    rng = np.random.default_rng(0)
    want = [(f"r{i} a>b", "".join(rng.choice(list("ACDE"), rng.integers(0, 90)))) for i in range(400)]
    cut = lambda s: "\r\n".join(s[k : k + 20] for k in range(0, len(s), 20))
    (tmp_path / "x.fasta").write_text("# a note\n\n" + "\n".join(f">{h}\n{cut(s)}\n\n#skip" for h, s in want) + "\n", newline="")
    names = [f"n{i}" for i in range(30)]
    rows = {n: "".join(rng.choice(list("AC-."), 120)) for n in names}
    (tmp_path / "y.sto").write_text("# STOCKHOLM 1.0\n" + "\n\n".join("\n".join(f"{n}   {rows[n][k : k + 30]}" for n in names) for k in range(0, 120, 30)) + "\n//\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = alignments.read_fasta(spark, str(tmp_path / "x.fasta"))
        assert alignments.fasta_records(spark, str(tmp_path / "x.fasta")).select("block").distinct().count() > 5
        assert [(r.row_idx, r.header, r.sequence) for r in got.orderBy("row_idx").collect()] == [(i, h, s) for i, (h, s) in enumerate(want)]
        sto = alignments.read_msa(spark, str(tmp_path / "y.sto")).orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.header for r in sto] == names
    keep = [i for i, c in enumerate(rows["n0"]) if c not in "-."]
    for r in sto:
        assert r.aligned == "".join(rows[r.header][i] for i in keep)
        assert r.deletions == [sum(c not in "-." for c in rows[r.header][a + 1 : b]) for a, b in zip([-1, *keep], keep)]


CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_entity_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.auth_asym_id
_atom_site.pdbx_PDB_model_num
ATOM 1 N N . MET A 1 1 1.0 2.0 3.0 1.00 10.0 A 1
ATOM 2 C CA A MET A 1 1 1.5 2.0 3.0 0.40 10.0 A 1
ATOM 3 C CA B MET A 1 1 1.6 2.0 3.0 0.60 10.0 A 1
HETATM 4 P "O5'" . LIG B 2 . 9.0 9.0 9.0 1.00 ? B 1
ATOM 5 N N . MET A 1 1 7.0 2.0 3.0 1.00 10.0 A 2
#
"""


def test_structure_files(spark, tmp_path):
    (tmp_path / "x.cif").write_text(CIF)
    rows = structures.read_mmcif_atoms(spark, str(tmp_path)).orderBy("atom_idx").collect()
    assert [(r.atom_name, r.x, r.res_id) for r in rows] == [("N", 1.0, 1), ("CA", 1.6, 1), ("O5'", 9.0, None)] and rows[2].hetero and rows[2].b_factor is None


def test_metadata_round_trip(spark, tmp_path):
    doc = {
        "_type": "metadata", "name": "t",
        "structure_data": {f"test{i}": {"status": "success", "resolution": None, "token_count": 3, "release_date": "2020-01-01", "chains": {"A": {"alignment_representative_id": None, "template_ids": ["x"], "index": i, "molecule_type": "PROTEIN"}}} for i in range(2)},
        "reference_molecule_data": {"m": {"conformer_gen_strategy": "default", "fallback_conformer_pdb_id": None, "canonical_smiles": "C", "set_fallback_to_nan": False}},
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    tables = structures.read_metadata(spark, str(tmp_path / "d.json"))
    structures.metadata_parts("t", *tables).write.json(str(tmp_path / "out"))
    assert structures.metadata_parts("t", *tables).count() == 3
    for one, other in zip(tables, structures.read_metadata(spark, str(tmp_path / "out"), lines=True), strict=True):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_streams(spark, tmp_path):
    rows = [(i % 20, f"2024-01-01 00:{i % 60:02}:00", 1.0) for i in range(60)]
    table = spark.createDataFrame(rows, "event_id int, t string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "value")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), table.schema)
    events.append_log(events.once_each(stream, ["event_id"], late="2 hours"), str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(r.event_id for r in done.collect()) == list(range(20))
    assert events.remaining(spark.range(25).select(F.col("id").cast("int").alias("event_id")), done, ["event_id"]).count() == 5
    counts = events.windowed_counts(table.withColumn("k", F.lit("a")), ["k"], "30 minutes").collect()
    assert sorted(r.n for r in counts) == [30, 30]


def test_components_of_a_table_against_a_plain_search(spark):
    from quarry.operators.graph import components

    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b]
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        if node not in want:
            todo = [node]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = node
                    todo += near[x]
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_record_functions(spark):
    from quarry.functions import records

    rows = spark.createDataFrame([("AC-DE", "ABxC-", "A.12-B.7;A.13-B.9", "?", ".", "2.1"), ("A", "-", None, None, "1.5", "9")], "q string, h string, c string, r1 string, r2 string, r3 string")
    got = rows.select(
        records.insertions_lowered(F.col("q"), F.col("h")).alias("a3m"), records.contacts(F.col("c")).alias("c"), records.first_number(F.col("r1"), F.col("r2"), F.col("r3")).alias("n"),
        records.released_before(F.lit("2020-01-01"), F.lit("2020-01-01")).alias("strict"), records.released_before(F.lit("2020-01-01"), F.lit("2020-01-01"), False).alias("loose"),
    ).collect()
    assert [r.a3m for r in got] == ["ABxC-", "-"] and [r.n for r in got] == [2.1, 1.5] and (got[0].strict, got[0].loose) == (False, True)
    assert [tuple(x) for x in got[0].c] == [("A", 12, "B", 7), ("A", 13, "B", 9)] and got[1].c == []


def test_components_within_groups(spark):
    """Against a plain version, over groups that share nodes and are cut into small pieces."""
    import random

    from quarry.operators.graph import components_within, whole_groups

    draw = random.Random(5)
    edges = [(f"g{g}", draw.randrange(-5, 40), draw.randrange(-5, 40)) for g in range(30) for _ in range(g)]
    near: dict = {}
    for g, a, b in edges:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)
    want = {}
    for g, a in near:
        seen, todo = {a}, [a]
        while todo:
            more = near[g, todo.pop()] - seen
            seen |= more
            todo += more
        want[g, a] = min(seen)
    found = components_within(spark.createDataFrame(edges, "g string, a long, b long"), "g")
    assert {(r.g, r.node): r.component for r in found.collect()} == want and found.count() == len(want)
    import pyarrow as pa

    values = [k for k in (0, 1, 2, 3) for _ in range(7)]
    batches = [pa.RecordBatch.from_pydict({"g": values[i : i + 3]}) for i in range(0, len(values), 3)]
    pieces = [t.column(0).to_pylist() for _, t in whole_groups(iter(batches), 5)]
    assert sum(pieces, []) == values and not any(set(x) & set(y) for x, y in zip(pieces, pieces[1:], strict=False))


def test_jaccard_pairs_of_frequent_items(spark):
    """Every pair once, from strips and tiles of several sizes, and no pair is a row before it is alike (F4)."""
    import random

    import pyarrow as pa

    draw = random.Random(3)
    sets = {i: sorted({int(draw.paretovariate(0.6)) % 500 for _ in range(draw.randrange(40))}) for i in range(150)}
    rows = spark.createDataFrame([(i, s) for i, s in sets.items()] + [(None, [1])], "id long, items array<long>")
    want = {(a, b): len({*sets[a]} & {*sets[b]}) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    want = {(a, b): (k, k / (len({*sets[a]} | {*sets[b]}))) for (a, b), k in want.items() if k / len({*sets[a]} | {*sets[b]}) >= 0.22}
    for strip in (1_000_000, 300):
        got = similarity.jaccard_pairs(rows, 0.22, "id", strip=strip).collect()
        assert {(r.a, r.b): (r.shared, r.similarity) for r in got} == want and len(got) == len(want)
    lists = pa.array([s for s in sets.values()], pa.list_(pa.int64()))
    for lo_a, lo_b, shared in similarity.shared_counts(lists, lists, 64):
        assert all(shared[x, y] == len({*sets[lo_a + x]} & {*sets[lo_b + y]}) for x in range(shared.shape[0]) for y in range(shared.shape[1]))
    assert similarity.jaccard_pairs(rows.limit(0), 0.22, "id").count() == 0


def test_texts_with_enough_shingles(spark):
    """As counted over the whole text; null texts have none."""
    texts = ["a b c d e f g h i j k l", "a b c d e f g h i j k", "x " * 400, "x " * 400 + "a b c d e f g h i j k l", "w" * 519 + "1 2 3 4", None, " ".join(f"word{i}" for i in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.h for r in rows.select(similarity.has_shingles(F.col("text"), 4, 9).alias("h")).collect()] == [True, False, False, True, False, False, True]


def test_fingerprints_by_strips_against_all_pairs(spark, monkeypatch):
    """Many strips and tiles, classes of several ids, empty and null fingerprints; counts are those of the pairs."""
    from quarry.operators import fingerprints

    monkeypatch.setattr(fingerprints, "STRIP", 16)
    monkeypatch.setattr(fingerprints, "TILE", (4, 8))
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(24), rng.randint(0, 14))) for _ in range(60)]
    sets += sets[:20]
    features = spark.createDataFrame([(i, [str(b) for b in s] + [None] * (i % 2)) for i, s in enumerate(sets)] + [(999, None)], "id int, features array<string>")
    rows = fingerprints.folded(features, 128)
    numbers = features.where("id < 999").select("id", fingerprints.packed(fingerprints.bit_numbers(F.filter("features", lambda f: f.isNotNull()), 128), 128).alias("fingerprint"))
    want_rows = {r.id: r.fingerprint for r in numbers.collect()}
    assert {r.id: r.fingerprint for r in rows.collect()} == want_rows | {999: None}
    bits = {i: {(w, b) for w, x in enumerate(f) for b in range(64) if x >> b & 1} for i, f in want_rows.items()}
    for threshold, strict in ((0.5, True), (0.5, False), (0.85, False)):
        want = {}
        for i in range(0, len(sets), 3):
            for j in bits:
                either = len(bits[i] | bits[j])
                s = len(bits[i] & bits[j]) / either if either else -1
                if s > threshold or s == threshold and not strict:
                    want[i, j] = s
        queries = rows.where("id % 3 = 0 AND id < 999")
        assert {(r["query"], r.target): r.similarity for r in fingerprints.similar(queries, rows, threshold, strict).collect()} == want
        got = {r["query"]: r.n for r in fingerprints.count_similar(queries, rows, threshold, strict).collect()}
        assert got == {i: sum(a == i for a, _ in want) for i, _ in want}


def test_profile_counts_characters_together(spark, monkeypatch):
    monkeypatch.setattr(sequence, "PROFILE_CHARACTERS", 7)
    rows = spark.createDataFrame([("a", "xyé"), ("a", "x\U0001f600"), ("a", None), ("b", ""), ("b", "xxxxxxxxxx"), ("a", "y")], "g string, s string")
    found = sequence.profile(rows, ["g"], F.col("s"))
    assert "Generate" not in found._jdf.queryExecution().toString()  # no row for each character
    got = {(r.g, r.column, r.residue): r.share for r in found.collect()}
    want = {("a", 0, "x"): 0.5, ("a", 0, "y"): 0.25, ("a", 1, "y"): 0.25, ("a", 1, "\U0001f600"): 0.25, ("a", 2, "é"): 0.25} | {("b", i, "x"): 0.5 for i in range(10)}
    assert got == want


def test_identity_of_odd_texts(spark, tmp_path):
    """Null and empty texts, a language without residues, and one of empty texts only; ranks without a window over a language."""
    from quarry.plans import sequences

    rows = [(1, "en", "ab c"), (2, "en", None), (3, "en", "ab"), (4, "en", "ab cde"), (5, "xx", " "), (6, "xx", "a"), (7, "no", ""), (8, "no", ""), (9, "nn", None), (10, None, "a")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.identity, r.coverage, r.rank) for r in sequences.identity_coverage_sort(spark, str(tmp_path)).collect()}
    assert got == {1: (1.0, 1.0, 1), 4: (1.0, 1.0, 2), 3: (0.666667, 0.666667, 3), 2: (0.0, 0.0, 4), 5: (None, None, 1), 6: (None, None, 2)}


def test_homology_makes_no_row_for_each_order_of_a_part(spark, tmp_path):
    """Two parts in 300 old orders each, of which one is common: pairs follow the orders' lines, not 300 for each pair."""
    from quarry.plans import spatial as plan

    lines = [(o, 1) for o in range(300)] + [(o, 2) for o in range(299, 599)] + [(1000, 1), (1000, 2), (1000, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.range(1001).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") < 1000, F.lit("2000-01-01")).otherwise(F.lit("2000-07-01")).cast("timestamp").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = plan.interface_disjoint_homology(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1000, 3, 2)]
    plan_text = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(l_partkey#\d+L = l_partkey#\d+L\)", plan_text)  # no pair meets all orders of a part


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks of the queries over lines grow in number with the table, and types are cut before rows of a type meet."""
    from quarry.operators import durable
    from quarry.plans import cleanup, lookups, sampling

    monkeypatch.setattr(durable, "TASK_ROWS", 100)
    folder = "/root/testdata/sf0.001"
    tasks = -(-spark.read.parquet(f"{folder}/lineitem.parquet").count() // 100)
    for query in (lookups.structure_disorder, cleanup.modified_tokens, sampling.quota_sample_by_type):
        plan_text = query(spark, folder)._jdf.queryExecution().toString()
        assert re.search(rf"hashpartitioning\(l_orderkey#\d+L?, {tasks}\)", plan_text)
    assert "WindowGroupLimit" in sampling.quota_sample_by_type(spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_jaccard_pairs_shuffle_nothing(spark):
    """Strips were dealt to each of their cells, so the shuffle grew with the square of the items."""
    rows = spark.range(400).select("id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i + F.col("id") % 7).alias("items"))
    found = similarity.jaccard_pairs(rows.repartition(3), 0.9, "id", strip=200)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == sum((k * (k - 1)) // 2 for k in (len(range(r, 400, 7)) for r in range(7)))
