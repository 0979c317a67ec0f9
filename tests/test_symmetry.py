"""Symmetric molecules, pairing across chains and permutation of instances, against plain versions on small cases."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import pairing, permutation, symmetry
from quarry.operators.geometry import superpositions

ATOM = "structure string, chain string, atom long, atom_name string, res_name string, entity int"
BOND = "structure string, atom_1 long, atom_2 long"


def build(spark, structures):
    """Structures as lists of (chain, entity, atoms) and bonds as ((chain, place), (chain, place))."""
    atoms, bonds = [], []
    for name, (chains, links) in structures.items():
        first, at = {}, 0
        for chain, entity, n in chains:
            first[chain] = at
            atoms += [(name, chain, at + i, f"C{i}", "LIG", entity) for i in range(n)]
            at += n
        bonds += [(name, first[a] + i, first[b] + j) for (a, i), (b, j) in links]
    return spark.createDataFrame(atoms, ATOM), spark.createDataFrame(bonds, BOND)


def ring(names, entity=1):
    return [(c, entity, 2) for c in names], [((a, 0), (b, 1)) for a, b in zip(names, names[1:] + names[:1], strict=True)]


@pytest.fixture(scope="module")
def found(spark):
    two = lambda a, b: (a[0] + b[0], a[1] + b[1])
    star = [("M", 5, 1), ("a", 2, 3), ("b", 2, 3), ("c", 2, 3)], [(("M", 0), (x, 1)) for x in "abc"]
    cases = {
        # the same entities and size, bonded at other atoms: two kinds; bonded alike in another order of chains: one
        "bonds": two(([("A", 1, 3), ("B", 2, 2)], [(("A", 0), ("B", 0))]), ([("C", 1, 3), ("D", 2, 2)], [(("C", 2), ("D", 0))])),
        "order": two(([("A", 1, 3), ("B", 2, 2)], [(("A", 0), ("B", 1))]), ([("D", 2, 2), ("C", 1, 3)], [(("D", 1), ("C", 0))])),
        # refinement can't tell a ring of six chains from two of three: these aren't one molecule, but rings relabelled are
        "rings": two(ring(list("ABCDEF")), ring(list("LHKGJI"))),
        "small rings": two(ring(list("ABC")), ring(list("DEF"))),
        "star": two(star, ([("z", 2, 3), ("y", 2, 3), ("N", 5, 1), ("x", 2, 3)], [(("N", 0), (x, 1)) for x in "xyz"])),
        "waters": ([(f"W{i}", 9, 1) for i in range(12)], []),
    }
    atoms, bonds = build(spark, cases)
    frame = symmetry.symmetric_molecules(atoms, bonds).cache()
    out = defaultdict(dict)
    for r in frame.collect():
        out[r.structure][r.chain] = r
    return atoms, bonds, frame, out


def test_kinds_of_molecules(found):
    out = found[3]
    kinds = lambda name: {c: (r.mol_entity_id, r.mol_sym_id) for c, r in out[name].items()}
    assert kinds("bonds") == {"A": (1, 1), "B": (1, 1), "C": (2, 1), "D": (2, 1)}
    assert kinds("order") == {"A": (1, 1), "B": (1, 1), "C": (1, 2), "D": (1, 2)}
    assert set(kinds("rings").values()) == {(1, 1), (1, 2)} and set(kinds("small rings").values()) == {(1, 1), (1, 2)}
    assert set(kinds("star").values()) == {(1, 1), (1, 2)}
    assert sorted(kinds("waters").values()) == [(1, i) for i in range(1, 13)]


def test_slots_are_an_isomorphism(found):
    atoms, bonds, frame, out = found
    assert [out["order"][c].slot for c in "ABCD"] == [0, 1, 0, 1]
    links = symmetry.cross_chain_bonds(atoms, bonds, symmetry.chain_labels(atoms)).collect()
    for name in ("rings", "small rings", "star"):
        graphs = defaultdict(set)
        for r in links:
            if r.structure == name:
                a, b = out[name][r.chain_1], out[name][r.chain_2]
                graphs[a.mol_sym_id].add(frozenset([(a.slot, r.link_1), (b.slot, r.link_2)]))
        assert graphs[1] == graphs[2]


def test_reordered_atoms_and_numbers(spark, found):
    atoms, _, frame, _ = found
    rows = symmetry.reordered(atoms, frame)
    got = {(r.chain, r.atom): r.new_atom for r in rows.where("structure = 'order'").collect()}
    assert [got["D", 5], got["D", 6], got["C", 7], got["C", 8], got["C", 9]] == [8, 9, 5, 6, 7] and got["A", 0] == 0
    numbered = symmetry.instance_numbers(rows, "chain", "new_atom", "n", 1)
    assert {(r.chain, r.n) for r in numbered.where("structure = 'order'").collect()} == {("A", 1), ("B", 2), ("C", 1), ("D", 2)}
    crop, whole = symmetry.cropped_and_whole(rows.withColumn("keep", F.col("chain").isin("A")), "keep")
    assert {r.chain for r in whole.where("structure = 'bonds'").collect()} == {"A", "B"} and crop.where("structure = 'order'").count() == 3


def test_canonical_forms_of_relabelled_graphs():
    rng = np.random.default_rng(2)
    forms = defaultdict(set)
    for n in range(1, 6):
        for bits in itertools.islice(itertools.product((0, 1), repeat=n * (n - 1) // 2), 64):
            edges = [e for e, b in zip(itertools.combinations(range(n), 2), bits, strict=True) if b]
            labels = ["a" if i % 2 else "b" for i in range(n)]
            form, place = symmetry.canonical(labels, edges)
            to = rng.permutation(n).tolist()
            again, _ = symmetry.canonical([labels[to.index(i)] for i in range(n)], [(to[a], to[b]) for a, b in edges])
            assert form == again and sorted(place) == list(range(n))
            # equal forms only for isomorphic graphs, by trying all orders
            least = min(tuple(sorted(tuple(sorted((p[a], p[b]))) for a, b in edges)) for p in itertools.permutations(range(n)) if all(labels[i] == labels[p[i]] for i in range(n)))
            forms[n, form].add(least)
    assert all(len(v) == 1 for v in forms.values())


def test_covalent_chains_and_empty_tables(spark, found):
    atoms, bonds, _, _ = found
    chains = symmetry.chain_labels(atoms)
    links = symmetry.cross_chain_bonds(atoms, bonds, chains)
    start = spark.createDataFrame([("star", "a"), ("waters", "W3")], "structure string, chain string")
    assert {(r.structure, r.chain) for r in symmetry.covalent_chains(chains, links, start).collect()} == {("star", c) for c in "Mabc"} | {("waters", "W3")}
    assert symmetry.symmetric_molecules(atoms.limit(0), bonds.limit(0)).count() == 0
    alone = symmetry.symmetric_molecules(atoms, bonds.limit(0))
    assert alone.where("structure = 'rings'").select("mol_entity_id").distinct().count() == 1


# ---------------------------------------------------------------- pairing

def greedy(rows, max_rows, min_chains, shared, most):
    """Level by level, on counts: what the chain with the fewest rows of a species has is taken from all."""
    by, chains = defaultdict(lambda: defaultdict(list)), sorted({c for c, _, _ in rows})
    for chain, species, row in sorted(rows, key=lambda r: r[2]):
        by[species][chain].append(row)
    left = {s: {c: list(x) for c, x in d.items()} for s, d in by.items() if (len(d) > 1 or not shared) and max(map(len, d.values())) <= most}
    out = []
    for level in range(len(chains), min(min_chains, len(chains)) - 1, -1):
        for s in sorted(left):
            held = [c for c in left[s] if left[s][c]]
            if len(held) == level:
                for _ in range(min(len(left[s][c]) for c in held)):
                    out.append({c: left[s][c].pop(0) for c in held})
    return out[:max_rows]


@pytest.mark.parametrize(("max_rows", "min_chains", "shared", "most"), [(100, 2, True, 600), (7, 2, True, 600), (100, 9, True, 5), (100, 1, False, 4), (100, 3, True, 3)])
def test_pairing_level_by_level(spark, max_rows, min_chains, shared, most):
    rng = np.random.default_rng(8)
    rows = [(str(c), f"s{s}", int(i)) for c in "ABCD" for i, s in enumerate(rng.integers(0, 8, 25))]
    frame = spark.createDataFrame([("x", *r, "extra") for r in rows] + [("x", "A", None, 99, ""), ("lone", "A", "s1", 0, "")], "group string, chain string, species string, row long, level_ string")
    got = defaultdict(dict)
    for r in pairing.pair_rows(frame, "group", "chain", "species", ["row"], max_rows, min_chains, shared, most).collect():
        assert r.group == "x"
        got[r.paired_row][r.chain] = r.row
    assert [got[i] for i in range(len(got))] == greedy(rows, max_rows, min_chains, shared, most)


def test_gaps_and_what_is_paired(spark):
    frame = spark.createDataFrame([(1, "A", "s", 1), (1, "B", "s", 4), (1, "A", "t", 2), (1, "C", "t", 5)], "g int, c string, s string, r long")
    paired = pairing.pair_rows(frame, "g", "c", "s", ["r"])
    assert sorted((r.paired_row, r.c, r.r or 0) for r in pairing.with_gaps(paired, "g", "c", "r").collect()) == [(0, "A", 1), (0, "B", 4), (0, "C", 0), (1, "A", 2), (1, "B", 0), (1, "C", 5)]
    chains = spark.createDataFrame([(1, "p"), (1, "p"), (2, "p"), (2, "q"), (3, "p")], "g int, rep string")
    assert [r.g for r in pairing.heteromers(chains, "g", "rep", F.lit(True)).collect()] == [2]
    held = pairing.with_rows_to_pair(frame.withColumn("source", F.lit("u")), "g", "c", ("u",))
    assert {r.c for r in held.collect()} == {"A"} and pairing.with_rows_to_pair(frame.withColumn("source", F.lit("u")), "g", "c", ("v",)).count() == 0
    assert pairing.pair_rows(frame.limit(0), "g", "c", "s", ["r"]).count() == 0
    with pytest.raises(ValueError):
        pairing.pair_rows(frame, "g", "c", "s", ["r"], min_chains=0)


# ---------------------------------------------------------------- permutation

POINT = "structure int, entity long, sym long, token long, x double, y double, z double, resolved boolean, ligand boolean"


def turn_of(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


@pytest.mark.parametrize("crop", [False, True])
def test_permuted_and_moved_instances_come_back(spark, crop):
    rng = np.random.default_rng(3)
    truth, pred, want = [], [], {}
    for structure in range(12):
        shape = {1: 1, 2: 3, 3: 4}
        turn, shift = turn_of(rng), rng.normal(size=3) * 20
        for entity, mates in shape.items():
            base, deal = rng.normal(size=(9, 3)) * 4, rng.permutation(mates)
            for sym in range(mates):
                xyz = base @ turn_of(rng) + rng.normal(size=3) * 30
                truth += [(structure, entity, sym, t, *map(float, p), bool(rng.random() < 0.9), entity == 3) for t, p in enumerate(xyz)]
                tokens = range(2, 8) if crop and entity == 2 else range(9)
                pred += [(structure, entity, int(deal[sym]), t, *map(float, turn @ xyz[t] + shift), True, False) for t in tokens]
                want[structure, entity, int(deal[sym])] = sym
    a, b = spark.createDataFrame(truth, POINT), spark.createDataFrame(pred, POINT).drop("resolved", "ligand")
    found = permutation.molecule_permutation(a, b).cache()
    assert {(r.structure, r.entity, r.sym): r.true_sym for r in found.collect()} == want
    assert {r.anchor_entity for r in found.collect()} == {1}
    pairs = permutation.permuted_rows(b, a, found).join(found.select("structure", "entity", "sym", "rotation", "shift"), ["structure", "entity", "sym"])
    for r in pairs.select("true_x", "true_y", "true_z", *permutation.moved(pairs, ("x", "y", "z"))).collect():
        assert np.allclose([r.x, r.y, r.z], [r.true_x, r.true_y, r.true_z], atol=1e-6)


def points(rows):
    return permutation.Points([dict(zip(("entity", "sym", "token", "x", "y", "z", "resolved", "ligand"), r, strict=True)) for r in rows])


def test_anchors():
    mate = lambda e, s, n, ligand=False, off=0: [(e, s, t, 0.0, 0.0, float(t), t >= off, ligand) for t in range(n)]
    assert permutation.anchor(points(mate(1, 1, 9) + mate(1, 2, 9) + mate(2, 1, 5)), {1, 2}) == (2, 1)  # the fewest mates
    assert permutation.anchor(points(mate(1, 1, 5) + mate(1, 2, 9, off=2) + mate(2, 1, 3)), {1, 2}) == (1, 2)  # three points are too few
    assert permutation.anchor(points(mate(1, 1, 5) + mate(2, 1, 7)), {1, 2}) == (2, 1)  # a tie goes to more points
    assert permutation.anchor(points(mate(1, 1, 2) + mate(2, 1, 7, ligand=True)), {1, 2}) == (2, 1)  # a ligand for want of a polymer
    assert permutation.anchor(points(mate(1, 1, 2) + mate(2, 1, 3, ligand=True)), {1, 2}) == (1, 1)
    assert permutation.anchor(points(mate(1, 1, 5, off=9)), {1}) is None


def test_unresolved_instances_come_last_and_no_anchor(spark):
    base = np.arange(15.0).reshape(5, 3) ** 1.3
    one = [(1, s, t, *(base[t] + 40 * s), s != 0, False) for s in range(3) for t in range(5)]
    pred = points([(1, s, t, *(base[t] + 40 * (s + 1)), True, False) for s in range(2) for t in range(5)])
    found, at, turn, shift = permutation.assign(points(one), pred)
    assert [(f[1], f[2]) for f in found] == [(0, 1), (1, 2)]
    found, at, _, _ = permutation.assign(points([(*r[:6], False, False) for r in one]), pred)
    assert at is None and [(f[1], f[2]) for f in found] == [(0, 0), (1, 1)]
    none = spark.createDataFrame([], POINT)
    assert permutation.molecule_permutation(none, none).count() == 0


def test_superpositions_of_a_batch():
    rng = np.random.default_rng(1)
    mobile, turns, shifts = rng.normal(size=(20, 7, 3)), np.array([turn_of(rng) for _ in range(20)]), rng.normal(size=(20, 3))
    target = np.einsum("nij,nkj->nki", turns, mobile) + shifts[:, None]
    mask = rng.random((20, 7)) < 0.8
    mask[:, :4] = True
    target[~mask] = np.nan
    got = superpositions(mobile, target, mask)
    assert np.allclose(got[0], turns) and np.allclose(got[1], shifts)


def test_best_orders(spark):
    pred = spark.createDataFrame([(1, c, a, float(a), 0.0, 0.0) for c in range(3) for a in range(3)], "structure int, component int, atom int, x double, y double, z double")
    truth = [(1, 0, a, float(2 - a), 0.0, 0.0, True) for a in range(3)] + [(1, 1, a, float(a), 0.0, 0.0, a != 1) for a in range(3)] + [(1, 2, a, 5.0, 0.0, 0.0, False) for a in range(3)]
    truth = spark.createDataFrame(truth, "structure int, component int, atom int, x double, y double, z double, resolved boolean")
    orders = spark.createDataFrame([(1, c, k, o) for c in range(3) for k, o in enumerate(([0, 1, 2], [2, 1, 0]))], "structure int, component int, order_no int, order array<int>")
    assert {r.component: (r.order_no, r.order) for r in permutation.best_orders(pred, truth, orders).collect()} == {0: (1, [2, 1, 0]), 1: (0, [0, 1, 2]), 2: (0, [0, 1, 2])}


def test_jobs_do_not_grow_with_the_length_of_molecules(spark):
    """No rounds of refinement, each of which stored all nodes (F1)."""
    def jobs(n):
        names = [f"c{i}" for i in range(n)]
        atoms, bonds = build(spark, {"path": ([(c, 1, 1) for c in names], [((a, 0), (b, 0)) for a, b in zip(names, names[1:], strict=False)])})
        spark.sparkContext.setJobGroup(f"path {n}", "")
        rows = symmetry.symmetric_molecules(atoms, bonds).collect()
        assert {(r.molecule, r.mol_entity_id, r.mol_sym_id) for r in rows} == {(0, 1, 1)} and sorted(r.slot for r in rows) == list(range(n))
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"path {n}"))
        spark.sparkContext.setJobGroup("others", "")
        return done

    assert jobs(40) <= jobs(3) + 3
