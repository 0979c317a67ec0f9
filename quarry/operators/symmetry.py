"""Molecules that are symmetric to each other: chains, joined by bonds, compared as graphs.

Atoms are rows of ``structure``, ``chain``, ``atom`` (the place in the structure, from 0, gapless in each chain), ``atom_name``,
``res_name`` and ``entity``; bonds are rows of ``structure``, ``atom_1`` and ``atom_2``. A molecule is the chains joined by
bonds; its graph has a node for each chain, labelled by a digest of its atoms, and one for each atom with a bond to
another chain, labelled by its place in its chain.

A structure's bonds are one group of a task, where chains are joined to molecules. Molecules of several chains are written
down as they stand, chains and bonds in order; each different way to stand is put into a canonical form once, so that equal
forms are equal graphs, and no two molecules are ever compared. A chain alone is its label. What is left of a molecule is
one row, numbered with those of its structure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.durable import stored
from quarry.operators.graph import components_within


def chain_labels(atoms: DataFrame) -> DataFrame:
    """(structure, chain, first, atoms, entity, label): two chains have one label if their atoms' names, residues and entities
    are the same in order. Digests of single atoms are combined, so a chain's atoms are never one value."""
    first = F.min("atom").over(W.partitionBy("structure", "chain"))
    what = [(F.col("atom") - F.col("__first")).cast("bigint"), F.col("atom_name"), F.col("res_name"), F.col("entity").cast("string")]
    lanes = [F.hex(F.bit_xor(F.xxhash64(F.lit(i), *what))) for i in range(2)]
    rows = atoms.withColumn("__first", first).groupBy("structure", "chain")
    label = F.concat_ws("|", *lanes, F.count("*").cast("string"))
    return rows.agg(F.min("atom").alias("first"), F.count("*").alias("atoms"), F.min("entity").alias("entity"), label.alias("label"))


def cross_chain_bonds(atoms: DataFrame, bonds: DataFrame, chains: DataFrame) -> DataFrame:
    """(structure, chain_1, link_1, chain_2, link_2, first_1, first_2): bonds between chains, atoms by their place in their chain.
    Chains have no gaps, so an atom is of the chain that begins last before it, within that chain's length; bonds and
    chains are shuffled once, by structure."""
    kind = {c: atoms.schema[c].dataType for c in ("chain", "atom")}
    none = lambda name: F.lit(None).cast(kind[name])
    own = chains.select("structure", F.struct("first", "atoms", "chain").alias("c"), none("atom").alias("atom_1"), none("atom").alias("atom_2"))
    ends = bonds.where("atom_1 IS NOT NULL AND atom_2 IS NOT NULL").select("structure", F.lit(None).cast(own.schema["c"].dataType).alias("c"), "atom_1", "atom_2")
    rows = own.union(ends).repartition("structure")
    for i in (1, 2):
        w = W.partitionBy("structure").orderBy(F.coalesce(f"atom_{i}", "c.first"), F.col(f"atom_{i}").isNotNull())
        rows = rows.withColumn(f"c{i}", F.last("c", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    within = " AND ".join(f"atom_{i} < c{i}.first + c{i}.atoms" for i in (1, 2))
    place = lambda i: (F.col(f"atom_{i}") - F.col(f"c{i}.first")).cast("bigint").alias(f"link_{i}")
    both = rows.where(f"atom_1 IS NOT NULL AND {within} AND c1.first <> c2.first")
    return both.select("structure", F.col("c1.chain").alias("chain_1"), place(1), F.col("c2.chain").alias("chain_2"), place(2), F.col("c1.first").alias("first_1"), F.col("c2.first").alias("first_2")).distinct()


def molecules(chains: DataFrame, links: DataFrame) -> DataFrame:
    """Chains with ``molecule``, the first atom of the molecule that they belong to."""
    found = components_within(links, "structure", "first_1", "first_2").select("structure", F.col("node").alias("first"), F.col("component").alias("molecule"))
    return chains.join(found, ["structure", "first"], "left").withColumn("molecule", F.coalesce("molecule", "first")).select(*chains.columns, "molecule")


def canonical(labels: list[str], edges: list[tuple[int, int]]) -> tuple[str, list[int]]:
    """The canonical form of one labelled graph, and each node's place in it. Nodes left alike by refinement are told apart one
    at a time; in a forest those alike are equivalent, so the first is as good as any, and otherwise all are tried."""
    n = len(labels)
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    roots, forest = list(range(n)), True

    def root(x: int) -> int:
        while roots[x] != x:
            x = roots[x] = roots[roots[x]]
        return x

    for a, b in edges:
        forest &= root(a) != root(b)
        roots[root(a)] = root(b)

    def stable(colour: list[int]) -> list[int]:
        while True:
            seen = [(colour[i], tuple(sorted(colour[j] for j in near[i]))) for i in range(n)]
            rank = {s: k for k, s in enumerate(sorted(set(seen)))}
            if len(rank) == len(set(colour)):
                return [rank[s] for s in seen]
            colour = [rank[s] for s in seen]

    def search(colour: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
        colour = stable(colour)
        cells: dict[int, list[int]] = {}
        for i, c in enumerate(colour):
            cells.setdefault(c, []).append(i)
        alike = next((cells[c] for c in sorted(cells) if len(cells[c]) > 1), None)
        if alike is None:
            return sorted(tuple(sorted((colour[a], colour[b]))) for a, b in edges), colour
        tried = []
        for i in alike[:1] if forest else alike:
            told = [2 * c for c in colour]
            told[i] -= 1
            tried.append(search(told))
        return min(tried, key=lambda t: t[0])

    rank = {s: k for k, s in enumerate(sorted(set(labels)))}
    form, place = search([rank[s] for s in labels])
    ordered = [labels[i] for i in sorted(range(n), key=place.__getitem__)]
    return f"{ordered}{form}", place


def _graph(labels: list[str], bonds: list[dict]) -> tuple[list[str], list[tuple[int, int]]]:
    """Nodes and edges of a molecule: its chains, then the atoms with a bond to another chain, each chain's in order."""
    joints = sorted({(b[x], b[y]) for b in bonds for x, y in (("o1", "l1"), ("o2", "l2"))})
    number = {j: len(labels) + i for i, j in enumerate(joints)}
    edges = {(j[0], n) for j, n in number.items()} | {tuple(sorted((number[b["o1"], b["l1"]], number[b["o2"], b["l2"]]))) for b in bonds}
    return labels + [f"atom {j[1]}" for j in joints], sorted(edges)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, places = [], []
        for labels, bonds in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            form, place = canonical(*_graph(labels, bonds))
            forms.append(hashlib.md5(form.encode()).digest())
            places.append(place[: len(labels)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["stand", "certificate", "places"])


def symmetric_molecules(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure, chain, molecule, mol_entity_id, mol_sym_id, slot): molecules whose graphs are the same are one molecular entity,
    numbered from 1 in each structure by the first molecule of the same entities and size, then by their own first; instances
    are numbered from 1. ``slot``: the place of the chain among those of its molecule when these are put into the order of the
    entity's first molecule; kept as it is where it fits already."""
    chains = stored(chain_labels(atoms), "chains")
    links = stored(cross_chain_bonds(atoms, bonds, chains), "links")
    home = stored(components_within(links, "structure", "first_1", "first_2").select("structure", F.col("node").alias("first"), F.col("component").alias("molecule")), "molecules")
    own = ["structure", "molecule"]
    alone = chains.join(home, ["structure", "first"], "left_anti").select(
        "structure", F.col("first").alias("molecule"), F.array("chain").alias("chains"), F.unhex(F.md5("label")).alias("stand"), F.unhex(F.md5("label")).alias("certificate"),
        F.lit(None).cast("array<int>").alias("places"), F.coalesce(F.col("entity").cast("string"), F.lit("")).alias("entities"), F.col("atoms").alias("size"),
    )
    # a molecule as it stands: labels of its chains in order, and bonds by the places of chains and atoms
    parts = chains.join(home, ["structure", "first"]).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("first", "chain", "label", "entity", "atoms"))).alias("c"))
    joined = links.join(home.withColumnRenamed("first", "first_1"), ["structure", "first_1"]).groupBy(*own).agg(F.collect_list(F.struct("first_1", "link_1", "first_2", "link_2")).alias("b"))
    at = lambda first: (F.array_position("f", first) - 1).cast("int")
    one, two = (lambda b, i=i: F.struct(at(b[f"first_{i}"]).alias("o"), b[f"link_{i}"].alias("l")) for i in (1, 2))
    pair = lambda b: F.struct(F.least(one(b), two(b)).alias("a"), F.greatest(one(b), two(b)).alias("b"))
    flat = lambda p: F.struct(p["a"]["o"].alias("o1"), p["a"]["l"].alias("l1"), p["b"]["o"].alias("o2"), p["b"]["l"].alias("l2"))
    whole = parts.join(joined, own).withColumn("f", F.col("c")["first"]).withColumn("labels", F.col("c")["label"])
    whole = whole.withColumn("bound", F.array_sort(F.array_distinct(F.transform("b", lambda b: flat(pair(b))))))
    entities = F.array_join(F.array_sort(F.array_distinct(F.transform("c", lambda c: c["entity"].cast("string")))), ",")
    size = F.aggregate("c", F.lit(0).cast("bigint"), lambda n, c: n + c["atoms"])
    stand = F.unhex(F.md5(F.to_json(F.struct("labels", "bound"))))
    whole = stored(whole.select(*own, F.col("c")["chain"].alias("chains"), stand.alias("stand"), "labels", "bound", entities.alias("entities"), size.alias("size")), "whole")
    ways = whole.groupBy("stand").agg(F.first("labels").alias("labels"), F.first("bound").alias("bound"))
    settled = ways.mapInArrow(_settle, "stand binary, certificate binary, places array<int>")
    several = whole.drop("labels", "bound").join(settled, "stand").select(alone.columns)
    rows = alone.union(several).repartition("structure")
    kind = W.partitionBy("structure", "entities", "size", "certificate")
    rows = rows.withColumns({"first_one": F.min("molecule").over(kind), "model": F.min_by(F.struct("stand", "places"), "molecule").over(kind)})
    rows = rows.withColumn("first_group", F.min("first_one").over(W.partitionBy("structure", "entities", "size")))
    rows = rows.withColumn("mol_entity_id", F.dense_rank().over(W.partitionBy("structure").orderBy("first_group", "first_one")).cast("bigint"))
    rows = rows.withColumn("mol_sym_id", F.row_number().over(W.partitionBy("structure", "mol_entity_id").orderBy("molecule")).cast("bigint"))
    each = rows.withColumn("fits", F.col("stand") == F.col("model.stand")).select("*", F.posexplode("chains").alias("own", "chain"))
    slot = F.when(F.col("fits"), F.col("own")).otherwise(F.array_position("model.places", F.get("places", F.col("own"))) - 1).cast("bigint")
    return each.select("structure", "chain", "molecule", "mol_entity_id", "mol_sym_id", slot.alias("slot"))


def reordered(atoms: DataFrame, symmetric: DataFrame) -> DataFrame:
    """Atoms with the columns of ``symmetric`` and ``new_atom``: the places of a molecule's atoms stay its own, and its chains
    take them in order of slot."""
    rows = atoms.join(symmetric, ["structure", "chain"])
    own = W.partitionBy("structure", "molecule")
    rows = rows.withColumn("__to", F.row_number().over(own.orderBy("slot", "atom")))
    places = rows.select("structure", "molecule", F.row_number().over(own.orderBy("atom")).alias("__to"), F.col("atom").alias("new_atom"))
    return rows.join(places, ["structure", "molecule", "__to"]).drop("__to")


def instance_numbers(rows: DataFrame, value: str, order: str, name: str, start: int = 0) -> DataFrame:
    """Rows with ``name``: the runs of ``value`` in each molecule's instance, numbered from ``start`` in order."""
    w = W.partitionBy("structure", "mol_entity_id", "mol_sym_id").orderBy(order)
    new = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(False)).cast("long")
    return rows.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) + start).drop("__new")


def covalent_chains(chains: DataFrame, links: DataFrame, start: DataFrame) -> DataFrame:
    """(structure, chain) of all chains in the molecules of the chains in ``start``."""
    found = molecules(chains, links).select("structure", "chain", "molecule")
    return found.join(found.join(start, ["structure", "chain"]).select("structure", "molecule").distinct(), ["structure", "molecule"]).select("structure", "chain")


def cropped_and_whole(rows: DataFrame, cropped: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the crop, and all rows of those molecular entities that the crop has a part of, for matching the two."""
    crop = rows.where(F.col(cropped))
    return crop, rows.join(crop.select("structure", "mol_entity_id").distinct(), ["structure", "mol_entity_id"])
