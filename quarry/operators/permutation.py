"""Which of several symmetric molecules a predicted one stands for.

Points of the truth and of a prediction are rows of ``structure``, ``entity``, ``sym`` (instance of the entity), ``token`` (the
place in the instance), ``x``, ``y``, ``z``; the truth also has ``resolved`` and ``ligand``. An anchor instance of the truth is laid
over each instance of its entity in the prediction; under each of these transforms predicted instances take the nearest
true one that is free, and the transform with the least distance over all is kept.

A structure is one row of arrays while it is solved, so a task holds a batch of structures; the decompositions of all
anchors of a structure, and its distances under all transforms, are numpy calls over all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.geometry import superpositions

_POINT = ("entity", "sym", "token", "x", "y", "z", "resolved", "ligand")
_OUT = "entity long, sym long, true_sym long, distance double, anchor_entity long, anchor_sym long, rotation array<double>, shift array<double>"


class Points:
    """The points of one structure, by entity, instance and token."""

    def __init__(self, rows: list[dict]):
        get = lambda name, kind: np.array([r[name] for r in rows], kind)
        keys = [get(k, np.int64) for k in ("entity", "sym", "token")]
        order = np.lexsort(keys[::-1])
        self.entity, self.sym, self.token = (k[order] for k in keys)
        self.xyz = np.column_stack([get(k, float) for k in "xyz"])[order]
        self.resolved = get("resolved", bool)[order] & np.isfinite(self.xyz).all(1)
        self.ligand = get("ligand", bool)[order]

    def of(self, entity: int, sym: int) -> np.ndarray:
        return np.flatnonzero((self.entity == entity) & (self.sym == sym))


def least_ambiguous(truth: Points, among: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """(entity, instance, resolved points): of the entities with the fewest instances that with the most resolved points
    in one instance. Entities of more instances are asked if it has no more than three, and the first is kept if none has
    more."""
    number: dict[int, int] = {}
    for entity, _ in among:
        number[entity] = number.get(entity, 0) + 1
    kept = None
    for n in sorted(set(number.values())):
        best = None
        for entity in sorted(e for e, k in number.items() if k == n):
            syms, counts = np.unique(truth.sym[(truth.entity == entity) & truth.resolved], return_counts=True)
            k = int(counts.argmax())
            if best is None or counts[k] > best[2]:
                best = (entity, int(syms[k]), int(counts[k]))
        kept = kept or best
        if best[2] > 3:
            return best
    return kept


def anchor(truth: Points, entities: set[int]) -> tuple[int, int] | None:
    """The instance to lay over the prediction: of polymers, or of ligands if no polymer has three resolved points and a
    ligand has more than three. None without resolved points of an entity that is predicted."""
    held = sorted({(int(e), int(s)) for e, s in zip(truth.entity[truth.resolved], truth.sym[truth.resolved], strict=True) if int(e) in entities})
    only_ligand = {e for e, _ in held if truth.ligand[truth.entity == e].all()}
    polymer = least_ambiguous(truth, [h for h in held if h[0] not in only_ligand])
    if polymer is None or polymer[2] < 3:
        ligand = least_ambiguous(truth, [h for h in held if h[0] in only_ligand])
        if ligand and (ligand[2] > 3 or polymer is None):
            return ligand[:2]
    return polymer[:2] if polymer else None


def _centroids(xyz: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.where(mask[..., None], xyz, 0.0).sum(-2) / (mask.sum(-1, keepdims=True) + 1e-4)


def _segment(points: Points, entity: int, sym: int, tokens: np.ndarray) -> np.ndarray:
    own = points.of(entity, sym)
    return own[np.isin(points.token[own], tokens)]


def assign(truth: Points, pred: Points) -> tuple[list[tuple[int, int, int, float]], tuple[int, int] | None, np.ndarray, np.ndarray]:
    """(entity, instance, true instance, distance) of each predicted instance, the anchor, and the rotation and shift that
    bring the prediction onto the truth so permuted."""
    instances = sorted({(int(e), int(s)) for e, s in zip(pred.entity, pred.sym, strict=True)})
    at = anchor(truth, {e for e, _ in instances})
    if at is None:
        return [(e, s, s, float("nan")) for e, s in instances], None, np.eye(3), np.zeros(3)
    mates = [s for e, s in instances if e == at[0]]
    pairs = []
    for s in mates:
        own = pred.of(at[0], s)
        part = _segment(truth, *at, pred.token[own])
        pairs.append((part, own[np.isin(pred.token[own], truth.token[part])]))
    longest = max(len(a) for a, _ in pairs)
    mobile, target, mask = np.zeros((len(pairs), longest, 3)), np.zeros((len(pairs), longest, 3)), np.zeros((len(pairs), longest), bool)
    for i, (a, b) in enumerate(pairs):
        mobile[i, : len(a)], target[i, : len(a)], mask[i, : len(a)] = truth.xyz[a], pred.xyz[b], truth.resolved[a]
    turns, shifts = superpositions(mobile, target, mask)
    laid = np.einsum("nij,kj->nki", turns, truth.xyz) + shifts[:, None]
    found: list[dict[tuple[int, int], int]] = [{} for _ in mates]
    distances = []
    for entity in sorted({e for e, _ in instances}):
        true_syms = np.unique(truth.sym[truth.entity == entity])
        parts = {}
        for s in (s for e, s in instances if e == entity):
            own = pred.of(entity, s)
            parts[s] = (own, [_segment(truth, entity, int(t), pred.token[own]) for t in true_syms])
        free = np.ones((len(mates), len(true_syms)), bool)
        # those with the most resolved points in the truth choose first
        for s in sorted(parts, key=lambda s: -sum(int(truth.resolved[p].sum()) for p in parts[s][1])):
            own, segments = parts[s]
            far = np.full((len(mates), len(true_syms)), np.inf)
            for k, segment in enumerate(segments):
                mask = truth.resolved[segment]
                same = own[np.isin(pred.token[own], truth.token[segment])]
                if mask.any():
                    gap = _centroids(laid[:, segment], mask) - _centroids(pred.xyz[same], mask)
                    far[:, k] = (gap**2).sum(-1)
            # instances without resolved points come after all others, and taken ones not at all
            cost = np.where(free, np.where(np.isinf(far), np.finfo(float).max, far), np.inf)
            best = cost.argmin(1)
            free[np.arange(len(mates)), best] = False
            distances.append(far[np.arange(len(mates)), best])
            for j, k in enumerate(best.tolist()):
                found[j][entity, s] = int(true_syms[k])
    squares = np.array(distances).T
    known = np.isfinite(squares)
    squares = np.where(known, squares, squares[known].max() + 1 if known.any() else 0.0)
    best = int(np.sqrt(squares.mean(1)).argmin())
    # the prediction onto the truth, over all points
    chosen = found[best]
    a = [(o, _segment(truth, e, t, pred.token[o])) for (e, s), t in chosen.items() for o in [pred.of(e, s)]]
    own, true = np.concatenate([o[np.isin(pred.token[o], truth.token[t])] for o, t in a]), np.concatenate([t for _, t in a])
    turn, shift = superpositions(pred.xyz[own][None], truth.xyz[true][None], truth.resolved[true][None])
    order = [(e, s) for e in sorted({e for e, _ in instances}) for s in sorted(s for k, s in instances if k == e)]
    by = dict(zip(chosen, np.sqrt(squares[best]).tolist(), strict=True))
    return [(e, s, chosen[e, s], by[e, s]) for e, s in order], at, turn[0], shift[0]


def molecule_permutation(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(structure, entity, sym, true_sym, distance, anchor_entity, anchor_sym, rotation, shift) of each predicted instance: the
    true instance it stands for, the distance of their centres, and, the same for all of a structure, the rotation (row
    by row) and shift that bring the prediction onto the truth so permuted. Without an anchor each stands for itself,
    with no distance. Structures that only one side has are left out; the truth has as many instances of an entity as
    the prediction, or more."""
    kind = truth.schema["structure"].dataType.simpleString()
    no = F.lit(False)
    own = truth.select("structure", F.struct("entity", "sym", "token", "x", "y", "z", F.coalesce("resolved", no).alias("resolved"), F.coalesce("ligand", no).alias("ligand")).alias("p"))
    other = predicted.select("structure", F.struct("entity", "sym", "token", "x", "y", "z", F.lit(True).alias("resolved"), no.alias("ligand")).alias("p"))
    both = own.groupBy("structure").agg(F.collect_list("p").alias("truth")).join(other.groupBy("structure").agg(F.collect_list("p").alias("pred")), "structure")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, t, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found, at, turn, shift = assign(Points(t), Points(p))
                rows += [(key, *f, *(at or (None, None)), turn.ravel().tolist(), shift.tolist()) for f in found]
            names = ["structure", *(c.split()[0] for c in _OUT.split(", "))]
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=names)

    return both.mapInArrow(run, f"structure {kind}, {_OUT}")


def moved(rows: DataFrame, xyz: tuple[str, str, str], rotation: str = "rotation", shift: str = "shift") -> list[Column]:
    """x, y, z of each row under its rotation and shift, as columns."""
    at = [F.col(c).cast("double") for c in xyz]
    return [(sum((F.get(rotation, F.lit(3 * i + j)) * at[j] for j in range(3)), F.get(shift, F.lit(i)))).alias(xyz[i]) for i in range(3)]


def permuted_rows(predicted: DataFrame, truth: DataFrame, permutation: DataFrame) -> DataFrame:
    """Predicted points with the true point that each stands for: ``true_sym``, ``true_x``, ``true_y``, ``true_z``, ``true_resolved``."""
    one = predicted.join(permutation.select("structure", "entity", "sym", "true_sym"), ["structure", "entity", "sym"])
    two = truth.select("structure", "entity", F.col("sym").alias("true_sym"), "token", *(F.col(c).alias(f"true_{c}") for c in ("x", "y", "z", "resolved")))
    return one.join(two, ["structure", "entity", "true_sym", "token"], "left")


def best_orders(predicted: DataFrame, truth: DataFrame, orders: DataFrame) -> DataFrame:
    """(structure, component, order_no, order): of the equivalent orders of a component's atoms, that with the least distance
    to the prediction. Points are (structure, component, atom, x, y, z), those of the truth with ``resolved``; ``orders`` are
    (structure, component, order_no, order), where ``order`` has the true atom (from 0) for each predicted one. Of equal ones, and
    where no atom is resolved, the first."""
    key = ["structure", "component"]
    wide = orders.select(*key, "order_no", "order", F.posexplode("order").alias("atom", "true_atom"))
    p = predicted.select(*key, "atom", *(F.col(c).alias(f"p{c}") for c in "xyz"))
    t = truth.select(*key, F.col("atom").alias("true_atom"), "x", "y", "z", "resolved")
    both = wide.join(p, [*key, "atom"]).join(t, [*key, "true_atom"])
    square = sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    cost = both.groupBy(*key, "order_no").agg(F.avg(F.when(F.col("resolved"), square)).alias("cost"), F.first("order").alias("order"))
    return cost.groupBy(*key).agg(F.min_by(F.struct("order_no", "order"), F.struct(F.coalesce("cost", F.lit(-1.0)), "order_no")).alias("b")).select(*key, "b.*")
