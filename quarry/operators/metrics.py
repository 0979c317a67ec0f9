"""Structure metrics and confidence scores as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, ((p - q) * (p - q) for p, q in zip(a, b, strict=True))))


def share_within(value: Column, cutoffs: tuple[float, ...]) -> Column:
    """Mean over the cutoffs of the share of rows at or below them, as an aggregate."""
    return reduce(lambda a, b: a + b, (F.avg((value <= c).cast("double")) for c in cutoffs)) / len(cutoffs)


def gdt_ts(value: Column) -> Column:
    return share_within(value, (1.0, 2.0, 4.0, 8.0))


def gdt_ha(value: Column) -> Column:
    return share_within(value, (0.5, 1.0, 2.0, 4.0))


def rmsd(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def pairs(points: DataFrame, group: str, key: str, columns: list[str]) -> DataFrame:
    """Ordered pairs of different points of a group, as structs ``a`` and ``b``. Groups are structures of bounded size."""
    side = lambda name: points.select(group, F.struct(key, *columns).alias(name))
    return side("a").join(side("b"), group).where(F.col(f"a.{key}") != F.col(f"b.{key}"))


def lddt(true: Column, predicted: Column, cutoff: float, scale: float = 1.0) -> Column:
    """Of pairs with a true distance below the cutoff, the mean share whose distance is kept within 0.5, 1, 2 and 4."""
    error = F.abs(true - predicted)
    score = reduce(lambda a, b: a + b, ((error < t * scale).cast("double") for t in (0.5, 1.0, 2.0, 4.0))) / 4
    return F.avg(F.when(true < cutoff, score))


def drmsd(true: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((true - predicted) * (true - predicted)))


def steric_clash(value: Column, threshold: float) -> Column:
    """Mean relative overlap of pairs nearer than the threshold."""
    return F.avg(F.greatest(F.lit(0.0), F.lit(threshold) - value) / threshold)


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def expected(probabilities: Column, low: float, high: float, bins: int) -> Column:
    """Expected value over equally wide bins, each taken at its centre."""
    width = (high - low) / bins
    return F.aggregate(F.transform(probabilities, lambda p, i: p * (F.lit(low) + (i + F.lit(0.5)) * width)), F.lit(0.0), lambda s, x: s + x)


def tm_scale(n: Column) -> Column:
    """The length-dependent distance scale of template modelling scores, for at least 19 residues."""
    return F.lit(1.24) * F.pow(F.greatest(n, F.lit(19)) - 15, F.lit(1.0 / 3)) - 1.8


def ranking(iptm: Column, ptm: Column, disorder: Column, clash: Column, weights: tuple[float, float, float, float] = (0.8, 0.2, 0.5, -100.0)) -> Column:
    """Weighted sum of scores; the clash weight is negative and subtracted, as in the published setting."""
    a, b, c, d = weights
    return a * iptm + b * ptm + c * disorder - d * clash


def aligned_scores(pairs: DataFrame, structure: str, row: str, size: str, error: str, by: list[str]) -> DataFrame:
    """(structure, *by, score): template modelling scores from expected errors of pairs (structure, row, error, and the
    structure's size): for each residue the mean over its partners, for each group the best residue. ``by`` splits the
    pairs, such as into chain and partner's chain for scores between chains."""
    term = 1 / (1 + F.pow(F.col(error) / tm_scale(F.col(size)), F.lit(2.0)))
    rows = pairs.groupBy(structure, *by, row).agg(F.avg(term).alias("__mean"))
    return rows.groupBy(structure, *by).agg(F.max("__mean").alias("score"))
