"""Order-explicit sequence analytics: runs, running numbers, profiles, pairing, smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.durable import map_arrow


def starts(value: Column, within: list[str], order: list[str]) -> Column:
    """True where the value differs from the row before it (first rows, too)."""
    before = F.lag(F.struct(value.alias("v"))).over(W.partitionBy(*within).orderBy(*order))
    return before.isNull() | ~before["v"].eqNullSafe(value)


def run_number(df: DataFrame, value: Column, within: list[str], order: list[str], name: str) -> DataFrame:
    """Number of the run of equal values that a row is in, from 0; a value that comes back starts a new run."""
    w = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__s", starts(value, within, order).cast("long")).withColumn(name, F.sum("__s").over(w) - 1).drop("__s")


def occurrence(within: list[str], order: list[str]) -> Column:
    """Running number, from 1, of a row among equals."""
    return F.row_number().over(W.partitionBy(*within).orderBy(*order))


def smooth_reflected(df: DataFrame, value: str, within: list[str], order: list[str], half: int) -> DataFrame:
    """Centred mean over 2 * half + 1 rows, where rows beyond an end are the mirrored ones (without the end row).

    Positions are reflected with period 2 (n - 1), so groups shorter than the window are right as well; only the
    ``half`` rows next to an end are repeated, not the whole group."""
    w = W.partitionBy(*within)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    # places outside [0, n) that reflect onto this row: i mirrored at 0 and at n - 1, as often as half asks for
    period = F.greatest(2 * (F.col("__n") - 1), F.lit(1))
    turns = F.sequence(-F.ceil(F.lit(half) / period) - 1, F.ceil(F.lit(half) / period) + 1)
    images = F.flatten(F.transform(turns, lambda k: F.array(F.col("__i") + k * period, k * period - F.col("__i"))))
    near = F.array_distinct(F.filter(images, lambda p: (p >= -half) & (p < F.col("__n") + half)))
    spread = rows.withColumn("__p", F.explode(near))
    mean = F.avg(F.col(value)).over(w.orderBy("__p").rowsBetween(-half, half))
    return spread.withColumn("smoothed", mean).where(F.col("__p") == F.col("__i")).drop("__i", "__n", "__p")


#: Characters that are counted together before a row is made of each count.
PROFILE_CHARACTERS = 4_000_000


def _code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), "<u4")


def profile(rows: DataFrame, group: list[str], text: Column) -> DataFrame:
    """(group, column, residue, share): how often each character stands in each column of a group of strings. Tasks count
    some million characters at a time, so a row is made of each count, not of each character."""
    n = rows.groupBy(*group).agg(F.count("*").alias("__n"))

    def counted(keys: list[pa.Array], texts: list[np.ndarray]) -> pa.RecordBatch:
        own = pa.Table.from_arrays(keys, names=group).append_column("__row", pa.array(np.arange(len(texts))))
        # the first row with an equal key stands for all
        first = own.group_by(group).aggregate([("__row", "min"), ("__row", "list")])
        stands = np.empty(len(texts), np.int64)
        lists = first.column("__row_list").combine_chunks()
        stands[lists.flatten().to_numpy()] = np.repeat(first.column("__row_min").to_numpy(), lists.value_lengths().to_numpy())
        lengths = np.array([len(t) for t in texts])
        width = int(lengths.max()) + 1
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters, letter = np.unique(np.concatenate(texts), return_inverse=True)
        cells, k = np.unique((np.repeat(stands, lengths) * width + place) * len(letters) + letter, return_counts=True)
        cells, letter = np.divmod(cells, len(letters)) if len(letters) else (cells, cells)
        row, place = np.divmod(cells, width)
        residues = pa.DictionaryArray.from_arrays(pa.array(letter), pa.array([chr(c) for c in letters], pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([key.take(pa.array(row)) for key in keys] + [pa.array(place), residues, pa.array(k.astype(np.int64))], names=[*group, "column", "residue", "k"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0
        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column(len(group))):
                texts.append(_code_points(text.as_py()))
                size += len(texts[-1])
                if size >= PROFILE_CHARACTERS:
                    keys.append(batch.slice(at, i + 1 - at))
                    yield counted([pa.concat_arrays([b.column(c) for b in keys]) for c in range(len(group))], texts)
                    keys, texts, size, at = [], [], 0, i + 1
            keys.append(batch.slice(at))
        if texts:
            yield counted([pa.concat_arrays([b.column(c) for b in keys]) for c in range(len(group))], texts)

    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)
    cells = map_arrow(rows.select(*group, text.alias("__text")), count, f"{kinds}, column bigint, residue string, k bigint")
    return cells.groupBy(*group, "column", "residue").agg(F.sum("k").alias("k")).join(n, group).select(*group, "column", "residue", (F.col("k") / F.col("__n")).alias("share"))


def compared(rows: DataFrame, query: str, other: str) -> DataFrame:
    """Rows with two columns of aligned strings in place of which stand ``matches`` (columns where both have the same residue)
    and ``covered`` (columns where both have one), as far as the shorter goes. Gaps are ``-``; null is the empty string."""
    kept = [f for f in rows.schema.fields if f.name not in (query, other)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((2, batch.num_rows), np.int64)
            for i, (q, t) in enumerate(zip(batch.column(query), batch.column(other), strict=True)):
                a, b = _code_points(q.as_py()), _code_points(t.as_py())
                a, b = a[: len(b)], b[: len(a)]
                some = a != ord("-")
                found[:, i] = np.count_nonzero(some & (a == b)), np.count_nonzero(some & (b != ord("-")))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(x) for x in found], names=[*(f.name for f in kept), "matches", "covered"])

    return map_arrow(rows.select(*(f.name for f in kept), query, other), count, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "matches bigint, covered bigint"]))


def paired_rows(rows: DataFrame, chain: str, species: str, order: list[str], n_chains: int, most: int, least_chains: int = 2) -> DataFrame:
    """Pairs rows of several chains by species: the k-th row of a species in one chain goes with its k-th row in the
    others. Species with more than ``most`` rows in a chain are left out. Level = number of chains that have a k-th row;
    rows of fewer than ``least_chains`` chains are not paired. All chains first, then fewer."""
    counts = rows.groupBy(species, chain).agg(F.count("*").alias("n")).groupBy(species).agg(F.max("n").alias("__m")).where(F.col("__m") <= most).select(species)
    numbered = rows.join(counts, species).withColumn("k", occurrence([species, chain], order))
    level = numbered.groupBy(species, "k").agg(F.count("*").alias("level")).where(F.col("level").between(least_chains, n_chains))
    return numbered.join(level, [species, "k"])
