"""Packed fingerprints and searches by Tanimoto similarity.

A fingerprint is an array of longs, 64 bits each. Equal fingerprints are one class, which is compared once. Few bits are rare
enough to find candidates by, so classes of both sides are dealt to strips, and each two strips are counted against each
other in a task, by products of matrices, tile by tile; no pair is a row before it is known to be alike. Tiles whose
numbers of bits are too far apart are left out: two fingerprints of a and b bits that are at least t alike have
min(a, b) >= t max(a, b).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.durable import stored

#: Classes of a strip, and of the two sides of a tile.
STRIP, TILE = 32_768, (1024, 4096)


def bit_numbers(features: Column, bits: int = 2048) -> Column:
    """The bit of each feature, by its MD5: sorted, each once."""
    return F.array_sort(F.array_distinct(F.transform(features, lambda f: (F.conv(F.substring(F.md5(f), 1, 8), 16, 10).cast("long") % bits).cast("int"))))


def folded(rows: DataFrame, bits: int = 2048) -> DataFrame:
    """(id, fingerprint) of rows (id, features), as ``packed`` makes it of ``bit_numbers``; each distinct feature of a batch is
    hashed once. Null features set no bit; a null array has no fingerprint."""
    words = -(-bits // 64)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            coded = lists.flatten().dictionary_encode()
            number = np.array([int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % bits for x in coded.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            known = coded.is_valid().to_numpy(zero_copy_only=False)
            is_set = np.zeros((len(lists), words * 64), np.uint8)
            is_set[row[known], number[coded.indices.drop_null().to_numpy()]] = 1
            values = pa.array(np.packbits(is_set, axis=1, bitorder="little").view("<i8").ravel())
            ends = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, values, mask=lists.is_null())], names=["id", "fingerprint"])

    return rows.select("id", "features").mapInArrow(fold, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint array<bigint>")


def packed(numbers: Column, bits: int = 2048) -> Column:
    """Bit numbers as an array of longs."""
    one = F.lit(1).cast("long")
    word = lambda w: F.aggregate(F.filter(numbers, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, (b % 64).cast("int"))))
    return F.transform(F.sequence(F.lit(0), F.lit(-(-bits // 64) - 1)), word)


def unpacked(fingerprint: Column) -> Column:
    """The numbers of the bits that are set."""
    word = lambda x, w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(x, b) == 1), lambda b: (b + w * 64).cast("int"))
    return F.flatten(F.transform(fingerprint, word))


def popcount(fingerprint: Column) -> Column:
    return F.aggregate(fingerprint, F.lit(0).cast("long"), lambda acc, x: acc + F.bit_count(x))


def shared(a: Column, b: Column) -> Column:
    """Bits that both have."""
    return popcount(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over the bits of either; null for two without bits, or where one is null."""
    both = shared(a, b)
    return both / F.nullif(popcount(a) + popcount(b) - both, F.lit(0).cast("long"))


def _classes(rows: DataFrame) -> DataFrame:
    """Distinct fingerprints with a bit or more, and how many rows have each."""
    counted = rows.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count("*").alias("members"))
    return stored(counted.withColumn("n", popcount(F.col("fingerprint"))).where("n > 0"), "fingerprints")


def _alike(queries: tuple[np.ndarray, np.ndarray], targets: tuple[np.ndarray, np.ndarray], threshold: float, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of queries, rows of targets, similarities) of two sides of (bits as bytes, number of bits), each sorted by the
    latter."""
    (bits_q, n_q), (bits_t, n_t) = queries, targets
    spread = lambda b: np.unpackbits(b, axis=1).astype(np.float32)
    for lo_t in range(0, len(n_t), TILE[1]):
        own_t = n_t[lo_t : lo_t + TILE[1]]
        wide = None
        for lo_q in range(0, len(n_q), TILE[0]):
            own_q = n_q[lo_q : lo_q + TILE[0]]
            if own_q[-1] < threshold * own_t[0] - 1e-6 or own_t[-1] < threshold * own_q[0] - 1e-6:
                continue
            wide = spread(bits_t[lo_t : lo_t + TILE[1]]).T if wide is None else wide
            shared = spread(bits_q[lo_q : lo_q + TILE[0]]) @ wide
            least = np.float32(threshold / (1 + threshold)) * (own_q[:, None] + own_t[None, :]).astype(np.float32)
            x, y = np.nonzero(shared > least - np.float32(0.01))  # all that can be, by rounded numbers
            both = shared[x, y].astype(np.float64)
            similarity = both / (own_q[x] + own_t[y] - both)
            keep = similarity > threshold if strict else similarity >= threshold
            yield x[keep] + lo_q, y[keep] + lo_t, similarity[keep]


def _compared(queries: DataFrame, targets: DataFrame, threshold: float, strict: bool, counted: bool) -> DataFrame:
    """Of classes: (q, t, similarity) of those alike, or (q, n) with the members of all targets like q (``counted``). Every
    two classes are looked at, so time grows with their number; a task's memory is bounded by two strips and a tile."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0, and 1 at most")
    strips = [max(1, -(-side.count() // STRIP)) for side in (queries, targets)]
    sides = []
    for side, (own, other) in enumerate((("i", "j"), ("j", "i"))):
        rows = (queries, targets)[side].withColumn(own, F.pmod(F.xxhash64("fingerprint"), F.lit(strips[side])).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(strips[1 - side] - 1))))
        sides.append(rows.select("i", "j", F.lit(side).alias("side"), "fingerprint", "members", "n"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        found = []
        for side in (0, 1):
            own = table.filter(pc.equal(table.column("side"), side)).sort_by("n").combine_chunks()
            if not len(own):
                return
            prints = own.column("fingerprint").combine_chunks()
            found.append((prints, (prints.flatten().to_numpy().reshape(len(own), -1).view(np.uint8), own.column("n").to_numpy()), own.column("members").to_numpy()))
        (prints_q, q, _), (prints_t, t, members) = found
        n = np.zeros(len(prints_q), np.int64)
        for x, y, similarity in _alike(q, t, threshold, strict):
            if counted:
                n += np.bincount(x, members[y], len(n)).astype(np.int64)
            elif len(x):
                yield pa.RecordBatch.from_arrays([prints_q.take(pa.array(x)), prints_t.take(pa.array(y)), pa.array(similarity)], names=["q", "t", "similarity"])
        if counted:
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([prints_q.take(pa.array(some)), pa.array(n[some])], names=["q", "n"])

    # a number of its own, as Spark would put small shuffles, whose work is large, into one task
    dealt = sides[0].union(sides[1]).repartition(min(4 * strips[0] * strips[1], 10_000), "i", "j")
    return dealt.groupBy("i", "j").applyInArrow(compare, "q array<bigint>, n bigint" if counted else "q array<bigint>, t array<bigint>, similarity double")


def similar(queries: DataFrame, targets: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """(query, target, similarity) of rows (id, fingerprint) whose similarity is at least the threshold (``strict``: more).
    Fingerprints that are null or have no bits are like none; all have equally many longs. Of ids that stand for equal
    fingerprints each is given."""
    pairs = _compared(_classes(queries), _classes(targets), threshold, strict, False)
    out = pairs.join(queries.select(F.col("id").alias("query"), F.col("fingerprint").alias("q")), "q").join(targets.select(F.col("id").alias("target"), F.col("fingerprint").alias("t")), "t")
    return out.select("query", "target", "similarity")


def count_similar(queries: DataFrame, targets: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """(query, n): how many targets ``similar`` gives for each query that has any; no pair is a row."""
    counts = _compared(_classes(queries), _classes(targets), threshold, strict, True).groupBy("q").agg(F.sum("n").alias("n"))
    return queries.select(F.col("id").alias("query"), F.col("fingerprint").alias("q")).join(counts, "q").select("query", "n")
