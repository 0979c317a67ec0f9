"""Packing of documents into fixed windows by Karmarkar-Karp multiway differencing.

Each document's ids are cut into full windows, which need no partner, and a rest, cut again into pieces of at most
``PIECE`` ids. The pieces of about ``GROUP`` rests are packed together: differencing starts from one partial partition
per piece and keeps merging the two with the largest spreads so that the heaviest part of one meets the lightest of
the other. That gives windows of nearly equal length; whenever one exceeds the capacity, the group is partitioned
again into one window more.

A group is a run of rests within one input partition, so nothing is shuffled, memory is bounded by a group, and a lost
task makes the same windows again. The rests at a partition's end are one group, or two halves of more than a group.
Defined results: a null or empty text is only the end id; very long texts are cut into full windows and a rest; repeated
rows, and rows that share an id, are packed as often as they occur; null ids are kept; an empty table gives no pieces;
extra columns are ignored; ties are settled by row order; an id column named like an output column is given with ``_id``
appended.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _bpe
from quarry.llm._session import map_arrow, own_name, slices

#: Rests in a group, and the longest piece of a rest: shorter pieces leave less padding, longer ones cut less.
GROUP, PIECE = 512, 512
#: Full windows that are held back before they are handed on.
FULL = 128


def difference(lengths: list[int], k: int) -> np.ndarray:
    """Multiway differencing: the window (0 to k-1) of each item, with nearly equal sums.

    A partial partition is the sums of its parts, descending, and for each part a node of items. Only parts that hold
    items are kept (an item alone is one part), so all partial partitions together take memory in proportion to the
    items, not to items times windows. Of two that merge, part i of one meets part k-1-i of the other; parts that meet
    become a new node over both, and once all k parts hold items, sums count from the smallest."""
    n = len(lengths)
    nodes, lefts, rights = n, [], []
    heap = [(-int(x) if k > 1 else 0, i, np.array([x], np.int32), np.array([i], np.int32)) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, sums_a, parts_a = heapq.heappop(heap)
        _, _, sums_b, parts_b = heapq.heappop(heap)
        met = max(0, len(sums_a) + len(sums_b) - k)  # the smallest parts of one meet the smallest of the other, crosswise
        alone_a, alone_b = len(sums_a) - met, len(sums_b) - met
        both = sums_a[alone_a:] + sums_b[alone_b:][::-1]
        lefts.extend(parts_a[alone_a:].tolist())
        rights.extend(parts_b[alone_b:][::-1].tolist())
        sums = np.concatenate((sums_a[:alone_a], both, sums_b[:alone_b]))
        parts = np.concatenate((parts_a[:alone_a], np.arange(nodes, nodes + met, dtype=np.int32), parts_b[:alone_b]))
        nodes += met
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, parts[order]))
    window = np.full(nodes, -1, np.int32)
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    for node in range(nodes - 1, n - 1, -1):
        window[lefts[node - n]] = window[rights[node - n]] = window[node]
    return window[:n]


def pack(lengths: list[int], capacity: int) -> np.ndarray:
    """Windows of items, none over the capacity: as few as differencing reaches, one more whenever it is exceeded."""
    if not lengths:
        return np.zeros(0, np.int64)
    if max(lengths) > capacity:
        raise ValueError("an item is longer than the capacity")
    k = -(-sum(lengths) // capacity)
    while True:
        windows = difference(lengths, k)
        if np.bincount(windows, weights=lengths, minlength=k).max() <= capacity:
            return windows
        k += 1


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    kind, out_id = docs.schema[id_col].dataType.simpleString(), own_name(id_col, ("start", "length", "doc_tokens", "ids", "sequence_id", "offset"))
    piece = min(PIECE, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        full: list[tuple] = []
        held: list[tuple] = []
        rests = 0

        def out(rows: list[tuple], windows: list[int], offsets: list[int]) -> pa.RecordBatch:
            ids, starts, totals, raws = zip(*rows, strict=True)
            longs = (starts, [len(r) // 4 for r in raws], totals)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *(pa.array(x, pa.int64()) for x in longs), pa.array(raws, pa.binary()), pa.array(windows, pa.int64()), pa.array(offsets, pa.int64())],
                names=[out_id, "start", "length", "doc_tokens", "ids", "sequence_id", "offset"],
            )

        def whole() -> pa.RecordBatch:
            nonlocal sequence, full
            batch = out(full, list(range(sequence, sequence + len(full))), [0] * len(full))
            sequence, full = sequence + len(full), []
            return batch

        def packed(n: int) -> pa.RecordBatch:
            """The first n pieces that are held, as a group."""
            nonlocal sequence, held
            group, held = held[:n], held[n:]
            lengths = [len(r[3]) // 4 for r in group]
            windows = pack(lengths, capacity).tolist()
            used, offsets = [0] * (max(windows) + 1), []
            for w, x in zip(windows, lengths, strict=True):
                offsets.append(used[w])
                used[w] += x
            batch = out(group, [sequence + w for w in windows], offsets)
            sequence += len(used)
            return batch

        for batch in slices(batches, 128):
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = [*_bpe.encode(text.as_py(), tokenizer), end_id]
                raw, n = _bpe.as_bytes(ids), len(ids)
                body = n - n % capacity
                full.extend((doc_id, s, n, raw[4 * s : 4 * (s + capacity)]) for s in range(0, body, capacity))
                held.extend((doc_id, s, n, raw[4 * s : 4 * min(n, s + piece)]) for s in range(body, n, piece))
                rests += body < n
                if len(full) >= FULL:
                    yield whole()
                if rests >= 2 * GROUP:  # what is left at a partition's end then has half a group's choice at least
                    rests = GROUP
                    yield packed(len(held) // 2)
        if full:
            yield whole()
        if rests > GROUP:
            yield packed(len(held) // 2)
        if held:
            yield packed(len(held))

    schema = f"`{out_id}` {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, schema)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The training sequences: ids in order of offset, padded to the capacity unless their number is a power of two."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"), F.sum("length").alias("length"))
    joined = F.array_join(F.transform("pieces", lambda p: F.hex(p["ids"])), "")
    pad = F.when(F.expr("bit_count(length)") == 1, F.lit(0)).otherwise(F.lit(capacity) - F.col("length"))
    blank = int(pad_id).to_bytes(4, "little").hex().upper()
    return rows.select("sequence_id", "length", pad.alias("padding"), F.unhex(F.concat(joined, F.repeat(F.lit(blank), pad.cast("int")))).alias("ids"))
