"""Connected components by label propagation: over whole tables, and within groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.durable import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over edges. Each round takes the least label among neighbours and
    then the label of that label, which halves long chains; lineage is cut each round."""
    both = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        step = cut(step.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("above", "component")).alias("component")))
        labels = step.select("node", "component")
        if not step.where("component < old").limit(1).count():
            return labels


def smallest_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that edges a to b reach: the least label is handed to the labels of both ends, which
    halves long chains as above."""
    label = np.arange(n)
    while True:
        ends, low = (label[a], label[b]), np.minimum(label[a], label[b])
        step = label.copy()
        for end in ends:
            np.minimum.at(step, end, low)
        while (up := step[step])[step != up].size:
            step = up
        if (step == label).all():
            return label
        label = step


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Batches of a task sorted by their first column, in pieces of about so many rows that hold whole groups of it, each with
    the number of its group for every row."""
    held: list[pa.RecordBatch] = []
    size = 0

    def piece(table: pa.Table, last: bool) -> tuple[np.ndarray, int]:
        group = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return group, len(group) if last else int(np.argmax(group == group[-1]))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            group, whole = piece(table, False)
            if whole:
                yield group[:whole], table.slice(0, whole)
            # a group larger than a piece waits until twice as many rows are there
            held, size = table.slice(whole).to_batches(), 0 if whole else -table.num_rows + rows
    if held and (table := pa.Table.from_batches(held)).num_rows:
        group, whole = piece(table, True)
        yield group, table


def components_within(edges: DataFrame, group: str, a: str = "a", b: str = "b") -> DataFrame:
    """(group, node, component): as ``components``, for edges between whole numbers that don't leave their group. They are
    shuffled once, by group, and a task holds the edges of one group (a structure) or of as many small ones as make up a piece."""
    kinds = {c: edges.schema[c].dataType.simpleString() for c in (group, a)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, table in whole_groups(batches):
            ends = [table.column(i).to_numpy() for i in (1, 2)]
            names, place = np.unique(np.concatenate(ends), return_inverse=True)
            nodes, at, number = np.unique(np.tile(own, 2) * np.int64(len(names)) + place, return_index=True, return_inverse=True)
            least = smallest_reachable(*np.split(number, 2), len(nodes))
            of = table.column(0).combine_chunks().take(pa.array(at % len(own)))
            yield pa.RecordBatch.from_arrays([of, *(pa.array(names[x % len(names)], table.schema.field(1).type) for x in (nodes, nodes[least]))], names=["group", "node", "component"])

    rows = edges.select(group, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).repartition(F.col(group)).sortWithinPartitions(group)
    return rows.mapInArrow(run, f"group {kinds[group]}, node {kinds[a]}, component {kinds[a]}").withColumnRenamed("group", group)
