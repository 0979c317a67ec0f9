"""Target-distribution importance resampling over hashed n-grams, with word tries local to a partition.

Each task keeps a trie of words. A node is a run of words: it holds how often the run occurred and the CRC-32 state of its
text, so a longer run's CRC goes on from its parent's and the last words alone are hashed. The counts of a task's nodes
are added up by bucket, and only these totals, at most one a bucket and task, are merged. A bucket's gain is the log of
its share in the target over its share in the corpus. To score, the texts walk tries whose nodes have the gains of their
buckets attached. With a Gumbel number added to each weight, the highest scores are a sample without replacement by
weight.

A trie that has grown to ``NODES`` nodes is emptied into the totals and begun again, so memory is bounded and all is
counted. The driver gets the buckets' totals (a parameter, not growing with the data) and the number of rows to draw.

Defined results: a null or empty text has no words, no features, and weight 0; very long texts are walked whole; repeated
rows, and rows that share an id, are scored each (of equal scores and ids, any comes first); a null id counts as no digits and
comes last of equal scores; without target, or with an empty one, all t are 0; an empty table gives an empty result; extra
columns are ignored; an id column named like an output column is given with ``_id`` appended.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._session import map_arrow, own_name, slices, stored
from quarry.operators.order import positions

#: Nodes of a trie before it is begun again (about 300 bytes each).
NODES = 200_000
#: Words whose runs are walked at once.
STARTS = 4096
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A to Z lower-cased, as UTF-8."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


class _Children(dict):
    """The nodes after one node, by word; a word that is asked for first gets a new node."""

    __slots__ = ("trie", "crc", "gap")

    def __init__(self, trie: Trie, crc: int, gap: bytes):
        self.trie, self.crc, self.gap = trie, crc, gap

    def __missing__(self, word: bytes) -> int:
        node = self[word] = self.trie.add(zlib.crc32(self.gap + word, self.crc))
        return node


class Trie:
    """Runs of up to ``n`` words. ``crcs[node]`` is the CRC-32 of the run's words, joined by one space."""

    def __init__(self, n: int):
        self.n = n
        self.crcs: list[int] = []
        self.children: list[_Children | None] = []
        self.root = _Children(self, 0, b"")

    def __len__(self) -> int:
        return len(self.crcs)

    def add(self, crc: int) -> int:
        self.crcs.append(crc)
        self.children.append(None)
        return len(self.crcs) - 1

    def walk(self, run: list[bytes], starts: int) -> list[int]:
        """The nodes of all runs of 1 to n consecutive words that start in the first ``starts`` words."""
        level = [self.root[w] for w in run[:starts]]
        nodes = list(level)
        for k in range(1, self.n):
            below = []
            for node, word in zip(level, run[k:], strict=False):
                after = self.children[node]
                if after is None:
                    after = self.children[node] = _Children(self, self.crcs[node], b" ")
                below.append(after[word])
            level = below
            nodes += level
        return nodes


def parts(run: list[bytes], n: int) -> Iterator[list[bytes]]:
    """A text's words, STARTS at a time and the n - 1 after them, so each run of words starts in one part."""
    for lo in range(0, len(run), STARTS):
        yield run[lo : lo + STARTS + n - 1]


def bucket_totals(docs: DataFrame, n: int, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, total) of the features of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie, passed = np.zeros(buckets, np.int64), Trie(n), []

        def add_up() -> None:
            """The nodes passed so far, by node and then by bucket."""
            counts = np.bincount(np.asarray(passed, np.int64), minlength=len(trie))
            np.add.at(totals, np.asarray(trie.crcs, np.int64) % buckets, counts)
            passed.clear()

        for batch in slices(batches, 128):
            for text in batch.column(0):
                for part in parts(words(text.as_py()), n):
                    passed += trie.walk(part, STARTS)
                    if len(passed) >= 5 * NODES or len(trie) >= NODES:
                        add_up()
                    if len(trie) >= NODES:
                        trie = Trie(n)
        add_up()
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(totals[held], pa.int64())], names=["bucket", "total"])

    of_tasks = map_arrow(docs.select(F.col(text_col)), run, "bucket int, total long")
    return of_tasks.groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(corpus: DataFrame, target: DataFrame | None, n: int, buckets: int, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """floor(1000 * ln(share of a bucket in the target / its share in the corpus)), each with one added to its count."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for side, table, column in ((s, corpus, text_col), (t, target, target_col)):
        for row in bucket_totals(table, n, buckets, column).collect() if table is not None else []:  # at most one row a bucket
            side[row.bucket] = row.total
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): the mean gain of a text's features, rounded down."""
    kind, buckets, out_id = docs.schema[id_col].dataType.simpleString(), len(gain), own_name(id_col, OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, attached = Trie(n), np.zeros(0, np.int64)
        for batch in slices(batches, 128):
            sizes, features, weights = [], [], []
            for text in batch.column(1):
                found = words(text.as_py())
                total = held = 0
                for part in parts(found, n):
                    nodes = np.asarray(trie.walk(part, STARTS), np.int64)
                    if len(trie) > len(attached):  # nodes that are new get their gains
                        attached = np.concatenate((attached, gain[np.asarray(trie.crcs[len(attached) :], np.int64) % buckets]))
                    total += int(attached[nodes].sum())
                    held += len(nodes)
                    if len(trie) >= NODES:
                        trie, attached = Trie(n), np.zeros(0, np.int64)
                sizes.append(len(found))
                features.append(held)
                weights.append(total // held if held else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, features, weights))], names=[out_id, "n_words", "n_features", "weight"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"`{out_id}` {kind}, n_words long, n_features long, weight long")


OUT = ("n_words", "n_features", "weight", "score", "rank")


def resample(
    docs: DataFrame, target: DataFrame | None, n: int = 2, buckets: int = 10_000, percent: float = 10, min_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): of the rows with at least ``min_words`` words, ``percent`` percent are
    drawn, those of the highest scores; ``rank`` is 1, 2, ... in that order and null for the others."""
    out_id = own_name(id_col, OUT)
    weighed = weigh(docs, gains(docs, target, n, buckets, text_col, target_col), n, id_col, text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(out_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "importance")
    chosen = math.floor(percent * scored.where(F.col("n_words") >= min_words).count() / 100)
    # all rows by score: dealt by range, so no task gets more than its share of them
    order = scored.select("*", (F.col("n_words") < min_words).alias("__short"), (-F.col("score")).alias("__down"), F.col(out_id).isNull().alias("__none"))
    order = order.withColumn("__row", F.xxhash64(F.col(out_id), "n_words", "weight"))
    placed = positions(order, ["__short", "__down", "__none", out_id, "__row"])
    rank = F.when(F.col("position") < chosen, F.col("position") + 1)
    return placed.select(out_id, "n_words", "n_features", "weight", "score", rank.alias("rank"))
