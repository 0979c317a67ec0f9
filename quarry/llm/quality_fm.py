"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector: counts of hashed words (root-scaled, unit length), statistics of its structure, and
metadata of size (number of characters and of lines). The machine has a weight for each feature and a low-rank vector
for each, whose dot products weigh all pairwise interactions; by the sum-of-squares identity,
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2``, a score takes linear time.

It is fitted on a bounded sample of labelled rows (``SAMPLE`` of each class at most, chosen by hash), never on
held-out ones, and labels, language, source and id are no features. Scores cover every whole text.

Defined results: null and empty texts are scored by their statistics; very long texts are scored whole; repeated rows
score alike, and of labelled rows that share an id one is learned from; ids with two different labels are not learned
from; without labelled documents of both classes the score is the label's share (0.5 without any); null ids are scored;
an empty table gives an empty result; extra columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._session import map_arrow, own_name, slices

#: Buckets of hashed words, rank of the interactions, and labelled rows of each class in the sample, at most.
BUCKETS, RANK, SAMPLE = 512, 8, 2000
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]=_~^\\]")
_MARKS = re.compile(r"[.,;:!?]")
_DIGITS = re.compile(r"[0-9]")
_SENTENCE = re.compile(r"[.!?]\s")
STATISTICS = 17


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure of a text and its size; each value is about 0 to 1."""
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    doubles = Counter(zip(words, words[1:], strict=False))
    symbols = len(_SYMBOLS.findall(text))
    capitals = sum(map(str.isupper, words))
    return [
        np.log1p(len(text)) / 12,
        np.log1p(len(lines)) / 8,
        np.log1p(len(words)) / 10,
        chars / n / 20,
        min(1.0, 10 * symbols / chars),
        min(1.0, symbols / n),
        min(1.0, 5 * len(_MARKS.findall(text)) / chars),
        min(1.0, 5 * len(_DIGITS.findall(text)) / chars),
        capitals / n,
        min(1.0, 10 * text.count("!") / chars),
        min(1.0, 10 * text.count("|") / chars),
        len(counts) / n,
        1 - len(doubles) / max(n - 1, 1),
        1 - len(set(lines)) / k,
        sum(x.rstrip().endswith((".", "!", "?", ":", '"')) for x in lines) / k,
        max(counts.values(), default=0) / n,
        min(1.0, 10 * len(_SENTENCE.findall(text)) / n),
    ]


def features(text: str | None, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector: places and values."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    held = np.zeros(BUCKETS, np.float32)
    for w, c in counts.items():
        b = memo.get(w)
        if b is None:
            if len(memo) > 50_000:
                memo.clear()
            b = memo[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        held[b] += c
    at = np.flatnonzero(held)
    values = np.sqrt(held[at])
    values /= max(float(np.sqrt((values**2).sum())), 1e-9)
    stats = np.array(statistics(text, words, counts), np.float32)
    return np.concatenate((at, BUCKETS + np.arange(STATISTICS))), np.concatenate((values, stats))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        return float(self.bias + self.weights[at] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum()))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.04, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Logistic loss, classes weighted alike, by full-batch Adam; the batch is gone through in blocks of rows, so the driver
    holds few numbers besides it."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    params = [np.zeros(1), np.zeros(d), rng.normal(0, 0.05, (d, RANK))]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    for step in range(1, steps + 1):
        b, w, v = params
        grads = [np.zeros(1), decay * w, decay * v]
        for lo in range(0, len(y), 256):
            part = x[lo : lo + 256].astype(float)
            part2, s = part * part, part @ v
            z = b[0] + part @ w + 0.5 * ((s**2).sum(1) - part2 @ (v**2).sum(1))
            g = weight[lo : lo + 256] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lo : lo + 256])
            grads[0] += g.sum()
            grads[1] += part.T @ g
            grads[2] += part.T @ (g[:, None] * s) - v * (part2.T @ g)[:, None]
        for p, m, q, grad in zip(params, means, squares, grads, strict=True):
            m += 0.1 * (grad - m)
            q += 0.001 * (grad**2 - q)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1].astype(np.float32), params[2].astype(np.float32))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """Fits the machine; the driver gets at most 2 * SAMPLE feature vectors."""
    known = labels.where(~is_held_out(F.col(id_col)) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y_max")).where("y = y_max")
    sample: list = []
    for y in (0, 1):
        rows = known.where(F.col("y") == y).select(F.col(id_col).alias("id"), "y").orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE).collect()
        sample += rows
    spark = docs.sparkSession
    kind = labels.schema[id_col].dataType.simpleString()
    chosen = spark.createDataFrame([(r["id"], int(r["y"])) for r in sample], f"id {kind}, y int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # 2 * SAMPLE ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in slices(batches):
            at, x = zip(*(features(t, memo) for t in batch.column(1).to_pylist()), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["id", "y", "at", "x"])

    found = map_arrow(rows.select("id", "text", "y"), run, f"id {kind}, y int, at array<int>, x array<float>").dropDuplicates(["id"]).toArrow().sort_by("id")
    x, y = np.zeros((found.num_rows, BUCKETS + STATISTICS), np.float32), found.column("y").to_numpy().astype(float)
    for i, (a, v) in enumerate(zip(found.column("at").to_pylist(), found.column("x").to_pylist(), strict=True)):
        x[i, a] = v
    if len(set(y)) < 2:  # labelled documents of both classes are not at hand
        share = y.mean() if len(y) else 0.5
        return Machine(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(BUCKETS + STATISTICS, np.float32), np.zeros((BUCKETS + STATISTICS, RANK), np.float32))
    return fit(x, y)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    kind, out_id = docs.schema[id_col].dataType.simpleString(), own_name(id_col, ("score",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in slices(batches):
            z = np.array([machine.margin(*features(t.as_py(), memo)) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=[out_id, "score"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"`{out_id}` {kind}, score double")


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The documents with a score of 0.5 or more, all columns as given."""
    types = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            good = [machine.margin(*features(t.as_py(), memo)) >= 0 for t in texts]
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_arrow(docs, run, types)
