"""The quality scores of a table against all pairwise products of its features."""

import numpy as np
import pytest

from quarry.llm import quality_fm

SF = "/root/testdata/sf0.001"


def test_scores_of_a_table(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    machine = quality_fm.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_fm.score(docs, machine).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    pairs = machine.factors.astype(float) @ machine.factors.astype(float).T
    for doc_id, text in texts.items():
        x = np.zeros(quality_fm.BUCKETS + quality_fm.STATISTICS)
        at, values = quality_fm.features(text, {})
        x[at] = values
        z = machine.bias + machine.weights.astype(float) @ x + sum(pairs[i, j] * x[i] * x[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert got[doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_blocks_of_rows_fit_alike():
    """The fit adds up blocks of rows: the same as over all rows at once."""
    rng = np.random.default_rng(3)
    x = rng.random((700, 12)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0.3).astype(float)
    machine = quality_fm.fit(x, y, steps=60)
    again = quality_fm.fit(x[::-1].copy(), y[::-1].copy(), steps=60)
    assert np.allclose(machine.weights, again.weights, atol=1e-3) and machine.bias == pytest.approx(again.bias, abs=1e-3)
    z = np.array([machine.margin(np.arange(12), row) for row in x])
    assert ((z > 0) == (y == 1)).mean() > 0.85
