"""The hierarchical Pitman-Yor model: seatings against exact expectations, scores against a plain version over the same
seating, and probabilities that sum to one."""

import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import pitman_yor as py

SCHEMA = "doc_id long, text string, train boolean, score string, row int, block int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")) + [None]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    vocabulary = [f"W{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(vocabulary, 30, p=weights / weights.sum())) for _ in range(60)]
    texts += [None, "", "  ", "w1 w1 w1 w1", "neverseen words here", "w2 W3\x0bw4\n" * 200, "the same pair " * 400] + ["hot hot"] * 40
    out = [(i, t, i % 5 != 1, "s", 0, 0) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "w1 w2", None, None, None, None)]


@pytest.mark.parametrize(("customers", "fresh", "discount"), [(3, 0.7, 0.5), (6, 0.2, 0.75), (12, 3.0, 0.3)])
def test_tables_have_the_exact_distribution(customers, fresh, discount):
    """P(t) is in proportion to fresh^t times the generalised Stirling number of (customers, t)."""
    stirling = {(0, 0): 1.0}
    for c in range(customers):
        for t in range(c + 2):
            stirling[c + 1, t] = stirling.get((c, t - 1), 0.0) + (c - discount * t) * stirling.get((c, t), 0.0)
    exact = np.array([fresh**t * stirling[customers, t] for t in range(1, customers + 1)])
    exact /= exact.sum()
    n = 20_000
    seating = py.Seating(np.full(n, customers), np.full(n, fresh), discount, np.random.default_rng(5))
    for _ in range(30):
        seating.sweep(np.full(n, fresh))
    found = np.bincount(seating.tables.astype(int), minlength=customers + 1)[1:] / n
    assert np.abs(found - exact).max() < 0.015


@pytest.mark.parametrize(("customers", "fresh", "discount"), [(17, 3.0, 0.75), (300, 40.0, 0.75), (300, 2000.0, 0.6), (5000, 25.0, 0.75), (5000, 0.6, 0.6), (5000, 3000.0, 0.75)])
def test_one_sweep_moves_every_customer(customers, fresh, discount):
    """A sweep after one with other weights: of dishes with many customers no more than 16 were moved, so their tables
    stayed about where they were."""
    log_s = np.full(customers + 1, -np.inf)  # of one customer, by tables
    log_s[1] = 0
    t = np.arange(customers + 1)
    for c in range(1, customers):
        with np.errstate(divide="ignore", invalid="ignore"):
            stays = np.where(t <= c, np.log(c - discount * t) + log_s, -np.inf)
        log_s = np.logaddexp(np.concatenate(([-np.inf], log_s[:-1])), stays)
    log_p = log_s + t * math.log(fresh)
    exact = np.exp(log_p - log_p.max())
    exact = np.cumsum(exact / exact.sum())
    n = 20_000
    seating = py.Seating(np.full(n, customers), np.full(n, fresh / 8), discount, np.random.default_rng(5))
    seating.sweep(np.full(n, fresh))
    found = np.cumsum(np.bincount(seating.tables.astype(int), minlength=customers + 1) / n)
    assert np.abs(found - exact).max() < 0.015


def test_strides_give_the_rows_of_single_steps():
    for n, discount in ((30, 0.6), (400, 0.75)):
        row = np.zeros(n)
        row[0] = 1
        single, rates = row.copy(), discount * np.arange(1, n)
        for c in range(1, 50_000):
            single[1:] += rates * (single[:-1] - single[1:]) / (c - discount)
        for at, c in ((1, 20), (20, 21), (21, 3000), (3000, 50_000)):
            row = py.carried(row, at, c, discount)
        assert np.abs(row - single).max() < 1e-9
        assert np.abs(py.summed(n, 50_000, discount) - single).max() < 1e-9


def test_sizes_add_up_to_the_customers():
    rng = np.random.default_rng(6)
    customers = rng.integers(0, 3000, 300)
    fresh = rng.random(300) * 50
    seating = py.Seating(customers, fresh, 0.6, rng)
    for _ in range(4):
        seating.sweep(fresh)
        for own, group in seating.groups:
            assert (group.sizes.sum(0) == customers[own]).all() and ((group.sizes > 0).sum(0) == group.count).all()
    assert (seating.tables <= customers).all() and (seating.tables[customers > 0] >= 1).all()


def plain_scores(rows, s):
    """Dictionaries over one part: the seating is the operator's, all that follows from it is worked out again."""
    counts, tokens_of = Counter(), [tokens(r[1]) for r in rows]
    for r, own in zip(rows, tokens_of, strict=True):
        if r[2]:
            counts.update(zip([0, *own[:-1]], own, strict=True))
    hashed = lambda w, end: int(end) if w in (None, 0) else int(py._words.Words([w]).hash[0])
    pairs = sorted(counts, key=lambda p: (hashed(p[1], py.END), hashed(p[0], py.BEGIN) >> 16))
    words, contexts = ([hashed(p[k], e) >> c for p in pairs] for k, e, c in ((1, py.END, 0), (0, py.BEGIN, 16)))
    every = sorted({hashed(w, py.END) for own in tokens_of for w in own})
    before = sorted({hashed(w, py.BEGIN) >> 16 for own in tokens_of for w in [0, *own[:-1]]})
    w, u = np.searchsorted(np.array(every, np.uint64), np.array(words, np.uint64)), np.searchsorted(np.array(before, np.uint64), np.array(contexts, np.uint64))
    c = np.array([counts[p] for p in pairs], float)
    rest, tables, word_rest, customers, root_tables = py.seat(w, u, c, np.zeros(len(every), bool), 1, 0, s)
    of_word, of_context = Counter(), Counter()
    for (a, b), k in counts.items():
        of_word[b] += k
        of_context[a] += k
    total, known = sum(counts.values()), len(of_word)
    root_of, tables_of = {}, defaultdict(float)
    for i, (a, b) in enumerate(pairs):
        root_of[b] = word_rest[w[i]]
        tables_of[a] = tables[u[i]]
    rests = {p: rest[i] for i, p in enumerate(pairs)}
    below = (s.root_strength + s.root_discount * root_tables) / (known + 1)
    parent = lambda x: (root_of.get(x, 0) + below) / (s.root_strength + customers)
    chance = lambda a, x: (rests.get((a, x), 0) + (s.strength + s.discount * tables_of[a]) * parent(x)) / (s.strength + of_context[a])
    for a in [0, "w1", "w2", "same", "not seen"]:
        assert sum(chance(a, x) for x in [*of_word, "not seen"]) == pytest.approx(1)
    out = []
    for r, own in zip(rows, tokens_of, strict=True):
        base = sum(math.log10((of_word[x] + 0.5) / (total + 0.5 * (known + 1))) for x in own)
        score = sum(math.log10(chance(a, x)) for a, x in zip([0, *own[:-1]], own, strict=True))
        out.append((r[0], len(own), sum(of_word[x] > 0 for x in own), total, base, score))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_scores_against_plain(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    s = py.Settings(samples=2)
    got = ordered(tuple(r) for r in py.score_texts(docs, F.col("train"), s).collect())
    for a, b in zip(got, ordered(plain_scores([(r[0], r[1], bool(r[2])) for r in rows], s)), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-5)


def test_many_blocks_and_parts(spark, rows, monkeypatch):
    """Small blocks cut texts in two, small parts spread hot words; counts stay and scores move little."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = ordered(tuple(r) for r in py.score_texts(docs, F.col("train")).collect())
    monkeypatch.setattr(py, "PART", 900)
    real = py.blocks
    import functools

    def small(batches, size):
        py.BLOCK = size
        return real(batches)

    monkeypatch.setattr(py, "blocks", functools.partial(small, size=150))
    cut = py.score_texts(docs, F.col("train"))
    monkeypatch.setattr(py, "BLOCK", 4_000_000)  # set back after the test
    cut = ordered(tuple(r) for r in cut.collect())
    for a, b in zip(whole, cut, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
        assert a[5] == pytest.approx(b[5], rel=0.1, abs=0.5)


def test_held_out_texts_are_foretold_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    scored = py.score_texts(docs, ~held).withColumn("held", held)
    model, base = (py.perplexity(scored.where("held"), c).first()[0] for c in ("score", "base_score"))
    assert model < 0.8 * base and scored.count() == docs.count()


def test_no_rows_no_training_and_clashing_names(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert py.score_texts(none, F.col("train")).collect() == []
    untrained = py.score_texts(spark.createDataFrame(rows[:5], SCHEMA), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untrained)
    named = spark.createDataFrame([("a", "x y")], "score string, text string")
    assert py.score_texts(named, F.lit(True), id_col="score").columns == ["score_id", *py.OUT]


def test_large_dishes_of_many_tables_take_no_longer_rows():
    """Weights of a dish by themselves, against generalised Stirling numbers; a pass over the rows of these took more than a minute."""
    customers, discount = 3051, 0.75
    log_s, t = np.full(customers + 1, -np.inf), np.arange(customers + 1)
    log_s[1] = 0
    for c in range(1, customers):
        with np.errstate(divide="ignore", invalid="ignore"):
            stays = np.where(t <= c, np.log(c - discount * t) + log_s, -np.inf)
        log_s = np.logaddexp(np.concatenate(([-np.inf], log_s[:-1])), stays)
    for rate in (1.0, 150.0, 6171.5, 1e5, 1e9):
        log_p = log_s + t * math.log(rate * discount)
        exact = np.exp(log_p - log_p.max())
        first, weight = py.far_weights(customers, rate, discount)
        found = np.zeros(customers + 1)
        found[first : first + len(weight)] = weight
        assert np.abs(exact / exact.sum() - found / found.sum()).sum() < 1e-8
    started = time.process_time()
    drawn = py.draw_tables(np.array([2_000_000, 1_000_000]), np.array([90_000.0, 300_000.0]), discount, np.random.default_rng(3))
    assert time.process_time() - started < 5
    assert (np.abs(drawn - [119_991, 389_454]) < [2100, 3600]).all()  # six times the standard deviation
