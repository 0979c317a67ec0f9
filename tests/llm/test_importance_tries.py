"""Importance resampling against a plain version that joins words and hashes each feature anew."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import importance_tries, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, rank int, n_words string, __short int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", "!!", "One two THREE", "é漢 Zwölf zwölf x_y 12-13", "the cat sat on the mat " * 9, "a b c d e f g h i j k l m n o p q r s t u v", "the " * 5000, " ".join(f"w{i % 977}" for i in range(9000))]


def plain(docs, target, n, buckets, percent, min_words, seed):
    def found(text):
        return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))

    def features(text):
        w = found(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in side for b in features(x)) for side in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        own = features(text)
        weight = math.floor(sum(gain[b] for b in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(found(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    good = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {r: i + 1 for i, r in enumerate(good[: math.floor(percent * len(good) / 100)])}
    return [(*r, ranks.get(r)) for r in out]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize(("n", "buckets", "nodes"), [(1, 10_000, 200_000), (3, 500, 200_000), (2, 64, 40)])
def test_against_plain(spark, monkeypatch, n, buckets, nodes):
    monkeypatch.setattr(importance_tries, "NODES", nodes)
    rows = [(i, f"{t or ''} {'mat' * (i % 3)}" if i % 5 else t, "s", 1, "w", 2) for i, t in enumerate(TEXTS * 6)]
    docs, target = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([("the mat sat",), (None,), ("zwölf Cats 12",)], "text string")
    got = importance_tries.resample(docs, target, n=n, buckets=buckets, percent=30, min_words=5, seed=11)
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain([r[:2] for r in rows], ["the mat sat", None, "zwölf Cats 12"], n, buckets, 30, 5, 11))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c", "", 0, "", 0), (None, "a b c", "", 0, "", 0), (3, "a b c", "", 0, "", 0), (3, "a b c", "", 0, "", 0), (4, None, None, None, None, None)]
    docs, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    got = importance_tries.resample(docs, none, n=1, buckets=100, percent=100, min_words=1).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4] and len(got) == 5
    assert importance_tries.resample(none, docs, n=1).collect() == []
    assert ordered(tuple(r) for r in importance_tries.resample(docs, None, n=1, buckets=100).collect()) == ordered(tuple(r) for r in importance_tries.resample(docs, none, n=1, buckets=100).collect())


def test_query_against_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(r[0], *r[2:]) for r in plain(docs, target, 1, 10_000, 10, 20, 2024)]
    assert ordered(tuple(r) for r in queries.op12_importance_tries(spark, SF).collect()) == ordered(want)
