"""The pipeline against the brute-force versions of its stages."""

import re

import corpus_pipeline
from quarry.llm import _bpe
from tests.llm.test_operators import brute_groups

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "packing"]

    good = stages["quality_classifier"](spark, docs, SF).cache()
    kept = {r.doc_id for r in good.collect()}
    known = [d for d in labels if d in {r.doc_id for r in docs.collect()}]
    assert sum((d in kept) == (labels[d] == 1) for d in known) >= 0.95 * len(known) and good.columns == docs.columns

    one = stages["ngram_jaccard_join"](spark, good, SF).cache()
    groups = brute_groups([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, (_, c) in groups.items() if c == d) and one.columns == docs.columns

    fair = stages["benchmark_decontamination"](spark, one, SF).cache()
    plain = {r.doc_id: " ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in one.collect()}
    assert {r.doc_id for r in fair.collect()} == {d for d, t in plain.items() if not any(f" {b} " in f" {t} " for b in bench)} and fair.columns == docs.columns

    safe = stages["secret_scans"](spark, fair, SF).cache()
    secret = re.compile(r'AKIA[0-9A-Z]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}')
    before = {r.doc_id: r.text for r in fair.collect()}
    assert {r.doc_id: r.text for r in safe.collect()} == {d: secret.sub("<SECRET>", t) for d, t in before.items()}
    assert all(len(r.text) == r.n_chars for r in safe.collect()) and safe.columns == docs.columns

    packed = stages["packing"](spark, safe, SF).collect()
    tokens = {r.doc_id: len(_bpe.encode(r.text, "byte_bpe_50k.json")) + 1 for r in safe.collect()}
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == tokens

    whole = {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).collect()}
    assert {d for d, _, _ in whole} == set(tokens)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, shared and null ids, and clashing extra columns."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").limit(1).collect()
    good = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id = {labels[0].doc_id}").first().text
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    extra = ("k", 1, "s", 0.5, 7)
    texts = [(1, good), (1, good), (2, None), (2, ""), (None, good + " one more"), (None, None), (3, good + " and so on. " * 3), (3, "another text of that id " * 30), (4, f"{good} {item} {good}"), (5, "long " * 200_000), (6, f'{good} token = "{"0123456789abcdef" * 2}01234567"')]
    rows = [(i, t, "en", "src0", None if t is None else len(t), *extra) for i, t in texts] + [(7, good[::-1], None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, gram string, score double, at int"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            packed = out.collect()
            assert sum(r.length for r in packed) == sum(len(_bpe.encode(t, "byte_bpe_50k.json")) + 1 for _, t, *_ in rows)
            continue
        assert out.columns == docs.columns and out.schema == docs.schema
        kept = [(r.doc_id, r.text) for r in out.collect()]
        assert set(k[0] for k in kept) <= {1, 2, 3, 4, 5, 6, 7, None}
        if name == "ngram_jaccard_join":
            # copies and near copies of doc 1 leave one; of rows that share an id one stays, rows without an id stay
            assert sorted(i for i, _ in kept if i is not None) == [1, 2, 3, 5, 7] or sorted(i for i, _ in kept if i is not None) == [1, 2, 3, 4, 5, 7]
            assert sum(i is None for i, _ in kept) == 2
        if name == "benchmark_decontamination":
            assert sorted((i is None, i or 0) for i, _ in kept) == sorted((i is None, i or 0) for i, *_ in rows if i != 4)
        if name == "secret_scans":
            assert len(kept) == len(rows) and [t for i, t in kept if i == 6] == [f'{good} token = "<SECRET>"']
            assert {r.n_chars for r in out.where("doc_id = 6").collect()} == {len(f'{good} token = "<SECRET>"')}
            assert sorted(str(k) for k in kept if k[0] != 6) == sorted(str(r[:2]) for r in rows if r[0] != 6)
