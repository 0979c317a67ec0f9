"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. Near copies are those of five-word shingles at a similarity of 0.8 or more.

Every stage takes nulls in any column, empty and very long texts, repeated rows, rows that share an id, empty tables and
extra columns; what becomes of them is stated with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import ngram_join, packing, quality_fm, secret_scan, template_decontam
from quarry.llm._session import read_table, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine takes for good ones; fitted to the labels of those given. Null and empty
    texts are judged by their statistics, rows without an id and repeated rows by their text; without labels, or with an
    empty table, all rows stay."""
    return quality_fm.keep_good(docs, quality_fm.train(docs, read_table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. Null and empty texts and rows without an id
    stay; of rows that share an id, and of repeated rows, one stays."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts, and rows without an id, stay; of rows that share an id
    all go if one holds an item; an empty benchmark takes none away."""
    return template_decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` in step. Null and empty texts stay as they are;
    repeated rows are changed alike."""
    words = secret_scan.dictionary(docs)
    return secret_scan.redact(docs, secret_scan.train(spark, words=words), length_col="n_chars", words=words)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of at most 2048. A null or empty text is the end id alone;
    repeated rows are packed as often as they occur; an empty table gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]
#: A fitted classifier and byte-level BPE are not expressible in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
