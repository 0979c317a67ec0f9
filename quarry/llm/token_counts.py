"""Token counts with a digest cache.

Texts are known by the SHA-256 digest of their normalised content and by the digest of the tokenizer's file. Counts
found in the cache are joined; each distinct text that is missing is encoded once and appended to the cache.

Normalisation only turns null into the empty text, so counts stay those of the text as given. Defined results: a null
or empty text has 0 bytes and 0 tokens; very long texts are encoded whole; repeated rows and rows that share an id each
get a row; an empty table gives an empty result; extra columns are ignored, and null ids are kept; an id column named
like an output column is given with ``_id`` appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import _bpe
from quarry.llm._session import cut, join_counted, map_arrow, own_name, shared_dir, slices

CACHE_SCHEMA = "digest binary, tokenizer string, n_bytes long, n_tokens long"


def content_digest(text: Column) -> Column:
    """Digest of the normalised content, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def encode_misses(misses: DataFrame, tokenizer: str) -> DataFrame:
    """Rows for the cache of distinct texts (digest, text)."""
    version = _bpe.version(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            counts = [len(_bpe.encode(t, tokenizer)) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest").cast(pa.binary()), pa.array([version] * len(texts), pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["digest", "tokenizer", "n_bytes", "n_tokens"],
            )

    return map_arrow(misses.select("digest", "text"), run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. ``cache_path`` is a Parquet folder that grows by the texts not in it yet;
    each call appends before it returns, and the result reads the cache."""
    spark, out_id = docs.sparkSession, own_name(id_col, ("digest", "n_bytes", "n_tokens"))
    version = _bpe.version(tokenizer)
    known = spark.read.schema(CACHE_SCHEMA).option("ignoreMissingFiles", "true").parquet(cache_path) if _exists(docs, cache_path) else spark.createDataFrame([], CACHE_SCHEMA)
    known = known.where(F.col("tokenizer") == version)
    content = docs.select(content_digest(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one text of each digest: combined before the shuffle, so thousands of copies cost one row a task
    distinct = content.groupBy("digest").agg(F.first("text").alias("text"))
    encode_misses(distinct.join(known.select("digest"), "digest", "left_anti"), tokenizer).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    counts = counts.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))  # two runs at a time may both append a text
    # a text that many rows share has its count broadcast, so no task gets all of them
    rows = docs.select(F.col(id_col).alias(out_id), content_digest(F.col(text_col)).alias("digest"))
    copies = cut(rows.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1"))
    counts = counts.join(copies, "digest", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return join_counted(rows, counts, "digest", "copies", docs.count()).select(out_id, "n_bytes", "n_tokens")


def _exists(docs: DataFrame, path: str) -> bool:
    jvm = docs.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).exists(p)


def scratch_cache(docs: DataFrame) -> str:
    """A cache for one run, in the folder that the executors share."""
    import uuid

    return f"{shared_dir(docs.sparkSession)}/quarry-token-cache-{uuid.uuid4().hex}"
