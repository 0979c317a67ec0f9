"""The queries of the training-data operators, over whole tables with production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import fill_middle, html_main, importance_tries, line_rules, ngram_join, packing, phrase_dedup, pitman_yor, quality_fm, secret_scan, template_decontam, token_counts, url_filters
from quarry.llm._session import read_table
from quarry.llm.oracles import ORACLE_SQL

#: Rules given for the url query, before the patterns.
URL_RULES = (
    url_filters.host_rule("net/", "block"),
    url_filters.host_rule("example.net/en/", "allow"),
    url_filters.host_rule("example.com/de/", "block"),
    url_filters.host_rule("org/fr/", "allow"),
    *url_filters.PATTERNS,
)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the texts of ``documents``: id, span in code points, kind, digest, probability. Null and empty texts have
    none; very long ones are searched whole; repeated rows each get theirs; an empty table gives none."""
    docs = read_table(spark, sf_dir, "documents")
    words = secret_scan.dictionary(docs)
    found = secret_scan.scan(docs, secret_scan.train(spark, words=words), words=words)
    return found.select(F.col("id").alias("doc_id"), "start", "end", "kind", "sha256", "probability")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` in sequences of at most 2048 tokens. Null and empty texts are the end id alone; very long
    ones fill sequences of their own; repeated rows are packed as often; ties go by row order; an empty table gives none."""
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every row of ``documents``. Null and empty texts have none; very long ones are encoded whole;
    repeated rows each get a row; an empty table gives none. The cache is new for each call."""
    docs = read_table(spark, sf_dir, "documents")
    counts = token_counts.count_tokens(docs, token_counts.scratch_cache(docs))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of three-word shingles of ``documents`` and their components at a similarity of 0.9. Null and empty texts have
    an empty set and are alone; repeated rows are copies; ties take the smallest id; an empty table gives none."""
    return ngram_join.similar_groups(read_table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every row of ``documents`` without repeated passages of 35 words. Null and empty texts have no words;
    very long ones are read whole; repeated rows lose the same words; an empty table gives none."""
    kept = phrase_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), width=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url of ``pages``. Null urls have an empty host and path and the default verdict;
    of equally long rules a block rule wins; repeated rows are judged alike; an empty table gives none."""
    return url_filters.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of every row of ``documents``. Null and empty texts have no words and fail; very long ones are
    judged whole; repeated rows are judged alike; an empty table gives none."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return line_rules.judge(read_table(spark, sf_dir, "documents")).select(*columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents``. Null and empty texts are scored by their statistics; very long ones whole;
    repeated rows score alike; without labels all score 0.5; an empty table gives none."""
    docs = read_table(spark, sf_dir, "documents")
    machine = quality_fm.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_fm.score(docs, machine)
    return scored.select("doc_id", quality_fm.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` in ``documents``, with the windows found and the slots changed. Null and empty texts hold none;
    very long ones are read whole; equal shares take the fewest changes; an empty table gives none."""
    return template_decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``. Null and empty pages give the empty text; very long ones are read whole; of equal
    regions the first is taken; repeated rows give equal texts; an empty table gives none."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_main.main_text(pages, html_main.learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents`` by the model and by single words. Null and empty texts are the end token; very long
    ones are scored whole; repeated rows are scored each; an empty table gives none."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scored = pitman_yor.score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_importance_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and scores of every row of ``documents`` against ``benchmark``, and the ranks of a tenth drawn of those with 20
    words. Null and empty texts weigh 0 and are not drawn; very long ones are walked whole; equal scores go to the smaller
    id; repeated rows are scored each; an empty table gives none."""
    docs, target = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    drawn = importance_tries.resample(docs, target, n=1, buckets=10_000, percent=10, min_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and digests of every row of ``documents``, cut at lines, and of the text rebuilt from each output. Null and empty
    texts, and those with a mark, stay plain; very long ones are cut whole; repeated rows alike; an empty table gives none."""
    made = fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"), units="lines", percent=100, spm_percent=50, seed=7)
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_packing": op2_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_token_counts": op4_token_counts,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_filters": op7_url_filters,
    "op8_phrase_dedup": op8_phrase_dedup,
    "op9_template_decontam": op9_template_decontam,
    "op10_quality_rules": op10_quality_rules,
    "op11_pitman_yor": op11_pitman_yor,
    "op12_importance_tries": op12_importance_tries,
    "op13_fill_middle": op13_fill_middle,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
