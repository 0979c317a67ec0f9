"""Readers of sequence and alignment text files: FASTA, A3M, Stockholm and M8 tables.

Spark splits files at their records or lines, wherever these fall, so a file of any size is read by many tasks; a row's
number in its file comes from the counts of the blocks before its own. Rows are taken apart by column functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.sequences import characters, deletions_before, without_insertions

M8_COLUMNS = "query_id string, template_id string, seq_identity double, aln_len int, n_gaps int, n_mismatches int, query_start int, query_end int, template_start int, template_end int, e_value double, bit_score double, cigar string"
#: What stands for a gap in a Stockholm row, and the extensions of alignments.
GAPS, A3M, STOCKHOLM = ("-", "."), ".a3m", ".sto"


def pieces(spark: SparkSession, path: str | list[str], mark: str) -> DataFrame:
    """(file, block, at, value): the text between marks; ``at`` orders those of a block, and ``block`` (the byte at which a
    task began) a file's blocks."""
    read = spark.read.option("lineSep", mark).text(path)
    return read.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def numbered(rows: DataFrame, name: str = "row_idx") -> DataFrame:
    """Adds a row's number in its file, from 0. Rows are numbered within a block, and blocks by the rows before them, so
    no task gets more than a block's."""
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(W.partitionBy("file", "block").orderBy("at"))
    return rows.join(sizes.select("file", "block", before.alias("__before")), ["file", "block"]).withColumn(name, (F.col("__before") + inner - 1).cast("int")).drop("__before")


def fasta_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, header, sequence) of FASTA-like files: a record starts with ``>`` at a line's start, its sequence may
    span lines; blank lines and those that start with ``#`` are skipped."""
    rows = pieces(spark, path, "\n>")
    # what comes before a file's first record is none
    first = (F.col("block") == 0) & (F.col("at") == F.min("at").over(W.partitionBy("file", "block")))
    rows = rows.withColumn("__first", first).where(~F.col("__first") | F.col("value").startswith(">"))
    lines = F.transform(F.split(F.when(F.col("__first"), F.expr("substring(value, 2)")).otherwise(F.col("value")), "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "\\s+$", "")))
    kept = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: (x != "") & ~x.startswith("#"))
    return rows.select("file", "block", "at", F.get(lines, F.lit(0)).alias("header"), F.array_join(kept, "").alias("sequence"))


def stockholm_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, row, row_idx, description): a row's parts in all blocks of the alignment joined, rows in order of first
    appearance; the description is that of a ``#=GS name DE`` line."""
    lines = numbered(pieces(spark, path, "\n").withColumn("value", F.trim(F.regexp_replace("value", "\\s+$", ""))), "line")
    parts = lines.where("value <> '' AND NOT value LIKE '#%' AND NOT value LIKE '//%'").select("file", "line", F.regexp_extract("value", r"^(\S+)\s*(.*)$", 1).alias("name"), F.regexp_extract("value", r"^(\S+)\s*(.*)$", 2).alias("part"))
    rows = parts.groupBy("file", "name").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"]), "").alias("row"))
    about = lines.select("file", "line", F.regexp_extract("value", r"^#=GS\s+(\S+)\s+DE\s+(.*)$", 1).alias("name"), F.regexp_extract("value", r"^#=GS\s+(\S+)\s+DE\s+(.*)$", 2).alias("text"))
    about = about.where("name <> ''").groupBy("file", "name").agg(F.max_by("text", "line").alias("description"))
    order = F.row_number().over(W.partitionBy("file").orderBy("line")) - 1  # an alignment's rows, not a file's lines
    return rows.join(about, ["file", "name"], "left").select("file", "name", "row", order.alias("row_idx"), F.coalesce("description", F.lit("")).alias("description"))


def against_query(query: Column, row: Column) -> Column:
    """A Stockholm row as one of A3M: columns in which the query has a gap are insertions, in lower case, or left out."""
    both = F.arrays_zip(characters(query).alias("q"), characters(row).alias("c"))
    kept = F.filter(both, lambda x: ~x["q"].isin(*GAPS) | ~x["c"].isin(*GAPS))
    return F.array_join(F.transform(kept, lambda x: F.when(x["q"].isin(*GAPS), F.lower(x["c"])).otherwise(F.upper(x["c"]))), "")


def alignment_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row_idx, name, header, a3m) of A3M and Stockholm files, by extension; others give no rows. The first row is the
    query."""
    a3m = numbered(fasta_records(spark, path).where(F.col("file").endswith(A3M)))
    one = a3m.select("file", "row_idx", F.element_at(F.split("header", " "), 1).alias("name"), "header", F.col("sequence").alias("a3m"))
    sto = stockholm_lines(spark, path).where(F.col("file").endswith(STOCKHOLM))
    query = sto.where("row_idx = 0").select("file", F.col("row").alias("query"))
    two = sto.join(query, "file").select("file", "row_idx", "name", F.col("description").alias("header"), against_query(F.col("query"), F.col("row")).alias("a3m"))
    return one.unionByName(two)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row_idx, header, sequence)."""
    return numbered(fasta_records(spark, path)).select("file", "row_idx", "header", "sequence")


def first_by_header(fasta: DataFrame) -> DataFrame:
    """Of records with one header in a file, the first."""
    best = F.min_by(F.struct(*fasta.columns), "row_idx").alias("r")
    return fasta.groupBy("file", "header").agg(best).select("r.*")


def read_msa(spark: SparkSession, path: str | list[str], max_rows: int | None = None) -> DataFrame:
    """(file, row_idx, header, aligned, deletions) of A3M and Stockholm files. A cap on rows counts the query."""
    rows = alignment_rows(spark, path)
    rows = rows if max_rows is None else rows.where(F.col("row_idx") < max_rows)
    header = F.when(F.col("file").endswith(A3M), F.col("header")).otherwise(F.col("name"))
    return rows.select("file", "row_idx", header.alias("header"), without_insertions(F.col("a3m")).alias("aligned"), deletions_before(F.col("a3m")).alias("deletions"))


def read_m8(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Hits of an M8 table with their entry and chain, and ``index``, the order by e-value within the query."""
    hits = spark.read.csv(path, sep="\t", schema=M8_COLUMNS)
    parts = F.split("template_id", "_")
    order = F.row_number().over(W.partitionBy("query_id").orderBy("e_value", "template_id", "query_start"))
    return hits.select("*", parts[0].alias("entry_id"), F.coalesce(F.get(parts, 1), F.lit("1")).alias("chain_id"), order.alias("index"))


HIT_HEADER = re.compile(r"^(?P<entry>[^\s_/]+)_(?P<chain>[^\s/]+)/(?P<start>\d+)-(?P<end>\d+)")


def hit_header(header: str) -> tuple[str, str, int, int] | None:
    """(entry, chain, start, end) of a header such as ``1abc_A/5-80``; none without coordinates."""
    m = HIT_HEADER.match(header)
    return (m["entry"], m["chain"], int(m["start"]), int(m["end"])) if m else None


def read_template_hits(spark: SparkSession, path: str | list[str], max_hits: int | None = None) -> DataFrame:
    """(file, index, entry_id, chain_id, start, query, aligned, reason) of the templates in A3M and Stockholm files.

    Row 0 is the query, whose residues start at 1, and doesn't count as a hit. Insertions are lower-case letters, ``query``
    is the aligned query of the file. Hits are named like ``1abc_A/5-80``; one without residues in its name, or without
    ``mol:protein`` in its description, has a ``reason`` and no entry, as its alignment would have to be made anew. Other
    files and empty ones give no rows; M8 tables have a reader of their own."""
    rows = alignment_rows(spark, path)
    rows = rows if max_hits is None else rows.where(F.col("row_idx") <= max_hits)
    query = rows.where("row_idx = 0").select("file", F.col("a3m").alias("query"))
    at = lambda k: F.regexp_extract("name", HIT_HEADER.pattern.replace("?P<", "?<"), k)
    own = F.split(F.element_at(F.split("name", "/"), 1), "_", 2)
    named, is_query = at(1) != "", F.col("row_idx") == 0
    reason = F.when(~is_query & ~named, "no residues in its name").when(~is_query & ~F.col("header").contains("mol:protein"), "no protein")
    good = is_query | reason.isNull()
    return rows.join(query, "file").select(
        "file",
        F.col("row_idx").alias("index"),
        F.when(is_query, own[0]).when(good, at(1)).alias("entry_id"),
        F.when(is_query, F.coalesce(F.when(F.get(own, F.lit(1)) != "", F.get(own, F.lit(1))), F.lit("1"))).when(good, at(2)).alias("chain_id"),
        F.when(is_query, F.lit(1)).when(good, at(3).try_cast("int")).alias("start"),
        "query",
        F.col("a3m").alias("aligned"),
        reason.alias("reason"),
    )


def write_fasta(rows: DataFrame, path: str, header: str = "header", sequence: str = "sequence") -> None:
    """Two lines per record, in order of header."""
    rows.orderBy(header).select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence)).alias("value")).write.text(path)
