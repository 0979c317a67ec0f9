"""SQL functions and table functions for a session, and readers by extension.

``register`` makes temporary functions of SQL expressions, so a query in plain SQL stays in Spark's own operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.sources import alignments, structures

#: Name and signature, kind of result, expression. Insertions of an A3M row are lower-case letters.
FUNCTIONS = (
    ("a3m_aligned(a3m STRING)", "STRING", "regexp_replace(a3m, '[a-z]', '')"),
    ("a3m_deletions(a3m STRING)", "ARRAY<INT>", "transform(regexp_extract_all(a3m, '([a-z]*)[^a-z]', 1), r -> length(r))"),
    ("index_map(query STRING, target STRING, query_start INT, target_start INT)", "ARRAY<STRUCT<q: INT, t: INT>>",
     """aggregate(filter(zip_with(filter(split(query, ''), c -> c <> ''), filter(split(target, ''), c -> c <> ''), (q, t) -> named_struct('q', q, 't', t)), x -> x.q <> '-' OR x.t <> '-'),
        named_struct('q', query_start, 't', target_start, 'out', CAST(array() AS ARRAY<STRUCT<q: INT, t: INT>>)),
        (a, x) -> named_struct('q', CAST(a.q + IF(x.q = '-', 0, 1) AS INT), 't', CAST(a.t + IF(x.t = '-', 0, 1) AS INT),
            'out', concat(a.out, array(named_struct('q', IF(x.q = '-', -1, a.q), 't', IF(x.t = '-', -1, a.t))))),
        a -> a.out)"""),
    ("cigar_positions(cigar STRING, query_start INT, target_start INT)", "ARRAY<STRUCT<q: INT, t: INT>>",
     """aggregate(transform(regexp_extract_all(cigar, '([0-9]+[MIDNSHPX=])', 1), r -> named_struct('n', CAST(regexp_extract(r, '[0-9]+', 0) AS INT), 'b', right(r, 1) IN ('M', '=', 'X'), 'q', right(r, 1) IN ('I', 'S'))),
        named_struct('q', query_start, 't', target_start, 'out', CAST(array() AS ARRAY<STRUCT<q: INT, t: INT>>)),
        (a, s) -> named_struct('q', CAST(a.q + IF(s.b OR s.q, s.n, 0) AS INT), 't', CAST(a.t + IF(s.q, 0, s.n) AS INT),
            'out', concat(a.out, transform(IF(s.n > 0, sequence(0, s.n - 1), CAST(array() AS ARRAY<INT>)), i -> named_struct('q', IF(s.b OR s.q, CAST(a.q + i AS INT), -1), 't', IF(s.q, -1, CAST(a.t + i AS INT)))))),
        a -> a.out)"""),
    ("header_species(header STRING)", "STRING", "get(split(header, '[|_/:-]'), 3)"),
)
#: Name and signature, columns, query. A record begins with ``>`` at a line's start.
TABLE_FUNCTIONS = (
    ("parse_fasta(content STRING)", "row_idx INT, header STRING, sequence STRING",
     """SELECT CAST(pos AS INT), rtrim(get(split(col, '\\\\r?\\\\n'), 0)), array_join(filter(transform(slice(split(col, '\\\\r?\\\\n'), 2, greatest(size(split(col, '\\\\r?\\\\n')) - 1, 0)), x -> trim(x)), x -> x <> '' AND NOT startswith(x, '#')), '')
        FROM posexplode(slice(split(concat('\\n', content), '\\n>'), 2, greatest(size(split(concat('\\n', content), '\\n>')) - 1, 0)))"""),
    ("parse_a3m(content STRING)", "row_idx INT, header STRING, aligned STRING, deletions ARRAY<INT>",
     "SELECT row_idx, header, a3m_aligned(sequence), a3m_deletions(sequence) FROM parse_fasta(content)"),
)
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".fasta": alignments.read_fasta,
    ".fa": alignments.read_fasta,
    ".a3m": alignments.read_msa,
    ".sto": alignments.read_msa,
    ".m8": alignments.read_m8,
    ".cif": structures.read_mmcif_atoms,
    ".json": lambda spark, path: structures.read_metadata(spark, path)[0],
    ".parquet": lambda spark, path: spark.read.parquet(path),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, result, expression in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {result} RETURN {expression}")
    for name, columns, query in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS TABLE ({columns}) RETURN {query}")
    return [name.partition("(")[0] for name, *_ in (*FUNCTIONS, *TABLE_FUNCTIONS)]


def register_reader(extension: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
    """A reader for files of an extension, such as ``.sdf``; one that is there is replaced."""
    if not extension.startswith("."):
        raise ValueError("an extension starts with a dot")
    READERS[extension.lower()] = read


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file, or of a pattern of files, by its extension."""
    found = next((r for e, r in READERS.items() if path.lower().endswith(e)), None)
    if found is None:
        raise ValueError(f"no reader for {path}; there are readers for {', '.join(sorted(READERS))}")
    return found(spark, path)
