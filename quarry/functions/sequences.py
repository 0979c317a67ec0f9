"""Column functions over aligned strings, identifiers and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(text: Column) -> Column:
    """A string as an array of its characters."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def entry_and_chain(name: Column) -> tuple[Column, Column]:
    """``entry_chain`` in two; without an underscore the chain is 1, and with several the name is an error."""
    parts = F.split(name, "_")
    checked = F.when(F.size(parts) > 2, F.raise_error(F.concat(F.lit("more than one underscore: "), name))).otherwise(parts)
    return checked[0], F.when(F.size(parts) > 1, F.get(parts, 1)).otherwise("1")


def header_fields(header: Column) -> Column:
    """Fields of a sequence header, cut at ``|``, ``_``, ``/``, ``:`` and ``-``."""
    return F.split(header, "[|_/:-]")


def numbered_key(key: Column, index: int, digits: int = 4) -> Column:
    """A key with a cache's number appended."""
    return F.concat(key, F.lit(f"{index:0{digits}d}"))


def identity_and_coverage(query: Column, other: Column) -> tuple[Column, Column]:
    """Of two equally long aligned strings: matches over the query's residues, and columns where both have one over the
    query's residues. Gaps are ``-``."""
    q, t = characters(query), characters(other)
    residues = F.size(F.filter(q, lambda c: c != "-"))
    matches = F.size(F.filter(F.zip_with(q, t, lambda a, b: (a == b) & (a != "-")), lambda x: x))
    covered = F.size(F.filter(F.zip_with(q, t, lambda a, b: (a != "-") & (b != "-")), lambda x: x))
    return matches / residues, covered / residues


def without_insertions(a3m: Column) -> Column:
    """An A3M row without its insertions (lower-case letters)."""
    return F.regexp_replace(a3m, "[a-z]", "")


def deletions_before(a3m: Column) -> Column:
    """For each kept column of an A3M row, the number of insertions right before it."""
    return F.transform(F.regexp_extract_all(a3m, F.lit("([a-z]*)[^a-z]"), F.lit(1)), lambda run: F.length(run))


def cigar_steps(cigar: Column) -> Column:
    """A CIGAR string as an array of structs (n, op)."""
    runs = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHPX=])"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.regexp_extract(r, "[0-9]+", 0).cast("int").alias("n"), F.substring(r, -1, 1).alias("op")))


def cigar_positions(cigar: Column, query_start: Column, target_start: Column) -> Column:
    """Aligned positions (q, t) of a CIGAR string; -1 where one side has a gap."""
    start = F.struct(query_start.cast("int").alias("q"), target_start.cast("int").alias("t"), F.array().cast("array<struct<q:int,t:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        both, only_q = s["op"].isin("M", "=", "X"), s["op"].isin("I", "S")
        at = F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.struct(F.when(both | only_q, acc["q"] + i).otherwise(-1).cast("int").alias("q"), F.when(both | ~only_q, acc["t"] + i).otherwise(-1).cast("int").alias("t")))
        return F.struct(
            (acc["q"] + F.when(both | only_q, s["n"]).otherwise(0)).cast("int").alias("q"),
            (acc["t"] + F.when(both | ~only_q, s["n"]).otherwise(0)).cast("int").alias("t"),
            F.concat(acc["out"], F.when(s["n"] > 0, at).otherwise(F.array().cast("array<struct<q:int,t:int>>"))).alias("out"),
        )

    return F.aggregate(cigar_steps(cigar), start, step, lambda acc: acc["out"])


def group_digest(members: Column) -> Column:
    """Digest of a list of strings that is the same for every order of them."""
    return F.sha2(F.array_join(F.array_sort(members), ""), 256)


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def nearest_bin(value: Column, bins: list[float]) -> Column:
    """Index of the nearest bin; of equal ones the first."""
    distances = F.array(*(F.abs(value - F.lit(float(b))) for b in bins))
    return F.array_position(distances, F.array_min(distances)) - 1


def deletion_value(deletions: Column, factor: float = 8.0) -> Column:
    """Deletions squashed by an arc tangent; the factor is over pi."""
    return F.atan(deletions / 3.0) * factor / F.pi()
