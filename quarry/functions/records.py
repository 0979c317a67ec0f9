"""Column functions over names, dates, aligned strings and lookups of structure records."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_integer_like(text: Column) -> Column:
    """Whether a string is an integer, with or without a sign; null is not."""
    return F.coalesce(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.lit(False))


def with_unknown(key: Column, table: Mapping[str, object], unknown: object) -> Column:
    """A small table's value, or that of the unknown; keys that are null are unknown."""
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key), F.lit(unknown))


def letter_indices(aligned: Column, letters: str, unknown: str, gap: str = "-") -> Column:
    """Index of each letter in ``letters``; others are the unknown's, gaps one past the end."""
    at = lambda c: F.when(c == gap, F.lit(len(letters))).when(F.instr(F.lit(letters), c) > 0, F.instr(F.lit(letters), c) - 1).otherwise(letters.index(unknown))
    return F.transform(F.filter(F.split(aligned, ""), lambda c: c != ""), at)


def residue_numbers(aligned: Column, start: Column) -> Column:
    """Residue numbers of an aligned string from ``start`` on: -1 at gaps; lower-case letters are counted, not given."""
    letters = F.filter(F.split(aligned, ""), lambda c: c != "")
    empty = F.struct(start.cast("int").alias("next"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        gap, insertion = c.isin("-", "."), c.rlike("^[a-z]$")
        out = F.when(insertion, acc["out"]).when(gap, F.concat(acc["out"], F.array(F.lit(-1)))).otherwise(F.concat(acc["out"], F.array(acc["next"])))
        return F.struct(F.when(gap, acc["next"]).otherwise(acc["next"] + 1).alias("next"), out.alias("out"))

    return F.aggregate(letters, empty, step, lambda acc: acc["out"])


def insertions_lowered(query: Column, hit: Column) -> Column:
    """A hit's aligned string as A3M: letters where the query has a gap in lower case, gaps there left out."""
    pairs = F.arrays_zip(F.split(query, "").alias("q"), F.split(hit, "").alias("h"))
    letter = lambda p: F.when(~p["q"].isin("-", "."), p["h"]).when(p["h"].isin("-", "."), F.lit("")).otherwise(F.lower(p["h"]))
    return F.array_join(F.transform(pairs, letter), "")


def first_number(*texts: Column) -> Column:
    """The first of several texts that is a number; "?", "." and null are none; NaN if there is none."""
    return F.coalesce(*(F.expr("double(NULL)") if t is None else F.when(~t.isin("?", "."), t).try_cast("double") for t in texts), F.lit(float("nan")))


def contacts(text: Column) -> Column:
    """The contacts of a string such as ``A.12-B.7;A.13-B.9``, as an array of (chain_1, res_1, chain_2, res_2)."""
    end = lambda part, i: F.split(F.split(part, "-")[i], r"\.")
    one = lambda p: F.struct(end(p, 0)[0].alias("chain_1"), end(p, 0)[1].cast("int").alias("res_1"), end(p, 1)[0].alias("chain_2"), end(p, 1)[1].cast("int").alias("res_2"))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: p.contains("-")), one)


def relative_accessibility(area: Column, most: Column, default: float = 113.0) -> Column:
    """Accessible area by the largest of its residue, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), area / F.coalesce(most, F.lit(default))))


def fails_legacy_sequence_check(query_length: Column, hit_length: Column, aligned: Column, max_share: float = 0.95, min_aligned: float = 0.1, min_length: int = 10) -> Column:
    """A template too much like a part of the query, aligned too little, or too short."""
    return (hit_length / query_length > max_share) | (aligned / query_length < min_aligned) | (hit_length < min_length)


def released_before(date: Column, limit: Column, strict: bool = True) -> Column:
    """Whether a date is before the limit; by the older rule, strict, or on it as well, by the newer one."""
    return date < limit if strict else date <= limit
