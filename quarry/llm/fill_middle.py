"""Fill-in-the-middle: texts cut at two unit boundaries and put in another order, with marks between the pieces.

A text is decoded to an array of UTF-32 code points. Each code point has a class, and where the classes of neighbours
ask for it there is a boundary (``flatnonzero``); two boundaries are chosen by rank and the three pieces between them are
sliced and encoded again. The choice depends on the id and the seed alone, so a lost task makes the same cuts again, and
nothing is shuffled.

Defined results: a null or empty text, and one that contains a mark, stays as it is (form ``plain``); very long texts are
cut whole, one at a time; repeated rows and rows that share an id get the same cuts of their own texts; a null id counts
as no digits; an empty table gives an empty result; extra columns are ignored; an id column named like an output column
is given with ``_id`` appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._session import map_arrow, own_name, slices


@dataclass(frozen=True)
class Marks:
    """The marks before the prefix, the suffix and the middle. None may hold, or overlap with, another or itself, so a
    text without marks can be rebuilt from its pieces."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        for a in marks:
            for b in marks:
                if not a or a is not b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"marks are empty or overlap: {a!r} and {b!r}")


def _lines(points: np.ndarray) -> np.ndarray:
    return np.flatnonzero(points[:-1] == 10) + 1


def _words(points: np.ndarray) -> np.ndarray:
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    return np.flatnonzero(blank[:-1] != blank[1:]) + 1


def _chars(points: np.ndarray) -> np.ndarray:
    return np.arange(1, len(points))


#: Inner boundaries of a text by kind of unit: lines (each ends after its newline), runs of words or of blanks, code points.
UNITS = {"lines": _lines, "words": _words, "chars": _chars}


def cut_points(points: np.ndarray, units: str, first: int, second: int) -> tuple[int, int, int]:
    """The number of units, and the code points at which prefix and middle end."""
    if not len(points):
        return 0, 0, 0
    edges = np.concatenate(([0], UNITS[units](points), [len(points)]))
    n = len(edges) - 1
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, int(edges[low]), int(edges[high])


def fill_in_middle(
    docs: DataFrame, units: str = "lines", percent: int = 100, spm_percent: int = 50, seed: int = 7, marks: Marks = Marks(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n units, form, prefix_chars, middle_chars, output): ``percent`` of the texts are cut; of these, ``spm_percent``
    have the suffix first (``spm``), the others the prefix (``psm``)."""
    if units not in UNITS:
        raise ValueError(f"units must be one of {', '.join(UNITS)}")
    kind, out_id = docs.schema[id_col].dataType.simpleString(), own_name(id_col, ("n", "form", "prefix_chars", "middle_chars", "output"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    ranks = [F.conv(F.substring(digest, at, 8), 16, 10).cast("long").alias(f"h{i}") for i, at in enumerate((1, 9, 17, 25), 1)]
    every = (marks.prefix, marks.suffix, marks.middle)

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        n, low, high = cut_points(points, units, h1, h2)
        if not n or any(m in text for m in every) or h3 % 100 >= percent:
            return n, "plain", None, None, text
        prefix, middle, suffix = (points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in ((0, low), (low, high), (high, None)))
        if h4 % 100 < spm_percent:
            return n, "spm", low, high - low, f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"
        return n, "psm", low, high - low, f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in slices(batches, 64):
            chosen = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            rows = [one(text.as_py() or "", *h) for text, h in zip(batch.column(1), chosen, strict=True)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[out_id, "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = f"`{out_id}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_arrow(docs.select(F.col(id_col), F.col(text_col), *ranks), run, schema)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made from, read off the output and its form alone."""

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows the first, the second and the middle mark."""
        after = F.substring(output, F.lit(len(first) + 1), F.length(output))
        at = F.locate(second, after)
        rest = F.substring(after, at + len(second), F.length(after))
        then = F.locate(marks.middle, rest)
        return F.substring(after, F.lit(1), at - 1), F.substring(rest, F.lit(1), then - 1), F.substring(rest, then + len(marks.middle), F.length(rest))

    prefix, suffix, middle = pieces(marks.prefix, marks.suffix)
    after, before, inner = pieces(marks.suffix, marks.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, inner, after)).otherwise(output)
