"""Fill-in-the-middle against a plain version over regular expressions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm.fill_middle import Marks, fill_in_middle, restored

SCHEMA = "doc_id long, text string, form string, output string, n int, h1 string"
UNIT = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[ \t-\r]+|[^ \t-\r]+", "chars": r"(?s)."}
TEXTS = [None, "", "\n", "a", "one line\n", "x\ny", "\n\n\nend", "é漢😀\n line two \r\n\nthree\n", "with <P> inside\nmore", "<S>", "almost <S\n>M><M\n<", "w " * 5000, "\n".join(map(str, range(3000)))]


def plain(doc_id, text, units, percent, spm, seed):
    text = text or ""
    parts = re.findall(UNIT[units], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:low], parts[low:high], parts[high:]))
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", UNIT)
@pytest.mark.parametrize(("percent", "spm", "seed"), [(100, 50, 7), (60, 0, 1), (100, 100, 2)])
def test_against_plain(spark, units, percent, spm, seed):
    rows = [(i, t, "f", "o", 1, "h") for i, t in enumerate(TEXTS * 3)]
    rows += [rows[4], rows[4], (None, "a\nb\nc", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = fill_in_middle(docs, units, percent, spm, seed)
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((r[0], *plain(r[0], r[1], units, percent, spm, seed), r[1] or "") for r in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want


def test_empty_table_clashing_names_and_marks(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    named = spark.createDataFrame([("i", "a\nb")], "n string, output string")
    assert fill_in_middle(named, id_col="n", text_col="output").columns == ["n_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    other = Marks("[pre]", "[suf]", "[mid]")
    row = fill_in_middle(named, marks=other, units="chars", id_col="n", text_col="output").withColumn("back", restored(F.col("output"), F.col("form"), other)).first()
    assert row.back == "a\nb" and row.output.startswith(("[pre]", "[suf]"))
    for bad in (("", "b", "c"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "x"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            Marks(*bad)
