"""Line-first cleaning, with DataFrame functions only.

Rules judge each line first: punctuation (a longer line without any sentence mark), navigation (words set off by many
separators), and boilerplate (every tenth character a symbol, or capitals throughout). Failing lines go; then a
document goes if its kept lines hold less than half of the characters of its words, if it lacks words, or if repeated
three-word windows cover more than half of them.

Sentence marks are those of all scripts; Thai and Lao, which write none, are spared that rule. Windows count as equal by
64 bits, compared within one text only.

Defined results: null and empty texts have zero counts, fail the base rule and are not kept; very long texts are judged
whole; repeated rows are judged alike; rows that share an id are judged each by its text; null ids are kept; texts
without line breaks are one line; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._session import cut, fresh

GAP = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
#: Marks that end or close a sentence: the ASCII ones, and other punctuation and closing marks of all scripts but bullets
#: and reference signs. Scripts without such marks pass as well.
MARKS = r"""[.!?;:"')\]]|[[\p{Po}\p{Pe}\p{Pf}]&&[^\x00-\x7F•·§¶†‡]]|[\p{IsThai}\p{IsLao}]"""
#: Of a document's word characters, the share that must be left after its failing lines are gone.
KEEP_SHARE = 0.5


def _without(text: Column, characters: str) -> Column:
    """A text without some characters, by plain searches (cheaper than a regular expression)."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_without(text, characters))


def words_of(text: Column) -> Column:
    """Words of a text: runs of characters other than space and U+0009 to U+000D."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def described(line: Column) -> Column:
    """A line with its length, and its length without spaces, which are so counted once; ``odd``: whether its words are
    more or fewer than its spaces and one."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    return F.struct(line.alias("text"), F.length(line).alias("length"), F.length(F.replace(line, F.lit(" "), F.lit(""))).alias("size"), odd.alias("odd"))


def line_fails(line: Column, symbols: Column) -> Column:
    """Whether a described line is unpunctuated, navigation or boilerplate; ``symbols``: whether its text has any."""
    text, size = line["text"], line["size"]
    n = F.when(line["odd"], F.size(words_of(text))).otherwise(line["length"] - size + 1)
    start = F.substring(text, 2, 2)
    unpunctuated = (n >= 10) & ~text.rlike(MARKS)
    navigation = (n >= 3) & (_count(text, "|»›•") * 4 >= n)
    shouted = (n >= 4) & (size >= 20) & (start == F.upper(start)) & (text == F.upper(text)) & (text != F.lower(text))
    return (size > 0) & (unpunctuated | navigation | shouted | (symbols & (_count(text, SYMBOLS) * 10 >= size)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, and the characters that the failing lines hold.

    Three-word windows are hashed once; a text whose hashes are all different has no repeats. Else the hashes that
    occur twice are the equal neighbours of the sorted array, and the words under them are counted as a union of
    ranges: at most three for each window, less where the next one overlaps."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select(id_col, "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"))
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.select(
        id_col,
        F.size("w").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), " \n\t\r\x0b\x0c")).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", described).alias("lines"),
        F.when(F.size("w") >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    rows = rows.select("*", (F.size(F.array_distinct("g")) < F.size("g")).alias("repeats"))
    rows = rows.select("*", F.when(F.col("repeats"), F.sort_array("g")).alias("sorted"))
    twice = F.array_distinct(F.filter("sorted", lambda x, i: x == F.get("sorted", i + 1)))
    rows = rows.select("*", F.when(F.col("repeats"), twice).alias("twice"))
    return rows.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(F.col("repeats"), _covered(F.col("g"), F.col("twice"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.when(line_fails(x, F.col("n_symbols") > 0), x["size"]).otherwise(0)).alias("lost_chars"),
    )


def _covered(hashes: Column, twice: Column) -> Column:
    """Words under a repeated window. Few repeats are looked up in a list; many are found by sorting places by hash."""
    few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = F.zip_with(placed, F.slice(placed, 2, F.size(placed)), lambda a, b: F.struct(a["i"].alias("i"), (a["h"] == b["h"]).alias("same"), b["i"].alias("j")))
    same = F.filter(beside, lambda x: x["same"])
    many = F.array_sort(F.array_distinct(F.concat(F.transform(same, lambda x: x["i"]), F.transform(same, lambda x: x["j"]))))

    def union(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda n, x: n + x)

    return F.when(F.size(twice) <= 16, union(few)).otherwise(union(many))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdicts of every row."""
    m = measured(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.col("lost_chars") > (1 - KEEP_SHARE) * F.col("word_chars")
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~lost)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines (text column replaced, all other columns as given)."""
    lines = F.transform(F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), described), lambda x: ~line_fails(x, F.lit(True))), lambda x: x["text"])
    judged = judge(docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key")).distinct(), "key", "text")
    # cut, as a filter pushed below the verdict would repeat its steps inside each other for every word
    key = fresh(docs, "__key")
    verdicts = cut(judged.select(F.col("key").alias(key), "kept")).where("kept").select(key)
    kept = docs.withColumn(key, F.xxhash64(F.col(text_col))).join(verdicts, key, "left_semi").drop(key)
    return kept.withColumn(text_col, F.array_join(lines, "\n"))
