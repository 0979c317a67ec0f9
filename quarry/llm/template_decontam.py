"""Benchmark decontamination by template windows, with DataFrame functions only.

Words become templates: numbers (digits and number words), names (runs of capitalised words within a sentence) and units
(compound ones such as km per hour, too) turn into one typed placeholder each, however many words they have; all other
words are lower-cased. Windows of ``WINDOW`` template words are hashed; those of the documents are joined with those of the
benchmark. Where a window matches, the values in its slots are compared: each value of the item must stand for one
value of the document throughout, so questions with consistently replaced numbers or names are caught and chance
matches of placeholders are not. Two values of the item may become one of the document, as when both trains of a question go
to the same town. An item has leaked into a document that holds half of its windows with consistent values at one of
its places: in one alignment (position less place), in alignments less than a window apart (edits), in a run of
ascending places (longer insertions), or by the first position of each window.

Texts are read in two ways, of which one match is enough: capitals that begin a sentence as plain words or as names.

An item shorter than a window is one window as a whole. A window counts if half of its words at least (``LITERAL`` of
``WINDOW``) are no placeholders; an item without such a window, such as one made of numbers, is looked for by its exact
words. Items of fewer than ``LEAST`` words are not looked for: documents hold those by chance. Matches of window hashes are
confirmed word by word.

Defined results: null and empty texts hold no window; very long texts are read whole; equal shares take the fewest
changed slots; repeated rows are judged alike, and rows that share an id are told apart by content; an empty table or
benchmark gives no leaks; extra columns are ignored, or kept by ``decontaminate``, which keeps rows without an id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm._session import BROADCAST_ROWS, cut, join_ids

#: Words in a window, the words of it that must not be placeholders, the share of windows, and the words of an item at
#: least.
WINDOW, LITERAL, SHARE, LEAST = 8, 4, 0.5, 3
#: Units of measure that count as one type, those that are so after "per" alone, and number words.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "min", "h", "kmh", "mph", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "usd", "eur", "gbp", "percent", "euro", "euros", "dollar", "dollars",
    "meter", "meters", "metre", "metres", "kilometers", "kilometres", "mile", "miles", "hour", "hours", "minute", "minutes", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "gram", "grams", "liter", "liters", "litre", "litres",
)
PER_UNITS = (*UNITS, "second")
NUMBERS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion",
)
#: Ways to read a text: capitals that begin a sentence as words or as names, and words as they are.
PLAIN, NAMED, EXACT = 0, 1, 2
_START, _POINT, _JOIN = "\u0002", "\u0003", "\u0004"
#: Between the digits of one number: separators of thousands, then of decimals.
_THOUSANDS = r"(?<=(?<!\d)\d{1,3}|[,.'\u2019_ \u00a0\u202f]\d{3})[,'\u2019_ \u00a0\u202f](?=\d{3}(?!\d))"
_DECIMAL = r"(?<=\d)[.,](?=\d)"
_SEPARATED = r"\d[,.'\u2019_ \u00a0\u202f]\d"
_NUMBER, _UNIT, _PER = ("|".join(sorted(x, key=lambda w: (-len(w), w))) for x in (NUMBERS, UNITS, PER_UNITS))
_CAPITAL = r"\p{Lu}[\p{L}\p{N}]*"
#: Steps by which what is one placeholder becomes one word: what a text must hold for it, what is replaced, by what. Patterns
#: begin with what is rare, as a number word or a unit would be looked for at each word.
_STEPS = (
    (lambda t: t.rlike(_SEPARATED), _THOUSANDS, ""),
    (lambda t: t.rlike(_SEPARATED), _DECIMAL, _POINT),
    (lambda t: t.rlike(r"\d\p{L}"), rf"(?<=\d)(?=(?:{_UNIT})(?![\p{{L}}\p{{N}}]))", " "),
    (None, r"(?<=\d) (?=\d)", _JOIN),
    (lambda t: reduce(Column.__or__, (F.contains(t, F.lit(x)) for x in ("ty ", "ty-", "hundred", "thousand", "illion"))), rf"(?<![\p{{L}}\p{{N}}])({_NUMBER})[ -](?:and (?<=hundred and |thousand and ))?(?=(?:{_NUMBER})(?![\p{{L}}\p{{N}}]))", f"$1{_JOIN}"),
    (lambda t: F.contains(t, F.lit(" per ")) | F.contains(t, F.lit("/")), rf"(?: per |/)(?<=(?<!\p{{L}})(?:{_UNIT})(?: per |/))(?=(?:{_PER})(?![\p{{L}}\p{{N}}]))", f"{_JOIN}per{_JOIN}"),
    (None, r"(^|[.!?:;\n][^\p{L}\p{N}]*)(?=\p{Lu})", f"$1 {_START}"),
)


def joined(text: Column) -> Column:
    """A text in which numbers with separators or decimals, runs of numbers and of number words, and units per another are one
    word each, and the first word of a sentence is marked, so that its capital is not taken for a name."""

    def step(holds: Callable[[Column], Column] | None, replaced: str, by: str) -> Callable[[Column], Column]:
        return lambda t: F.regexp_replace(t, replaced, by) if holds is None else F.when(holds(t), F.regexp_replace(t, replaced, by)).otherwise(t)

    text = F.coalesce(text, F.lit(""))
    for s in _STEPS:
        text = F.get(F.transform(F.array(text), step(*s)), F.lit(0))  # so that a step that names its text twice computes it once
    return text


def words_of(text: Column, way: int = PLAIN, ready: bool = False) -> Column:
    """Words (letters and digits), with runs of capitalised words as one; ``ready``: the text is ``joined`` already. EXACT: words
    as they are, in lower case."""
    if way == EXACT:
        return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    before = rf"(?<![\p{{L}}\p{{N}}{_START if way == PLAIN else ''}])"
    runs = F.regexp_replace(text if ready else joined(text), rf"{before}({_CAPITAL})[ '\u2019-](?=\p{{Lu}})", f"$1{_JOIN}")
    return F.filter(F.split(runs, rf"[^\p{{L}}\p{{N}}{_START}{_POINT}{_JOIN}]+"), lambda w: w != "")


def template(word: Column, names: bool = False) -> Column:
    """A word or its placeholder; words that begin with a to z, nearly all, take few comparisons. With ``names``, words
    that begin a sentence with a capital are names."""
    first = F.substring(word, 1, 1)

    def small(w: Column) -> Column:
        joined = F.when(F.substring_index(w, _JOIN, 1).isin(*UNITS), F.lit("<unit>")).otherwise(F.lit("<num>"))
        return F.when(w.isin(*UNITS), F.lit("<unit>")).when(w.isin(*NUMBERS), F.lit("<num>")).when(F.contains(w, F.lit(_JOIN)), joined).otherwise(w)

    return (
        F.when((word >= "a") & (word < "{"), small(word))
        .when((first >= "0") & (first <= "9"), F.lit("<num>"))
        .when(first == _START, F.lit("<name>") if names else small(F.lower(F.substring(word, 2, 1_000_000))))
        .when(first != F.lower(first), F.lit("<name>"))
        .otherwise(word)
    )


def _placeholder(word: Column) -> Column:
    return word.isin("<num>", "<unit>", "<name>")


def _template(way: int) -> Callable[[Column], Column]:
    return (lambda w: w) if way == EXACT else (lambda w: template(w, way == NAMED))


def _hash(way: int) -> Callable[[Column], Column]:
    return lambda w: F.xxhash64(_template(way)(w))


def _hashes(hashed: str, size: int = WINDOW, exact: bool = False) -> Column:
    """The hash of ``size`` words from each word on; of other sizes or kinds, other hashes."""
    tag = [] if size == WINDOW and not exact else [F.lit(-size if exact else size)]
    window = F.transform(F.sequence(F.lit(0), F.size(hashed) - size), lambda i: F.xxhash64(*tag, *(F.get(hashed, i + k) for k in range(size))))
    return F.when(F.size(hashed) >= size, window)


def with_windows(rows: DataFrame, text: Column, kinds: list[tuple[int, bool]] = [(WINDOW, False)]) -> DataFrame:  # noqa: B006
    """Adds ``readings``: structs (way, size, windows) with the hash of the template window from each word on, for each way
    to read the text and each kind (size, exact) of window that the items have; those with capitals as names are null
    where they are the same as without. To be exploded as outer rows: for inner ones the optimizer would first ask for the
    array's size, in a filter that computes all hashes for each window.

    Word hashes are columns of their own, which the windows name WINDOW times, so they are computed once a text."""
    ways = [w for w in (PLAIN, NAMED, EXACT) if any(exact == (w == EXACT) for _, exact in kinds)]
    if PLAIN in ways:
        rows = rows.withColumn("__joined", joined(text))
    for way in ways:
        rows = rows.withColumn(f"__w{way}", words_of(text, way) if way == EXACT else words_of(F.col("__joined"), way, True))
    for way in ways:
        rows = rows.withColumn(f"__h{way}", F.transform(f"__w{way}", _hash(way)))
    readings = []
    for size, exact in kinds:
        for way in [EXACT] if exact else [PLAIN, NAMED]:
            rows = rows.withColumn(f"__v{size}{way}", _hashes(f"__h{way}", size, exact))
        for way in [EXACT] if exact else [PLAIN, NAMED]:
            v = F.col(f"__v{size}{way}")
            if way == NAMED:
                plain = f"__v{size}{PLAIN}"
                v = F.when(F.size(plain) == F.size(v), F.zip_with(plain, v, lambda a, b: F.when(a != b, b))).otherwise(v)
            readings.append(F.struct(F.lit(way).alias("way"), F.lit(size).alias("size"), v.alias("windows")))
    return rows.withColumn("readings", F.array(*readings)).drop(*(c for c in rows.columns if c.startswith("__")))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, reading, item_windows, size, exact, place, hash, item_raw, slot) of the benchmark's windows with enough
    literal words; a reading is one text of an item, read in one way."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates()
    rows = rows.where(F.size(words_of(F.col("text"), EXACT)) >= LEAST)

    def read(rows: DataFrame, way: int) -> DataFrame:
        own = rows.select("item", "text", F.xxhash64(F.col("text"), F.lit(way)).alias("reading"), words_of(F.col("text"), way).alias("raw"))
        own = own.withColumn("t", F.transform("raw", _template(way)))
        return own.withColumn("__h", F.transform("t", lambda w: F.xxhash64(w)))

    columns = ["item", "text", "reading", "size", "exact", "place", "hash", "item_raw", "slot"]

    def windows(rows: DataFrame, size: int, exact: bool) -> DataFrame:
        rows = rows.where(F.size("raw") >= size if size == WINDOW else F.size("raw") == size).withColumn("windows", _hashes("__h", size, exact))
        rows = rows.select("item", "text", "reading", "raw", "t", F.posexplode_outer("windows").alias("place", "hash"))
        t = F.slice("t", F.col("place") + 1, size)
        if not exact:
            rows = rows.where(F.size(F.filter(t, lambda w: ~_placeholder(w))) >= min(LITERAL, -(-size // 2)))
        slot = F.transform(t, lambda w: F.lit(False) if exact else _placeholder(w)).alias("slot")
        return rows.select("item", "text", "reading", F.lit(size).alias("size"), F.lit(exact).alias("exact"), "place", "hash", _values(F.slice("raw", F.col("place") + 1, size)).alias("item_raw"), slot).select(*columns)

    sizes = range(LEAST, WINDOW + 1)
    templated = cut(read(rows, PLAIN).union(read(rows, NAMED)))
    found = cut(reduce(DataFrame.union, (windows(templated, size, False) for size in sizes)))
    # an item without a template window, by its words as they are
    bare = cut(read(rows.join(F.broadcast(found.select("item", "text").distinct()), ["item", "text"], "left_anti"), EXACT))
    if bare.limit(1).count():
        found = found.union(reduce(DataFrame.union, (windows(bare, size, True) for size in sizes)))
    return found.drop("text").join(found.groupBy("item", "reading").agg(F.count("*").alias("item_windows")), ["item", "reading"])


def _values(raw: Column) -> Column:
    """Words without their marks."""
    return F.transform(raw, lambda w: F.translate(F.translate(w, _START, ""), _JOIN + _POINT, " ."))


def _places(pairs: DataFrame) -> DataFrame:
    """Adds ``place_of``: the places of the document to which a match of (key, way, item, reading, place, at) belongs.
    Each is (kind, number): one alignment, alignments less than a window apart, ascending places, first positions."""
    group = ["key", "way", "item", "reading"]
    near, run = W.partitionBy(*group).orderBy("shift"), W.partitionBy(*group).orderBy("at", "place")
    pairs = pairs.withColumn("shift", F.col("at") - F.col("place"))
    pairs = pairs.withColumn("__near", F.when(F.col("shift") - F.lag("shift").over(near) >= WINDOW, 1).otherwise(0)).withColumn("__run", F.when(F.col("place") <= F.lag("place").over(run), 1).otherwise(0))
    pairs = pairs.withColumn("__near", F.sum("__near").over(near)).withColumn("__run", F.sum("__run").over(run)).withColumn("__first", F.min("at").over(W.partitionBy(*group, "hash")))
    place = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    found = F.array(place(0, F.col("shift")), place(1, F.col("__near")), place(2, F.col("__run")), F.when(F.col("at") == F.col("__first"), place(3, F.lit(0))))
    return pairs.withColumn("place_of", F.filter(found, lambda x: x.isNotNull())).drop("shift", "__near", "__run", "__first")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, item_windows, changed): items that leaked, and in how many slots values differ, at the
    place that holds the largest share of windows."""
    items = cut(_items(benchmark, item_col, item_text))
    small = items.count() <= BROADCAST_ROWS
    kinds = [(r["size"], r["exact"]) for r in items.select("size", "exact").distinct().collect()] or [(WINDOW, False)]  # 2 * WINDOW at most
    one = [F.col(id_col), F.col(text_col)]
    key = F.struct(F.xxhash64(*one).alias("a"), F.xxhash64(F.lit(1), *one).alias("b"))  # of 128 bits, as it says which text is judged
    keyed = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), key.alias("key"))
    readings = with_windows(keyed, F.col("text"), sorted(kinds)).select("key", F.explode_outer("readings").alias("r"))
    exploded = readings.select("key", "r.way", "r.size", F.posexplode_outer("r.windows").alias("at", "hash"))
    wanted = items.select("hash").distinct()
    hits = exploded.join(F.broadcast(wanted) if small else wanted, "hash")
    found = cut(hits.distinct())
    # candidate pairs with enough windows; then the words in their slots
    group = ["key", "way", "item", "reading"]
    pairs = found.join(items.select("item", "reading", "item_windows", "place", "hash"), "hash")
    enough = pairs.groupBy(*group, "item_windows").agg(F.countDistinct("place").alias("n")).where(F.col("n") >= SHARE * F.col("item_windows"))
    chosen = cut(enough.select(*group, "item_windows"))
    held = found.join(chosen.select("key", "way", "item", "reading"), ["key", "way"]).join(items.select("item", "reading", "hash").distinct(), ["item", "reading", "hash"])
    held = cut(held.select("key", "way", "size", "hash", "at").distinct().groupBy("key").agg(F.collect_list(F.struct("way", "size", "hash", "at")).alias("held")))
    texts = join_ids(keyed, held.select("key"), "key", held.count(), "left_semi").hint("merge").join(held, "key").dropDuplicates(["key"])
    texts = texts.select("key", "doc", "held", *(words_of(F.col("text"), way).alias(f"raw{way}") for way in (PLAIN, NAMED, EXACT)))
    raw = lambda x: F.when(x["way"] == PLAIN, F.col("raw0")).when(x["way"] == NAMED, F.col("raw1")).otherwise(F.col("raw2"))
    doc_words = lambda x: _values(F.slice(raw(x), x["at"] + 1, x["size"]))
    raws = texts.select("key", "doc", F.explode_outer(F.transform("held", lambda x: F.struct(x["way"].alias("way"), x["hash"].alias("hash"), x["at"].alias("at"), doc_words(x).alias("doc_raw")))).alias("x"))
    same = F.forall(F.arrays_zip("item_raw", "doc_raw", "slot"), lambda p: p["slot"] | (F.lower(p["item_raw"]) == F.lower(p["doc_raw"])))
    matches = _places(raws.select("key", "doc", "x.*").join(items, "hash").where(same).join(chosen.select(*group), group))
    values = F.filter(F.arrays_zip("item_raw", "doc_raw", "slot"), lambda p: p["slot"])
    slots = matches.select(*group, "doc", "item_windows", "place", F.explode("place_of").alias("place_of"), values.alias("values"))
    slots = slots.select(*group, "doc", "item_windows", "place", "place_of", F.explode_outer("values").alias("v"))
    v = F.struct("v.item_raw", "v.doc_raw")
    slots = slots.groupBy(*group, "doc", "item_windows", "place_of").agg(
        F.size(F.collect_set("place")).alias("windows"), F.size(F.collect_set(F.when(F.col("v").isNotNull(), v))).alias("pairs"), F.size(F.collect_set("v.item_raw")).alias("slots"),
        F.size(F.collect_set(F.when(F.col("v.item_raw") != F.col("v.doc_raw"), v))).alias("changed"),
    )
    kept = slots.where((F.col("pairs") == F.col("slots")) & (F.col("windows") >= SHARE * F.col("item_windows")))
    best = F.struct(-F.col("windows") / F.col("item_windows"), "changed", -F.col("item_windows"))
    kept = kept.groupBy("key", "doc", "item").agg(F.min_by(F.struct("windows", "item_windows", "changed"), best).alias("b"))
    return kept.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.windows", "b.item_windows", "b.changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents into which no item has leaked, all columns as given."""
    bad = cut(leaks(docs, benchmark, id_col, text_col).select(id_col).where(F.col(id_col).isNotNull()).distinct())
    return join_ids(docs, bad, id_col, bad.count(), "left_anti")
