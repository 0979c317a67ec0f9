"""Removal of repeated passages with phrase automata.

A window is ``width`` consecutive words of one text; a word goes if a window over it starts somewhere else, too.

1. Anchors: each window is known by the smallest hash among its 8-word grams (the leftmost, if equal), so equal windows
   have equal anchors. A text has about one anchor per 12 words, and the stretch of text around it holds exactly its
   windows. Anchors that occur once are dropped.
2. Confirmation: each distinct stretch of a recurring anchor is read once, in one of the texts that hold it, and its
   windows are counted over all its copies and all other stretches; those that start twice or more are confirmed.
   Confirmed windows of a stretch that touch or overlap are one phrase.
3. Automata: texts are dealt into shards of about ``SHARD_CHARS`` characters. A shard's automata are compiled from the
   distinct phrases of the stretches that its texts hold, each phrase once however many texts hold it and wherever it was
   confirmed; a window lies in the stretch of its anchor, so no other phrase can occur in the shard. Letters of the
   automata are words, numbered by the shard's own phrases.
4. Removal: every text streams through all automata of its shard (there are none for a text without a recurring anchor,
   which is not shuffled); the words that no hit covers are kept. Places found in steps 1 and 2 are not used: what goes
   is decided by the hits, word by word.

Windows count as equal by 128 bits (anchor and window). Defined results: null and empty texts have no words; texts
shorter than the window keep all; very long texts are read whole, one at a time; repeated rows are occurrences of their
own and lose the same words; rows that share an id each get a row; null ids are kept; an empty table gives an empty
result; extra columns are ignored; an id column named like an output column is given with ``_id`` appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _words
from quarry.llm._session import BROADCAST_ROWS, cut, join_counted, join_ids, map_arrow, own_name, remove, slices, stored

GRAM = 8
#: Characters of the texts of one shard, about, and words of the phrases of one automaton, at most.
SHARD_CHARS, AUTOMATON_WORDS = 500_000, 300_000


def anchors(words: _words.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a batch: gram hash, text, and the first and last start of the windows (word numbers in the batch)."""
    grams = words.windows(GRAM)
    n = len(words.hash) - width + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    # the leftmost smallest gram of each window, by doubling
    best, reach = np.arange(len(grams)), 1
    span = width - GRAM + 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        reach += step
    best = best[:n]
    text = np.searchsorted(words.bounds, np.arange(n), side="right") - 1
    inside = np.flatnonzero(np.arange(n) + width <= words.bounds[text + 1])
    if not len(inside):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    at, of = best[inside], text[inside]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]))))
    last = np.concatenate((new[1:], [len(inside)])) - 1
    return grams[at[new]], of[new], inside[new], inside[last]


def _anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """(shard, key, anchor, stretch, first, last) of each anchor of each row: the hash of its stretch, and its windows'
    starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keys, shards = batch.column(2).to_pylist(), batch.column(1), batch.column(0)
            for lo, hi in _words.batches(texts):
                words = _words.Words(texts[lo:hi])
                hashes, of, first, last = anchors(words, width)
                if len(of):
                    stretch, begin, at = words.ranges(first, last + width), words.bounds[of], pa.array(of + lo)
                    yield pa.RecordBatch.from_arrays(
                        [shards.take(at), keys.take(at), *(pa.array(x.view(np.int64)) for x in (hashes, stretch)), *(pa.array((x - begin).astype(np.int32)) for x in (first, last))],
                        names=["shard", "key", "anchor", "stretch", "first", "last"],
                    )

    return map_arrow(docs.select("shard", "key", "text"), run, "shard int, key long, anchor long, stretch long, first int, last int")


_STRETCHES = "array<struct<anchor:long,stretch:long,copies:long,first:int,windows:array<long>,size:int>>"


def _passages(docs: DataFrame, width: int) -> DataFrame:
    """(key, begin, words, stretches) of documents (key, text, listed): their listed stretches, with those that overlap
    as one passage, from its first word on; the windows of the stretches that ask for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            keys, texts, listed = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for lo, hi in _words.batches(texts):
                words = _words.Words(texts[lo:hi])
                hashes = words.windows(width).view(np.int64)
                at, begins, joined, held = [], [], [], []
                for i in range(lo, hi):
                    of, plain = words.bounds[i - lo], split(texts[i])
                    reach, run_of = -1, []
                    for s in [*sorted(listed[i].as_py(), key=lambda s: s["first"]), None]:
                        if run_of and (s is None or s["first"] > reach):
                            at.append(i)
                            begins.append(run_of[0]["first"])
                            joined.append(" ".join(plain[run_of[0]["first"] : reach]))
                            held.append(run_of)
                            run_of = []
                        if s is not None:
                            windows = hashes[of + s["first"] : of + s["last"] + 1].tolist() if s["counted"] else []
                            run_of.append({"anchor": s["anchor"], "stretch": s["stretch"], "copies": s["copies"], "first": s["first"], "windows": windows, "size": s["last"] - s["first"] + width})
                            reach = max(reach, s["last"] + width)
                if at:
                    kinds = (pa.int32(), pa.string(), batch_type)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, kind) for c, kind in zip((begins, joined, held), kinds, strict=True))], names=["key", "begin", "words", "stretches"])

    member = pa.struct([("anchor", pa.int64()), ("stretch", pa.int64()), ("copies", pa.int64()), ("first", pa.int32()), ("windows", pa.list_(pa.int64())), ("size", pa.int32())])
    batch_type = pa.list_(member)
    return map_arrow(docs.select("key", "text", "listed"), run, f"key long, begin int, words string, stretches {_STRETCHES}")


def confirmed_phrases(rows: DataFrame, width: int, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(shard, words, spans): for each shard of rows (shard, key, text), the passages with stretches that it holds, and
    where in them the confirmed phrases are, as ranges of words. With it the keys of rows with a recurring anchor."""
    found = stored(_anchor_rows(rows, width), "anchors", paths)
    recurring = cut(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    anchors_kept, total = recurring.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    again = found.join(F.broadcast(recurring), "anchor") if anchors_kept <= BROADCAST_ROWS else join_counted(found, recurring, "anchor", "n", total)
    keys = cut(again.select("key").distinct())
    places = again.groupBy("anchor", "stretch", "shard").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last")).alias("one"))
    places = stored(places, "places", paths)
    distinct = stored(places.groupBy("anchor", "stretch").agg(F.sum("n").alias("copies"), F.count("*").alias("shards"), F.min("one").alias("one")), "stretches", paths)
    # windows are counted where an anchor has several stretches, one of them without copies
    several = cut(distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.min("copies").alias("least")).where("n > 1 AND least = 1").select("anchor", "n"))
    mixed = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several.hint("merge")
    listed = distinct.join(mixed, "anchor", "left").select("anchor", "stretch", "copies", "one", F.col("n").isNotNull().alias("counted")).where("counted OR copies > 1")
    listed = cut(listed.groupBy("one.key").agg(F.collect_list(F.struct("anchor", "stretch", "copies", "one.first", "one.last", "counted")).alias("listed")))
    texts = join_ids(rows.select("key", "text"), listed.select("key"), "key", listed.count(), "left_semi")
    texts = texts.hint("merge").join(listed, "key").dropDuplicates(["key"])  # repeated rows
    passages = stored(_passages(texts, width), "passages", paths)
    stretches = passages.select("key", "begin", F.explode("stretches").alias("s")).select("key", "begin", "s.*")
    windows = stretches.select("anchor", "stretch", "copies", F.posexplode("windows").alias("at", "window"))
    repeated = windows.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "window")
    starts = windows.where("copies = 1").select("anchor", "stretch", "at", "window").hint("merge").join(repeated, ["anchor", "window"])
    starts = starts.groupBy("anchor", "stretch").agg(F.array_sort(F.collect_list("at")).alias("starts"))
    # a stretch with copies is a phrase as a whole, else each run of its confirmed windows
    begins = F.expr(f"filter(starts, (x, i) -> i = 0 OR starts[i - 1] < x - {width})")
    ends = F.expr(f"filter(starts, (x, i) -> i + 1 = size(starts) OR starts[i + 1] > x + {width})")
    span = lambda a, b: F.struct(a.cast("int").alias("begin"), b.cast("int").alias("end"))
    at = F.col("first") - F.col("begin")
    spans = F.when(F.col("copies") > 1, F.array(span(at, at + F.col("size")))).otherwise(F.zip_with(begins, ends, lambda a, b: span(at + a, at + b + width)))
    confirmed = stretches.drop("windows").hint("merge").join(starts, ["anchor", "stretch"], "left").where("copies > 1 OR starts IS NOT NULL")
    confirmed = stored(confirmed.select("anchor", "stretch", "key", "begin", spans.alias("spans")), "confirmed", paths)
    of = confirmed.select("anchor", "stretch", "key", "begin").hint("merge").join(distinct.select("anchor", "stretch", "shards"), ["anchor", "stretch"])
    wanted = stored(join_counted(places.select("anchor", "stretch", "shard"), of, ["anchor", "stretch"], "shards", places.count()).select("shard", "key", "begin").distinct(), "wanted", paths)
    shards = wanted.groupBy("key", "begin").agg(F.count("*").alias("shards"))
    known = confirmed.groupBy("key", "begin").agg(F.flatten(F.collect_list("spans")).alias("spans")).join(shards, ["key", "begin"])
    done = [p for p in paths if "-wanted-" not in p]
    known = stored(passages.select("key", "begin", "words").hint("merge").join(known, ["key", "begin"]), "phrases", paths)
    remove(rows.sparkSession, done)  # what follows reads the last two tables
    return join_counted(wanted, known, ["key", "begin"], "shards", wanted.count()).select("shard", "words", "spans"), keys


class Phrases:
    """Automata over distinct phrases (words between single spaces), of at most AUTOMATON_WORDS words each."""

    def __init__(self, phrases: set[str]):
        self.number: dict[str, int] = {}
        self.automata: list[ahocorasick.Automaton] = []
        held = AUTOMATON_WORDS
        for phrase in phrases:
            words = phrase.split(" ")
            if held + len(words) > AUTOMATON_WORDS:
                self.automata.append(ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE))
                held = 0
            held += len(words)
            self.automata[-1].add_word(tuple(self.number.setdefault(w, len(self.number) + 1) for w in words))
        for automaton in self.automata:
            automaton.make_automaton()

    def locate(self, words: list[str]) -> list[tuple[int, int]]:
        """Disjoint ascending word ranges that phrases cover."""
        letters = tuple(map(self.number.get, words, [0] * len(words))) if self.automata else ()
        hits = sorted((end - length + 1, end + 1) for automaton in self.automata for end, length in automaton.iter(letters)) if any(letters) else []
        out: list[tuple[int, int]] = []
        for a, b in hits:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text) of every row."""
    kind, out_id = docs.schema[id_col].dataType.simpleString(), own_name(id_col, ("n_words", "n_removed", "kept_text"))
    paths: list[str] = []
    chars = docs.agg(F.coalesce(F.sum(F.length(F.col(text_col))), F.lit(0))).first()[0]
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 + chars // SHARD_CHARS)).cast("int").alias("shard"), key.alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    phrases, keys = confirmed_phrases(rows, width, paths)
    phrases = phrases.select("shard", F.lit(None).cast(kind).alias("id"), F.col("words").alias("text"), "spans")
    n, plain = keys.count(), F.lit(None).cast(phrases.schema["spans"].dataType).alias("spans")
    both = phrases.union(join_ids(rows, keys, "key", n, "left_semi").select("shard", "id", "text", plain))
    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("spans").isNull())  # phrases first
    # a text without a recurring anchor has no phrase to look for, so it stays where it is
    dealt = dealt.union(join_ids(rows, keys, "key", n, "left_anti").select("shard", "id", "text", plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, listed, automata = None, set(), None
        for batch in slices(batches):
            at, total, gone, kept = [], [], [], []
            for i, (shard, _, text, found) in enumerate(zip(*batch.columns, strict=True)):
                shard = shard.as_py()
                if shard != current:
                    current, listed, automata = shard, set(), None
                if found.is_valid:
                    passage = text.as_py().split(" ")
                    listed.update(" ".join(passage[x["begin"] : x["end"]]) for x in found.as_py())
                    continue
                if automata is None:
                    automata = Phrases(listed)
                words = split(text.as_py())
                left, reach = [], 0
                for begin, end in automata.locate(words):
                    left += words[reach:begin]
                    reach = end
                left += words[reach:]
                at.append(i)
                total.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(" ".join(left))
            ids = batch.column(1).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[out_id, "n_words", "n_removed", "kept_text"])

    return map_arrow(dealt, run, f"`{out_id}` {kind}, n_words long, n_removed long, kept_text string")


_SEPARATORS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def split(text: str | None) -> list[str]:
    """Words: runs of characters other than space and U+0009 to U+000D."""
    return [w for w in (text or "").translate(_SEPARATORS).split(" ") if w]
