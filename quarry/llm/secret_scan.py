"""Secret scans with a random forest against false positives.

Candidates are found by their form: values assigned to a key word, known prefixes, and long runs that mix character
classes. Each is described by its length, the transitions between its characters' classes, how far words cover it (those of
its own text, of a dictionary counted over the corpus, and of a list of common parts), the path it comes from and the words
beside it. A random forest trained on labelled findings then tells secrets from look-alikes (digests, identifiers,
placeholders, addresses).

Labelled findings are a table (before, candidate, after, path, label); ``labelled_findings`` makes one of
``FINDINGS`` rows from fixed rules and a seed, so that the library needs no real secrets.

Defined results: null and empty texts have no findings; a finding's span counts code points; overlapping candidates
are all judged, and those accepted give one finding, assigned and known ones first, then the longer, then the earlier;
repeated rows each get theirs; a null path is an empty one; very long texts are searched whole, in time linear in their
length but for sorting candidates; an empty table gives none, and an empty dictionary; extra columns are ignored, and kept
by ``redact`` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm._session import cut, fresh, join_ids, map_arrow, slices

#: Labelled findings in the training table, and the forest's size.
FINDINGS, TREES, DEPTH = 4000, 30, 8
_KEYS = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer"
_KEYED = re.compile(rf"(?:^|[^A-Za-z])(?:{_KEYS})[A-Za-z_]*[\"']?\s*$", re.I)
_ASSIGN = re.compile(r"[:=]")
_VALUE = re.compile(r"[:=]?\s*[\"']?([^\s\"'<>,;]{6,})")
_KNOWN = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk[-_][A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|(?<![\w-])eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]*")
_BEGIN, _END = (re.compile(rf"-----{x} [A-Z0-9 ]{{0,40}}PRIVATE KEY-----") for x in ("BEGIN", "END"))
_LOGIN = re.compile(r"\w://[^\s/:@\"'<>]{1,64}:([^\s/@\"'<>]{3,128})@")
_RUN = re.compile(r"\S{15,}")
#: Signs between the parts of a run without spaces; not those of padding at a part's end or of a URL's scheme.
_PART = re.compile(r"[\"'`,;{}\[\]()<>|&?]|(?<!=)=++(?!\Z|[\"'`,;{}\[\]()<>|&?])|:(?!//)")
_EDGE = "\"'`.,;:!?()[]{}<>#*$%&|~^"
#: An assigned value is taken as a whole up to this length, if it lies in a run of which a whole was taken before.
WHOLE = 256
#: Words of the dictionary: those in the most documents.
WORDS = 20_000
#: Words that look-alikes are often made of.
COMMON = ("the and for that with this from have test example sample user name data value file page index table image model default config version build release branch commit package module class function object string number secret password token access key api".split())
_BESIDE = {
    "keyed": re.compile(rf"(?:{_KEYS})", re.I),
    "digest": re.compile(r"\b(sha\d*|md5|commit|checksum|digest|hash|etag|revision|integrity|fingerprint)\b", re.I),
    "identifier": re.compile(r"\b(uuid|guid|id|isbn|serial|ticket|order|session|trace|request|build|version)\b", re.I),
    "placeholder": re.compile(r"example|sample|dummy|placeholder|changeme|your|xxx|test|fake|redacted", re.I),
}
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of spans that may be secrets, each span once; they may overlap. A run without spaces is a
    candidate as a whole only where nothing finer in it is one."""
    found: dict[tuple[int, int], str] = {}
    run = 0  # the end of the last value that was taken
    for m in _ASSIGN.finditer(text):
        if _KEYED.search(text[max(0, m.start() - 40) : m.start()]):
            stop = len(text) if m.end() >= run else min(run, m.end() + WHOLE)
            v = _VALUE.match(text, m.end(), stop)
            if v and not text.startswith("//", v.start(1)):
                begin, cut_off = v.start(1), v.end(1) == stop < run
                value = run if cut_off else v.end(1)
                part = _PART.search(text, begin, value)
                for end in [part.start() if part else value, *([] if cut_off else [value])]:
                    while end > begin and text[end - 1] in _EDGE:
                        end -= 1
                    if end - begin >= 6:
                        found.setdefault((begin, end), "assigned")
                run = max(run, value)
    at = 0
    ends = iter([*(m.span() for m in _END.finditer(text)), (len(text) + 1, 0)])
    begin, end = next(ends)
    for m in _BEGIN.finditer(text):
        if m.start() < at:  # inside the block before
            continue
        while begin < m.end():
            begin, end = next(ends)
        if not end:
            break
        found.setdefault((m.start(), end), "known")
        at = end
    for m in _LOGIN.finditer(text):
        found.setdefault(m.span(1), "assigned")
    parts: dict[str, tuple[list[tuple[int, int, str]], list[tuple[int, int]]]] = {}
    coarse: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        word, at = m.group(), m.start()
        if word.isalpha() and not _KNOWN.search(word):
            continue
        if word not in parts:
            parts[word] = _parts(word)
        fine, whole = parts[word]
        for a, b, kind in fine:
            found.setdefault((at + a, at + b), kind)
        coarse += [(at + a, at + b) for a, b in whole]
    # begins are sorted, and the longest reach up to each tells whether a finer span overlaps
    begins = sorted(found)
    reach = list(accumulate((end for _, end in begins), max))
    for a, b in coarse:
        before = bisect_left(begins, (b, 0))
        if not before or reach[before - 1] <= a:
            found.setdefault((a, b), "mixed")
    return sorted((a, b, kind) for (a, b), kind in found.items())


def _stripped(text: str, begin: int, end: int) -> tuple[int, int]:
    """A span without the signs at its edges."""
    left = end - len(text[begin:end].lstrip(_EDGE))
    return left, max(left, begin + len(text[begin:end].rstrip(_EDGE)))


def _parts(word: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Spans in a run without spaces: known forms and parts that mix letters and digits; the run as a whole."""
    begin, end = _stripped(word, 0, len(word))
    known = [m.span() for m in _KNOWN.finditer(word, begin, end)]
    firsts = [a for a, _ in known]

    def holds(a: int, b: int) -> bool:
        """Whether a known form lies in the span."""
        i = bisect_left(firsts, a)
        return i < len(known) and known[i][1] <= b

    fine = [(a, b, "known") for a, b in known]
    long_ = lambda a, b: b - a >= 16 and any(map(str.isdigit, word[a:b]))
    at = begin
    for stop, after in [*(m.span() for m in _PART.finditer(word, begin, end)), (end, end)]:
        a, b = _stripped(word, at, stop)
        if long_(a, b) and not holds(a, b):
            fine.append((a, b, "mixed"))
        at = after
    equals = word.rfind("=", begin, begin + len(word[begin:end].rstrip("=")))
    a, b = _stripped(word, equals + 1, end) if equals >= 0 else (begin, end)
    return fine, [(a, b)] if not known and long_(a, b) else []


def _class(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o"


@dataclass
class Vocabulary:
    """Words of a text and of the dictionary."""

    own: set[str]
    words: frozenset[str]

    def __contains__(self, word: str) -> bool:
        return word in self.own or word in self.words


def _key(id_col: str, text_col: str) -> Column:
    """128 bits that tell a row by its id and text: what is found by them is cut out of a text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("\u0001")), F.lit("\u0000"), F.coalesce(F.col(text_col), F.lit("")))))


def describe(value: str, before: str, after: str, path: str, vocabulary: Vocabulary | set[str] | frozenset[str]) -> list[float]:
    """Features of a candidate: form, transitions, coverage, path, neighbours."""
    n = max(len(value), 1)
    classes = [_class(c) for c in value]
    steps = Counter(zip(classes, classes[1:], strict=False))
    pairs = max(n - 1, 1)
    share = Counter(classes)
    letters = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in letters.values())
    vowels = sum(c in "aeiouAEIOU" for c in value)
    runs = re.findall(r"[^\W\d_]{3,}", value)
    covered = sum(len(r) for r in runs if r.lower() in vocabulary)
    common = sum(len(w) for w in COMMON if w in value.lower() and len(w) >= 4)
    left = before[-40:]
    return [
        math.log(n),
        entropy,
        entropy / max(math.log2(n), 1),
        *(share[c] / n for c in "dulo"),
        sum(v for (a, b), v in steps.items() if a != b) / pairs,
        steps["l", "d"] / pairs,
        steps["d", "l"] / pairs,
        steps["u", "d"] / pairs,
        vowels / max(share["l"] + share["u"], 1),
        covered / n,
        min(1.0, common / n),
        max(map(len, runs), default=0) / n,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))),
        float(bool(_UUID.match(value))),
        float("@" in value),
        float("/" in value or ".com" in value or ".org" in value or ".net" in value),
        float(bool(_KNOWN.fullmatch(value))),
        float(bool(re.search(r"[:=]\s*[\"']?\Z", left))),
        float(bool(re.search(r"\w://[^\s/:@]+:\Z", left))),
        float(value.startswith("-----BEGIN")),
        float(left[-1:] in "\"'" and bool(left)),
        *(float(bool(p.search(left))) for p in _BESIDE.values()),
        float(bool(_BESIDE["placeholder"].search(value))),
        float(bool(re.search(r"test|example|doc|sample|fixture", path, re.I))),
        float(bool(re.search(r"\.(env|ya?ml|json|ini|conf|properties|tf|sh)\Z", path, re.I))),
        float(after[:1] in "\"'" and bool(after)),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, str, float]]:
    """(before, candidate, after, path, label): secrets of common forms and look-alikes, half each."""
    rng = random.Random(seed)
    hexes, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    syllables = "the an er on ti re st en ed ha es or ing ou de la que ment ung sch ver".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    phrase = lambda: " ".join(word() for _ in range(rng.randint(1, 5))) + " "
    paths = ["", "src3", "app/settings.py", "config/prod.env", "deploy.yaml", "docs/guide.md", "tests/test_login.py", "web/page.html", "notes.txt"]
    keys = "password passwd secret token api_key access_key auth_token client_secret pwd API_KEY db_password".split()
    sign = lambda: rng.choice(["=", " = ", ": ", "=\"", " = \"", ": \"", "='"])
    secrets = [
        lambda: (phrase(), rng.choice(["AKIA", "AKIA", "ASIA"]) + pick(upper, 16)),
        lambda: (phrase() + "aws_access_key_id" + sign(), "AKIA" + pick(upper, 16)),
        lambda: (phrase() + rng.choice(keys) + sign(), pick(hexes, rng.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: (phrase() + rng.choice(keys) + sign(), pick(mixed, rng.randint(10, 44))),
        lambda: (phrase() + rng.choice(keys) + sign(), pick(mixed + "!#%&*-_", rng.randint(9, 20))),
        lambda: (phrase(), "ghp_" + pick(mixed, 36)),
        lambda: (phrase(), "sk-" + pick(mixed, rng.choice([32, 48]))),
        lambda: (phrase(), "xoxb-" + pick("0123456789", 11) + "-" + pick(mixed, 24)),
        lambda: (phrase() + f"{rng.choice(['postgres', 'https', 'redis', 'ftp'])}://{word()}:", pick(mixed + "!%_-", rng.randint(6, 24))),
        lambda: (phrase(), f"-----BEGIN {rng.choice(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n" + "\n".join(pick(mixed + "+/", 64) for _ in range(rng.randint(2, 12))) + "\n-----END PRIVATE KEY-----"),
        lambda: (phrase(), "eyJ" + pick(mixed, 20) + "." + pick(mixed, 40) + "." + pick(mixed, 30)),
    ]
    alikes = [
        lambda: (phrase() + rng.choice(["commit ", "sha256:", "md5 ", "checksum ", "revision ", "etag: "]), pick(hexes, rng.choice([32, 40, 64]))),
        lambda: (phrase(), pick(hexes, rng.choice([32, 40]))),
        lambda: (phrase() + rng.choice(["", "id=", "uuid: ", "request "]), "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))),
        lambda: (phrase(), f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com"),
        lambda: (phrase() + rng.choice(keys) + sign(), rng.choice(["changeme", "your-token-here", "example123", "xxxxxxxxxxxx", "<password>", "${PASSWORD}", "os.environ", "placeholder", "test1234", "None/null", "redacted", "required", "forgotten"])),
        lambda: (phrase() + rng.choice(keys) + ": ", word() + word() + word()),
        lambda: (phrase(), f"https://{word()}.example.com/{word()}/{rng.randint(1, 9999)}"),
        lambda: (phrase(), f"{word()}_{word()}_{word()}_{rng.randint(1, 999)}"),
        lambda: (phrase() + rng.choice(["version ", "build ", ""]), f"{rng.randint(1, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-{word()}{rng.randint(1, 99)}"),
        lambda: (phrase(), f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:00Z"),
        lambda: (phrase(), f"{word()}{rng.choice('#*$%&|')}{word()}{rng.randint(1, 9)}{word()}{word()}"),
        lambda: (phrase(), f"+{rng.randint(1, 99)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}"),
        lambda: (phrase(), "AKIA" + "IOSFODNN7EXAMPLE"),
        lambda: (phrase() + f"https://{word()}:", rng.choice(["password", "user", "<password>", "$PASSWORD", "xxxx", "changeme", "pass"])),
        lambda: (phrase(), f"{word()}-{word()}-{word()}-{rng.randint(1, 99)}.html"),
    ]
    out = []
    for i in range(n):
        label = i % 2
        before, value = rng.choice(secrets if label else alikes)()
        quote = before[-1:] if before[-1:] in "\"'" else ""
        out.append((before, value, quote + " " + phrase(), rng.choice(paths), float(label)))
    return out


def dictionary(docs: DataFrame, size: int = WORDS, text_col: str = "text") -> frozenset[str]:
    """The words of letters alone, in lower case, that the most documents have; of equally frequent ones the first by the
    alphabet. Counts are added up in each task before they are shuffled; the driver gets ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches, 128):
            for text in batch.column(0):
                counts.update({w for w in map(_plain_word, set((text.as_py() or "").split())) if w})
            if len(counts) > 200_000:
                yield held()
                counts.clear()
        yield held()

    counts = map_arrow(docs.select(text_col), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return frozenset(r.word for r in counts.orderBy(F.desc("n"), "word").limit(size).collect())


def _plain_word(word: str) -> str | None:
    """A word of 3 to 30 letters without the signs at its edges, in lower case."""
    word = word.strip(_EDGE)
    return word.lower() if 3 <= len(word) <= 30 and word.isalpha() else None


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, float]] | None = None, words: frozenset[str] = frozenset()) -> RandomForestClassificationModel:
    """Fits the forest to labelled findings (before, candidate, after, path, label); ``words``: the dictionary."""
    rows = []
    for before, value, after, path, label in findings or labelled_findings():
        vocabulary = {w.lower() for w in re.findall(r"[^\W\d_]+", f"{before} {after}")} - {value.lower()} | words
        rows.append((describe(value, before, after, path, vocabulary), label))
    table = spark.createDataFrame(rows, "x array<double>, label double").coalesce(1)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=3, maxBins=32, featureSubsetStrategy="sqrt")
    return forest.fit(cut(table.select(array_to_vector("x").alias("features"), "label")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", words: frozenset[str] = frozenset()) -> DataFrame:
    """(key, id, start, end, kind, sha256, x): all candidates with their features."""
    kind = docs.schema[id_col].dataType.simpleString()
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path"), _key(id_col, text_col).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, starts, ends, kinds, hashes, xs = [], [], [], [], [], []
            for i, (text, path) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                text = text.as_py() or ""
                found = candidates(text)
                if found:
                    vocabulary = Vocabulary({w.lower().strip(_EDGE) for w in text.split() if w.isalpha() or w[:-1].isalpha()}, words)
                for a, b, what in found:
                    at.append(i)
                    starts.append(a)
                    ends.append(b)
                    kinds.append(what)
                    hashes.append(hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest())
                    xs.append(describe(text[a:b], text[max(0, a - 60) : a], text[b : b + 20], path, vocabulary))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(3).take(take), batch.column(0).take(take), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string()), pa.array(hashes, pa.string()), pa.array(xs, pa.list_(pa.float64()))],
                names=["key", "id", "start", "end", "kind", "sha256", "x"],
            )

    return map_arrow(rows.select("id", "text", "path", "key"), run, f"key binary, id {kind}, start long, end long, kind string, sha256 string, x array<double>")


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", words: frozenset[str] = frozenset()) -> DataFrame:
    """The findings that the forest takes for secrets: (key, id, start, end, kind, sha256, probability)."""
    found = find(docs, id_col, text_col, path_col, words)
    scored = model.transform(found.withColumn("features", array_to_vector("x")))
    scored = scored.select("key", "id", "start", "end", "kind", "sha256", vector_to_array("probability")[1].alias("probability"))
    return _settled(scored.where("probability >= 0.5"))


def _settled(accepted: DataFrame) -> DataFrame:
    """Accepted findings without those that overlap a better one; repeated rows keep theirs."""
    columns = accepted.columns
    each = accepted.groupBy(*columns).agg(F.count("*").alias("n"))
    order = W.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    each = each.withColumn("apart", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("group", F.sum("apart").over(order))
    finding = F.struct(F.when(F.col("kind") == "mixed", 1).otherwise(0).alias("rank"), (F.col("start") - F.col("end")).alias("short"), *(c for c in ("start", "end", "kind", "sha256", "probability", "n")))
    groups = each.groupBy("key", "id", "group").agg(F.array_sort(F.collect_list(finding)).alias("found"))
    none = F.slice("found", 1, 0)
    kept = F.aggregate("found", none, lambda out, x: F.when(F.exists(out, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), out).otherwise(F.concat(out, F.array(x))))
    rows = groups.select("key", "id", F.explode(kept).alias("x")).select("key", "id", "x.*")
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*columns)


def redact(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", length_col: str | None = None, mark: str = "<SECRET>", words: frozenset[str] = frozenset()) -> DataFrame:
    """All documents, each secret replaced by ``mark``; all columns as given, but for the length of changed texts."""
    key, spans_col, changed_col = (fresh(docs, name) for name in ("__key", "__spans", "__text"))
    spans = scan(docs, model, id_col, text_col, path_col, words).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans_col))
    spans = cut(spans.withColumnRenamed("key", key))
    joined = _with_spans(docs.withColumn(key, _key(id_col, text_col)), spans, key, spans_col)
    # pieces between secrets: from the end of one to the start of the next
    text = F.col(text_col)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans_col, lambda s: s["end"]))
    ends = F.concat(F.transform(spans_col, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    changed = F.array_join(pieces, mark)
    out = joined.withColumn(changed_col, F.when(F.col(spans_col).isNotNull(), changed))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.length(changed_col), F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.withColumn(text_col, F.coalesce(changed_col, text)).select(*docs.columns)


def _with_spans(docs: DataFrame, spans: DataFrame, key: str, spans_col: str) -> DataFrame:
    """Documents with their spans, or null. Only the documents that have any are shuffled to them; which those are is
    told by their keys, broadcast while those are few."""
    n = spans.count()
    keys, kind = spans.select(key), spans.schema[spans_col].dataType
    without = join_ids(docs, keys, key, n, "left_anti").withColumn(spans_col, F.lit(None).cast(kind))
    return join_ids(docs, keys, key, n, "left_semi").hint("merge").join(spans, key).unionByName(without)
