"""URL verdicts from pattern rules indexed by their rarest literal token.

Each rule has literal tokens that any URL it fits must hold, read off its parsed pattern. Tokens are counted over the
URLs of the whole table (only those that some rule names, so the counts are as few as the rules), each rule is filed
under its rarest, and the tokens of a URL fetch the candidate rules; only those run their regular expressions. Rules
without a literal token are few by intent; they are tried on every URL.

Rules are a table as long as a block list: it goes to the driver and with the tasks, at most ``MAX_RULES`` rows.

Defined results: null URLs and those without ``://`` have an empty host and path, fit no host rule and get the default
verdict; ties between rules of one length go to the block rule, then by text; repeated rows are judged alike; an empty
table gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
import re._constants as _op
import re._parser as re_parser
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._session import map_arrow, own_name

TOKEN = r"[a-z0-9]+"
#: Rules of a table, at most; a longer one is refused, never cut.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A regular expression over host + path, its verdict, and its text; ``listed`` rules come before patterns."""

    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    text: str
    listed: bool


def host_rule(text: str, verdict: str) -> Rule:
    """A rule such as ``example.net/en/``: fits the host and its subdomains if the path starts with the rule's."""
    host, slash, path = text.partition("/")
    literal = tuple(re.findall(TOKEN, host))
    return Rule(rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", verdict, literal, text, True)


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Whole tokens that every match of a pattern holds: runs of literal letters and digits, outside alternatives and
    optional parts, with a boundary, another literal or the pattern's end on both sides."""
    tokens: list[str] = []
    run: str | None = ""  # None: a run that something other than a literal may extend

    def end(bounded: bool) -> None:
        nonlocal run
        if bounded and run:
            tokens.append(run)
        run = "" if bounded else None

    def walk(items) -> None:
        nonlocal run
        for op, arg in items:
            if op is _op.LITERAL:
                c = chr(arg).lower()
                if re.fullmatch(TOKEN, c):
                    run = run + c if run is not None else None
                else:
                    end(True)
            elif op is _op.AT:
                end(arg in (_op.AT_BEGINNING, _op.AT_BEGINNING_STRING, _op.AT_END, _op.AT_END_STRING, _op.AT_BOUNDARY))
            elif op is _op.SUBPATTERN:
                walk(arg[3])
            else:
                end(False)

    walk(re_parser.parse(pattern))
    end(False)  # what follows the pattern may extend its last token
    return tuple(dict.fromkeys(tokens))


def pattern_rule(pattern: str, verdict: str) -> Rule:
    """A regular expression, matched from the host's begin on."""
    return Rule(pattern, verdict, literal_tokens(pattern), pattern, False)


def table_rules(rules: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table (rule, verdict, kind), whose kind is ``host`` or ``pattern``; rows with a null are left out, and
    repeated rows count once."""
    rows = rules.select("rule", "verdict", "kind").dropna().distinct().limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return tuple(sorted((host_rule(r["rule"], r["verdict"]) if r["kind"] == "host" else pattern_rule(r["rule"], r["verdict"]) for r in rows), key=lambda r: (r.text, r.verdict)))


#: The default verdict's rules: host names of advertising, gambling, pill shops and link farms.
PATTERNS = (
    pattern_rule(r"[^/]*\bcheap-pills\b", "block"),
    pattern_rule(r"[^/]*\bcasino-[a-z0-9]+", "block"),
    pattern_rule(r"[^/]*\bfree-bets\b", "block"),
    pattern_rule(r"[^/]*\bspam-farm\b", "block"),
    pattern_rule(r"[^/]*\bads-track\b", "block"),
    pattern_rule(r"[^/]*/.*\badult\b", "block"),
)


def rarest_index(urls: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> dict[str | None, list[int]]:
    """Rules by their rarest token, None for those without: one pass that counts the rules' own tokens over all URLs."""
    named = sorted({t for r in rules for t in r.tokens})
    tokens = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(url_col), F.lit(""))), F.lit(f"({TOKEN})")))).alias("token"))
    wanted = urls.sparkSession.createDataFrame([(t,) for t in named], "token string")
    counts = {r["token"]: r["n"] for r in tokens.join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}  # tokens of the rules
    index: dict[str | None, list[int]] = {}
    for i, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=None), []).append(i)
    return index


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]+", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def judge(urls: DataFrame, rules: tuple[Rule, ...], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row: the longest listed rule that fits, else the first pattern."""
    index = rarest_index(urls, rules, url_col)
    kind, out_id = urls.schema[id_col].dataType.simpleString(), own_name(id_col, ("host", "path", "rule", "verdict"))
    compiled: dict[int, re.Pattern] = {}

    def fits_rule(i: int, whole: str) -> bool:
        if i not in compiled:
            compiled[i] = re.compile(rules[i].pattern)
        return compiled[i].match(whole) is not None

    def verdict(host: str, path: str) -> tuple[str | None, str]:
        whole = host + path
        candidates = {i for t in (None, *set(re.findall(TOKEN, whole.lower()))) for i in index.get(t, ())}
        fits = [rules[i] for i in candidates if fits_rule(i, whole)]
        listed = [r for r in fits if r.listed]
        if listed:
            best = min(listed, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
            return best.text, best.verdict
        return None, min((r.verdict for r in fits), key=lambda v: v != "block", default=default)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [verdict(*p) for p in parts]
            columns = ([p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=[out_id, "host", "path", "rule", "verdict"])

    return map_arrow(urls.select(F.col(id_col), F.col(url_col)), run, f"`{out_id}` {kind}, host string, path string, rule string, verdict string")
