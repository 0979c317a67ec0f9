"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, by the block that holds them, and tags negative; the
weights are log-odds of being inside the content region, learned from labelled pages. One linear scan (the running sum
that restarts when it falls to zero) finds the best contiguous region, whose words are the text.

A block is the text between two tags that break a line. Its words are weighed by its length, its sentence marks and its
share of links first, and by the name of its element second, so that running text in elements that labelled pages show
as noise alone still counts. Tags that only lay a page out (``LAYOUT``) cost little, whatever was learned of them.

Menus, adverts, comments and the like are no part of any region: their words and tags weigh nothing, so they neither
join a region nor end one. Some elements are always such (``NEVER``); others are judged by the parts of the names in their
class, id and role: those of ``NOISE`` are such, and those of ``DOUBTFUL``, with what was learned of names, unless they hold
running text. What follows a heading such as "Comments" is such up to the end of the heading's parent. An element
that holds the page's largest article, or most of its words, is not noise, whatever its class.

Labelled pages are those that mark their own region with ``article`` or ``main``; at most ``SAMPLE`` of them, chosen
by hash, are read for the weights. The marks are labels for learning; for extraction ``article`` is a tag like others. Prior
weights (``PRIOR``) are set by hand, and hold where labelled pages show little.

Defined results: null and empty pages, and pages without words, give the empty text; very long pages are read whole, in
time linear in their length and depth; unclosed elements end with their parent or the page; of equal regions the first
is taken; repeated rows give equal texts; an empty table gives none; extra columns are kept, but for one named ``text``;
an id column of that name is given with ``_id`` appended.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._session import map_arrow, own_name, slices

#: Labelled pages for the weights, at most.
SAMPLE = 400
# quotes enclose an attribute's value only right after its "="; elsewhere they are characters
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe)\b.*?(?:</\1\s*>|\Z)|<[/!?]?[a-zA-Z](?>[^>=]|=\s*(?>\"[^\"]*\"|'[^']*')?+)*+>|<!(?:[^>])*>", re.S | re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_HINT = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*))", re.I)
#: Elements within a line, elements without an end, and elements whose text is never content.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head title nav footer aside button label option dialog menu legend".split())
#: Elements that lay a page out, of which those of lines, lists and tables, and the most that one of their tags can cost.
ROWS, ROW_COST = frozenset("p br li td th tr dt dd".split()), 0.02
LAYOUT, LAYOUT_COST = frozenset("div section td tr th table tbody thead tfoot ul ol li dl dt dd center figure figcaption p br blockquote pre hr h1 h2 h3 h4 h5 h6".split()), 0.05
#: Prior weights. Words by their block: its share of links, legal phrases, sentence marks, and length; by their element,
#: added to that; tags. Words of evidence that a prior counts as.
PRIOR = {
    "block link": 0.02, "block legal": 0.02, "block short": 0.3, "block middle": 0.3, "block long": 0.5, "block short sentence": 0.6, "block middle sentence": 1.0, "block long sentence": 1.0,
    "word h1": 1.0, "word h2": 1.0, "word h3": 1.0, "word": 0.0, "tag": -0.5, "tag inline": -0.02, "tag layout": -0.04, "tag row": -0.02,
}
EVIDENCE = 200
#: What an element's name can take from a word's weight, the least weight of words, and that of some blocks.
ELEMENT, WORD, LEAST = 0.5, 0.2, {"block link": 0.02, "block legal": 0.02}
#: Parts of names in class, id and role. Those of parts with hyphens, underscores or inner capitals count each.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle adbox sponsor sponsored sponsors promoted promo promos promotion promotions banner comment comments commentlist commenter replies reply respond disqus cookie cookies consent gdpr nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar newsletter subscribe subscription signup popup modal pagination pager toolbar login signin complementary contentinfo notice notices alert disclaimer masthead".split())
DOUBTFUL = frozenset("related recommended recommendations search share sharing social widget widgets discuss discussion form".split())
#: Parts before these that make a name one of a wrapper: it has what it names, or has not.
WRAPPER = frozenset("has no with without is".split())
#: Evidence of a doubtful name, a header of the page, and the words from which on running text speaks for itself.
DOUBT, HEADER, RUNNING = -2.0, -2.0, 25
#: Headings after which comments, or links to other pages, follow.
_AFTER = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader|user|latest|recent)s?\s+)?(?:comments?|replies|responses|leave a (?:comment|reply)|(?:add|post|write) a (?:comment|reply)|related (?:articles|posts|stories|links|content)|you (?:may|might) also like|share this(?: \w+)?)\W*(?:\(?\d+\)?\W*)?\Z", re.I)
_LEGAL = re.compile(r"\u00a9|\(c\)|copyright|all rights reserved|privacy policy|terms of (?:use|service)|cookie", re.I)
_PARTS = re.compile(r"[^\W_]+")


@dataclass
class Element:
    name: str
    begin: int
    hints: list[str]
    marked: bool
    parent: Element | None = None
    end: int = 0

    def parent_end(self, page: Page) -> int:
        return self.parent.end if self.parent else len(page.parts)


@dataclass
class Page:
    """Parts (feature, text, breaks a line) in order, and the elements over them."""

    parts: list[tuple[str, str, bool]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def _hints(tag: str) -> list[str]:
    return [w for groups in _HINT.findall(tag) for w in "".join(groups).split()]


def parse(source: str) -> Page:
    """Parts and elements; features are such as ``word p`` and ``tag /div``."""
    page, at, links, marks = Page(), 0, 0, 0
    stack: list[tuple[Element, str]] = []  # with the name of the block that it is or lies in
    opened: Counter = Counter()

    def words(text: str) -> None:
        page.parts.append(("word link" if links else f"word {stack[-1][1] if stack else 'body'}", html.unescape(text) if "&" in text else text, False))

    def close(upto: str) -> None:
        nonlocal marks
        while stack:
            element, _ = stack.pop()
            element.end = len(page.parts)
            opened[element.name] -= 1
            marks -= element.name in ("article", "main")
            if element.name == upto:
                return

    last = source.rfind(">") + 1  # no tag ends later, and looking for its end at every "<" would take quadratic time
    for m in _TOKEN.finditer(source, 0, last):
        if m.start() > at:
            words(source[at : m.start()])
        at = m.end()
        raw = m.group()
        named = _NAME.match(raw)
        if not named or m.group(1):
            continue  # comments, declarations, scripts
        ends, name = named.group(1), named.group(2).lower()
        inline = name in INLINE
        links = max(0, links + (-1 if ends else 1)) if name == "a" else links if inline or name in VOID else 0
        if ends:
            if opened[name]:
                close(name)
            page.parts.append((f"tag /{name}", "", not inline))
            continue
        hints = _hints(raw) if len(raw) > len(name) + 2 else []
        if not inline and name not in VOID and stack:
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0].name == name or stack[-1][0].name == "p":
                close(stack[-1][0].name)  # a block ends an open paragraph, a list item the one before
        if name not in VOID and not raw.endswith("/>") and (not inline or hints):
            element = Element(name, len(page.parts), hints, marks > 0, stack[-1][0] if stack else None)
            page.elements.append(element)
            stack.append((element, stack[-1][1] if inline and stack else "body" if inline else name))
            opened[name] += 1
            marks += name in ("article", "main")
        page.parts.append((f"tag {name}", "", not inline))
    if at < len(source):
        words(source[at:].partition("<!--")[0])
    close("")
    return page


def _counts(page: Page) -> tuple[list[int], list[int]]:
    """Words, and words of links, before each part."""
    sizes = [len(text.split()) if kind.startswith("word") else 0 for kind, text, _ in page.parts]
    return [0, *accumulate(sizes)], [0, *accumulate(n if kind == "word link" else 0 for (kind, _, _), n in zip(page.parts, sizes, strict=True))]


def _blocks(page: Page, before: list[int], linked: list[int]) -> list[str]:
    """The kind of block that each part lies in; a part that breaks a line lies in none."""
    kinds, lo = [""] * len(page.parts), 0
    for i in range(len(page.parts) + 1):
        if i < len(page.parts) and not page.parts[i][2]:
            continue
        n, links = before[i] - before[lo], linked[i] - linked[lo]
        if n:
            text = "".join(t for _, t, _ in page.parts[lo:i]) if n < 40 else next(t for _, t, _ in reversed(page.parts[lo:i]) if t.strip())
            if 2 * links > n:
                kind = "block link"
            elif n < 40 and _LEGAL.search(text):
                kind = "block legal"
            else:
                ends = text.rstrip().rstrip("\"'\u201d\u2019)]")[-1:] in set(".!?:;\u2026\u3002")
                kind = ("block short" if n < 8 else "block middle" if n < 25 else "block long") + " sentence" * ends
            kinds[lo:i] = [kind] * (i - lo)
        lo = i + 1
    return kinds


def _names(hint: str) -> list[str]:
    """Parts of a name, in lower case, but for those that a wrapper says it has or has not."""
    parts = [p.lower() for p in _PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", hint).replace("_", "-"))]
    return [p for i, p in enumerate(parts) if not (i and parts[i - 1] in WRAPPER)]


def _is_noise(e: Element, weights: dict[str, float], running: bool) -> bool:
    """Whether an element's names, or its own, tell that it is no content."""
    score = 0.0
    for hint in e.hints:
        parts = _names(hint)
        if not NOISE.isdisjoint(parts):
            return True
        score += weights.get(f"hint {hint.lower()}", 0.0) + (0.0 if DOUBTFUL.isdisjoint(parts) else DOUBT)
    return e.name == "form" or score < 0 and not running


def noise(page: Page, weights: dict[str, float], before: list[int], linked: list[int]) -> list[bool]:
    """Whether each part lies in an element that is no content."""
    total = before[-1]
    size = lambda e: before[e.end] - before[e.begin]
    largest = max((e for e in page.elements if e.name in ("article", "main")), key=size, default=None)
    if largest is not None and 2 * size(largest) < total - size(largest):
        largest = None  # as an article that holds only the heading
    headed = sorted(e.begin for e in page.elements if e.name in ("h1", "h2") and before[e.end] - before[e.begin] > linked[e.end] - linked[e.begin])
    depth = [0] * (len(page.parts) + 1)
    for e in page.elements:
        lo, hi = e.begin, e.end
        if e.name in ("html", "body", "article", "main"):
            continue
        if re.fullmatch("h[1-6]", e.name) and _AFTER.match(" ".join("".join(t for _, t, _ in page.parts[lo : min(hi, lo + 40)]).split())) and before[hi] - before[lo] <= 6:
            hi = e.parent_end(page)  # what follows the heading
        elif e.name not in NEVER:
            n = size(e)
            running = n >= RUNNING and 10 * (linked[e.end] - linked[e.begin]) < 3 * n
            if e.name == "header":  # of the page, and not of what it heads
                if e.marked or (k := bisect_left(headed, lo)) < len(headed) and headed[k] < hi:
                    continue
            elif not _is_noise(e, weights, running):
                continue
            if largest is not None and lo <= largest.begin and largest.end <= hi:
                continue
            if not e.marked and 2 * n > total and not any(p in ("comment", "comments", "commentlist", "replies") for h in e.hints for p in _names(h)):
                continue
        depth[lo] += 1
        depth[hi] -= 1
    return [d > 0 for d in list(accumulate(depth))[:-1]]


def _marked(page: Page) -> list[bool] | None:
    """Whether each part lies in an article, for learning; None if the page marks none."""
    depth = [0] * (len(page.parts) + 1)
    found = [e for e in page.elements if e.name in ("article", "main")]
    for e in found:
        depth[e.begin + 1] += 1  # its own tag is outside
        depth[e.end] -= 1
    return [d > 0 for d in list(accumulate(depth))[:-1]] if found else None


def _labelled(source: str) -> Counter:
    """Counts of (feature, inside the marked region); words count each, for their block and for their element."""
    page, out = parse(source), Counter()
    inside = _marked(page) or [False] * len(page.parts)
    before, linked = _counts(page)
    blocks = _blocks(page, before, linked)
    for i, (kind, _, _) in enumerate(page.parts):
        n = before[i + 1] - before[i] if kind.startswith("word") else 1
        if n:
            out[kind, inside[i]] += n
            if kind.startswith("word"):
                out[blocks[i], inside[i]] += n
    for e in page.elements:
        for h in set(e.hints):
            out[f"hint {h.lower()}", e.marked] += before[e.end] - before[e.begin]
    return out


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights from at most SAMPLE labelled pages."""
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
    chosen = marked.orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE)
    ids = pages.sparkSession.createDataFrame(chosen.collect(), marked.schema).distinct()
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(ids), "id")  # SAMPLE ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(_labelled(page))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(total.values(), pa.int64())], names=["kind", "inside", "n"])

    counts = map_arrow(rows.select("html"), run, "kind string, inside boolean, n long").groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inner"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outer"))
    return {r["kind"]: _learned(r["kind"], r["inner"], r["outer"]) for r in counts.collect()}  # features of SAMPLE pages


def _learned(kind: str, inner: int, outer: int) -> float:
    """The log-odds of a feature, drawn to its prior by EVIDENCE, within its limits."""
    if kind.startswith("hint"):
        return max(-6.0, min(math.log((inner + 0.5) / (outer + 0.5)), 3.0))
    prior = _prior(kind)
    odds = math.log((inner + EVIDENCE / (1 + math.exp(-prior))) / (outer + EVIDENCE / (1 + math.exp(prior))))
    if kind.startswith("block"):
        return LEAST.get(kind, max(WORD, min(odds, 3.0)))
    if kind.startswith("word"):
        return max(-ELEMENT, min(odds, 1.0))
    name = kind.partition(" ")[2].lstrip("/")
    most = 0.1 if name in INLINE else ROW_COST if name in ROWS else LAYOUT_COST if name in LAYOUT else 3.0
    return min(-0.02, max(odds, -most))


def _prior(kind: str) -> float:
    first, _, name = kind.partition(" ")
    name = name.lstrip("/")
    group = PRIOR["tag inline" if name in INLINE else "tag row" if name in ROWS else "tag layout" if name in LAYOUT else "tag"]
    return PRIOR.get(f"{first} {name}", group if first == "tag" else PRIOR["word"])


def weight(kind: str, weights: dict[str, float]) -> float:
    return weights[kind] if kind in weights else _prior(kind)


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum, [lo, hi), in one scan; (0, 0) if none is positive."""
    best = total = 0.0
    begin = lo = hi = 0
    for i, w in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += w
        if total > best:
            best, lo, hi = total, begin, i + 1
    return lo, hi


def scores(page: Page, weights: dict[str, float], skip: list[bool], before: list[int], linked: list[int]) -> list[float]:
    """The score of each part; that of a text is the sum over its words."""
    out = []
    for i, ((kind, _, _), block) in enumerate(zip(page.parts, _blocks(page, before, linked), strict=True)):
        if skip[i]:
            out.append(0.0)
        elif kind.startswith("word"):
            n = before[i + 1] - before[i]
            out.append(n * LEAST.get(block, max(WORD, weight(block, weights) + weight(kind, weights))) if n else 0.0)
        else:
            out.append(weight(kind, weights))
    return out


def extract(source: str | None, weights: dict[str, float]) -> str:
    """Text of the best contiguous region."""
    page = parse(source or "")
    before, linked = _counts(page)
    skip = noise(page, weights, before, linked)
    lo, hi = best_run(scores(page, weights, skip, before, linked))
    out = [" " if breaks else text for (_, text, breaks), noisy in zip(page.parts[lo:hi], skip[lo:hi], strict=True) if breaks or not noisy]
    return " ".join("".join(out).split())


def main_text(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every row."""
    kind, out_id = pages.schema[id_col].dataType.simpleString(), own_name(id_col, ("text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(page.as_py(), weights) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, *range(2, batch.num_columns))), pa.array(texts, pa.string())], names=[out_id, *rest, "text"])

    rest = [c for c in pages.columns if c not in (id_col, html_col, "text")]
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)
    return map_arrow(pages.select(id_col, html_col, *rest), run, f"`{out_id}` {kind}, " + (fields + ", " if fields else "") + "text string")
