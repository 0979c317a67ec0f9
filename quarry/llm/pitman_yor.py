"""Language-model scores of texts by a hierarchical Pitman-Yor model of word pairs.

Each word is a context with a restaurant of its own; its customers are the words that follow. The restaurants share one
parent, the restaurant of single words, whose parent is uniform over the words and one unknown. A dish's customers sit at
tables; a table is a customer of the parent. A sweep moves every customer. In a dish of few, Gibbs moves take one after
another from its table and seat it anew: at a table in proportion to its size less the discount, or at a new one in
proportion to what the parent gives the word. A dish of many is seated anew as a whole: its number of tables, all that
the model needs of it, is drawn from the distribution that such moves lead to. Seatings after the first sweeps are averaged
to the predictive probabilities that score all texts.

All texts are counted, and the work is cut so that no word, pair or text is one task's:

* A task reads its texts into blocks of about ``BLOCK`` tokens. A block's distinct pairs, with their counts in training
  texts, go to *parts* by word; a word with more than ``HOT_SHARE`` of the tokens is spread over all parts by context.
* A part adds up its pairs and seats them, all dishes side by side in numpy. Numbers of tables that a context has in other
  parts are estimated from those in its own while it seats; its seed is the part's number, so a lost part is seated alike.
* The tables and customers of each context are summed over the parts, which each get the sums back.
* A part then has all that its pairs' probabilities need, and answers each block; a block's texts add up theirs.

So what is shuffled follows the distinct pairs of blocks, and a pair that all texts share is one number a block. Nothing of the
corpus goes through the driver but the number of tokens and the hot words (at most 1 / HOT_SHARE). Averages of a product
are taken as products of averages, so probabilities sum to one over the known words and the unknown one.

Defined results: a null or empty text is the end token alone; a very long text is cut over several blocks and its sums are
added; repeated rows, and rows that share an id, count and are scored each; null ids are kept; without training texts all words
are unknown; an empty table gives an empty result; extra columns are ignored; an id column named like an output column is
given with ``_id`` appended. The table is read three times and must give the same rows each time, as stored tables do; a
block whose answers are for other pairs raises.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import _words
from quarry.llm._session import map_arrow, own_name

#: Tokens of a block and of a part: a task holds a few numbers for each.
BLOCK, PART = 4_000_000, 2_000_000
#: Words with a larger share of the training tokens are spread over all parts.
HOT_SHARE = 1e-5
#: Dishes of up to so many customers are moved customer by customer, larger ones as a whole.
SINGLE = 16
#: Rows of ``carried`` are made for up to so many customers; a larger dish's weights are worked out on their own.
FAR = 400
#: How far a stride between rows of ``carried`` goes, and the largest part of its series that is left out.
REACH, LEFT_OUT = 4.0, 1e-13
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_U64 = np.uint64
OUT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


@dataclass(frozen=True)
class Settings:
    """Discounts and strengths of the context restaurants and of the one they share, sweeps before samples are taken,
    and samples."""

    discount: float = 0.75
    strength: float = 0.5
    root_discount: float = 0.6
    root_strength: float = 1.0
    burn_in: int = 2
    samples: int = 3
    seed: int = 1


# ---------------------------------------------------------------- seating


class Tables:
    """The tables of many dishes, those of most customers first: a column of table sizes for each dish."""

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        self.customers, self.discount, self.rng = customers.astype(np.int64), discount, rng
        self.sizes = np.zeros((4, len(customers)), np.int64)
        self.sizes[0] = 1
        self.count = np.ones(len(customers), np.int64)
        self.dishes = np.arange(len(customers))

    def _open(self, dishes: np.ndarray, tables: np.ndarray) -> None:
        """Opens so many tables of one customer each."""
        if not len(dishes):
            return
        free = self.sizes[:, dishes] == 0
        while (free.sum(0) < tables).any():
            self.sizes = np.vstack((self.sizes, np.zeros_like(self.sizes)))
            free = self.sizes[:, dishes] == 0
        self.sizes[:, dishes] += free & (np.cumsum(free, axis=0) <= tables)
        self.count[dishes] += tables

    def fill(self, fresh: np.ndarray) -> None:
        """Seats all customers, in strides that grow with the number seated; ``fresh``: weight of a new table."""
        seated = np.ones(len(self.dishes), np.int64)
        dishes = np.flatnonzero(seated < self.customers)
        while len(dishes):
            step = np.minimum(np.maximum(seated[dishes] // 2, 1), self.customers[dishes] - seated[dishes])
            weight = fresh[dishes]
            opened = self.rng.binomial(step, weight / (weight + seated[dishes] - self.discount * self.count[dishes]))
            joined = step - opened
            share = self.sizes[:, dishes] * joined // seated[dishes]
            share[0] += joined - share.sum(0)
            self.sizes[:, dishes] += share
            self._open(dishes[opened > 0], opened[opened > 0])
            seated[dishes] += step
            dishes = dishes[seated[dishes] < self.customers[dishes]]

    def _place(self, n: int, at: np.ndarray, less: float) -> np.ndarray:
        """The table at which sizes, each less a discount, add up to more than a number, for the first n dishes."""
        if n < len(self.sizes):  # few dishes of many tables
            sizes = self.sizes[:, :n]
            table = (np.cumsum(sizes - less * (sizes > 0), axis=0) <= at).sum(0)
            return np.minimum(table, len(sizes) - 1)
        total, table = np.zeros(n), np.zeros(n, np.intp)
        for sizes in self.sizes[:, :n]:
            total += sizes - less * (sizes > 0) if less else sizes
            table += total <= at
        return np.minimum(table, len(self.sizes) - 1)

    def move(self, n: int, fresh: np.ndarray) -> None:
        """Takes one customer of each of the first n dishes, drawn at random, from its table and seats it anew."""
        dishes, total = self.dishes[:n], self.customers[:n]
        table = self._place(n, self.rng.random(n) * total, 0)
        self.sizes[table, dishes] -= 1
        self.count[:n] -= self.sizes[table, dishes] == 0
        old = total - 1 - self.discount * self.count[:n]
        drawn = self.rng.random(n) * (old + fresh[:n])
        table = self._place(n, np.minimum(drawn, old * (1 - 1e-12)), self.discount)
        stays = (drawn < old) & (self.sizes[table, dishes] > 0)
        self.sizes[table[stays], dishes[stays]] += 1
        self._open(dishes[~stays], np.ones(int((~stays).sum()), np.int64))

    def sweep(self, fresh: np.ndarray) -> None:
        """As many moves of a dish as it has customers."""
        for i in range(int(self.customers.max(initial=0))):
            n = int(np.searchsorted(-self.customers, -max(i, 1)))  # dishes of more than i customers
            if not n:
                return
            self.move(n, fresh)


def carried(row: np.ndarray, a: int, c: int, discount: float) -> np.ndarray:
    """From the row of a customers to that of c, where row[m] is S(a, m + 1) d^m m! / S(a, 1), with the generalised Stirling
    numbers S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t). So row[m] grows by d m (row[m - 1] - row[m]) / (c - d) with each
    customer. The steps of several customers are one polynomial in the same differences."""
    rates = discount * np.arange(1, len(row))
    if not len(rates):
        return row
    top = rates[-1]
    while a < c:
        b = min(c, max(a + 1, int((a - discount) * (1 + REACH / top))))  # the sum of the weights times top is REACH at most
        weights = 1 / (np.arange(a, b) - discount)
        if b - a <= 24:
            for x in weights.tolist():
                row[1:] += x * rates * (row[:-1] - row[1:])
        else:
            # elementary symmetric sums of the weights, from the sums of their powers
            sums, power, e, term = [], np.ones(len(weights)), [1.0], row
            for k in range(1, len(weights) + 1):
                power = power * weights
                sums.append(float(power.sum()))
                e.append(sum((-1) ** i * e[k - 1 - i] * sums[i] for i in range(k)) / k)
                term = np.concatenate(([0.0], rates * (term[:-1] - term[1:])))
                row = row + e[k] * term
                if e[k] * top**k < LEFT_OUT:
                    break
        a = b
    return row


def summed(n: int, c: int, discount: float) -> np.ndarray:
    """The first n numbers of ``carried``'s row of c customers by their alternating sum, without the rows before: good to about
    1e-10 where the row is not small, so for n up to about c^d."""
    scale = c**-discount
    m, row, choose = np.arange(n), np.ones(n), np.ones(n)
    for k in range(1, min(n, 100)):
        x = discount * (k + 1)
        choose = choose * ((k - 1 - m) * (scale / k))
        # the product of 1 - d k / (j - d) over the customers j before c, times c^(d k), by gamma functions
        if c - x > 1:
            log = math.lgamma(c - x) - math.lgamma(c - discount) + math.lgamma(1 - discount) + math.lgamma(x) + discount * k * math.log(c)
            row += choose * (math.exp(log) * math.sin(math.pi * x) / math.pi)
        if abs(choose[-1]) * math.exp(math.lgamma(x)) < 1e-17:
            break
    return row


def far_weights(c: int, rate: float, discount: float) -> tuple[int, np.ndarray]:
    """The first of a range of numbers of tables, and the weights rate^t / t! a(t) of those in it, up to a factor, where a(t) is
    the coefficient of z^c in (1 - (1 - z)^discount)^t: fresh^t S(c, t) but for what t doesn't change. Beyond the range there
    is less than 1e-9 of the largest weight. Time grows with the square root of the rate, not with the customers.

    a(t) is an integral around z = 0; with z = exp(-s), over the parabola s = s0 (1 + iu)^2 around the cut s <= 0, through the
    saddle point of all t together, or over a circle. The trapezoidal rule is exact there but for rounding."""

    def power(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log(1 - z) and 1 - (1 - z)^discount."""
        z = np.exp(-s)
        small = 0.5 * np.log1p(z.real**2 + z.imag**2 - 2 * z.real) + 1j * np.arctan2(-z.imag, 1 - z.real)
        log = np.where(np.abs(z) < 0.5, small, np.log(-np.expm1(-s)))
        return log, -np.expm1(discount * log)

    # rate d z (1 - z)^(d - 1) = c, in the logarithm of s
    lo, hi = math.log(4 / c), math.log(max(60.0, 10 + 2 * abs(math.log(rate / c))))
    for _ in range(60):
        mid = (lo + hi) / 2
        s0 = math.exp(mid)
        log = math.log(rate * discount) - s0 + (discount - 1) * math.log(-math.expm1(-s0))
        lo, hi = (mid, hi) if log > math.log(c) else (lo, mid)
    s0 = math.exp(lo)
    tables = rate * float(power(np.array([s0 + 0j]))[1].real[0])
    z = math.exp(-s0)
    curve = rate * discount * z * (-math.expm1(-s0)) ** (discount - 2) * (1 - discount * z)  # variance of the customers
    width = 1 / math.sqrt(curve)
    varied = max(curve - c * c / tables, 0.0)  # the same for a given number of tables
    spread = math.sqrt(tables if s0 * c < 8 else tables * varied / curve)
    step = min(0.4 / math.sqrt(curve), s0 / 10) / (2 * s0)
    reach = 10 * spread + 20
    while True:
        first, last = max(1, math.floor(tables - reach)), min(c, math.ceil(tables + reach))
        at = min(max(round(tables), first), last)
        if varied < 100 and s0 > 0.1:  # nearly all sit alone: a whole circle, which the cut is far from
            s = s0 + 2j * math.pi / 1024 * np.arange(513)
            log_g = np.log(power(s)[1])
            base = at * log_g + c * s
            base -= base[0].real
            base[-1] += math.log(0.5)
        else:
            n = 64
            while True:
                u = step * np.arange(n)
                s = s0 * (1 + 1j * u) ** 2
                log_g = np.log(power(s)[1])
                base = at * log_g + c * s
                base += np.log(1 + 1j * u) - base[0].real
                # at the ends of the range, too, where the saddle point is elsewhere
                if max(base[-1].real + k * (log_g[-1].real - log_g[0].real) for k in (first - at, 0, last - at)) < -40:
                    break
                n *= 2
        base[0] += math.log(0.5)
        t = np.arange(first, last + 1)
        weight = np.empty(len(t))
        for a in range(0, len(t), 2048):
            far = (t[a : a + 2048] - at)[:, None]
            weight[a : a + 2048] = np.exp(far * (log_g - log_g[0].real) + base).real.sum(1)
        falling = np.concatenate(([0.0], np.cumsum(math.log(rate) + log_g[0].real - np.log(t[1:]))))
        with np.errstate(divide="ignore"):
            logs = falling + np.log(np.maximum(weight, 0))
        weight = np.exp(logs - logs.max())
        if (first == 1 or weight[0] < 1e-9) and (last == c or weight[-1] < 1e-9):
            return first, weight
        reach *= 2


def draw_tables(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes, each drawn in proportion to fresh^t S(customers, t): a Poisson number of further tables
    than one, times the row of ``carried``, which is as long as the dish needs but for a chance of about 1e-8. Where customers
    are many for such a row it is ``summed``; for others of up to FAR customers one pass over the rows, by customers, serves
    all dishes, and larger ones, which are few, have ``far_weights`` of their own."""
    out = np.ones(len(customers), np.int64)
    if not len(customers):
        return out
    rate = fresh / discount
    most = np.minimum(customers - 1, np.ceil(rate + 7 * np.sqrt(rate) + 12)).astype(np.int64)
    easy = (most <= 0.9 * customers.astype(np.float64) ** discount) & (customers > 100)
    far = ~easy & (customers > FAR)
    for i in np.flatnonzero(far).tolist():
        first, weight = far_weights(int(customers[i]), float(rate[i]), discount)
        weight = np.cumsum(weight)
        out[i] = first + min(int((weight <= rng.random() * weight[-1]).sum()), len(weight) - 1)
    order = np.lexsort((most, customers))
    order = order[~far[order]]
    if not len(order):
        return out
    log_rate = np.log(rate)
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int(most[order].max()) + 1)))))

    def draw(rows: np.ndarray, row: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            log_row = np.log(np.maximum(row, 0)) - log_factorial[: len(row)]
        for lo in range(0, len(rows), 1024):
            dishes = rows[lo : lo + 1024]
            k = int(most[dishes[-1]]) + 1
            weight = log_rate[dishes, None] * np.arange(k) + log_row[:k]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            drawn = rng.random(len(dishes)) * weight[:, -1]
            out[dishes] = 1 + np.minimum((weight <= drawn[:, None]).sum(1), k - 1)

    own = order[easy[order]]
    kinds, starts = np.unique(customers[own], return_index=True)
    for c, rows in zip(kinds.tolist(), np.split(own, starts)[1:], strict=True):
        draw(rows, summed(int(most[rows[-1]]) + 1, c, discount))
    own = order[~easy[order]]
    kinds, starts = np.unique(customers[own], return_index=True)
    if not len(own):
        return out
    need = np.maximum.accumulate(np.maximum.reduceat(most[own], starts)[::-1])[::-1]
    row, at = np.zeros(int(need[0]) + 1), 1
    row[0] = 1
    for c, rows, n in zip(kinds.tolist(), np.split(own, starts)[1:], need.tolist(), strict=True):
        row, at = carried(row[: n + 1], at, c, discount), c
        draw(rows, row)
    return out


class Seating:
    """Numbers of tables of dishes of any number of customers. Those of few have ``Tables``, where dishes for which like numbers
    of tables are expected are together; those of more than SINGLE are at one table until a sweep draws their number."""

    def __init__(self, customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator):
        self.discount, self.rng = discount, rng
        self.tables = np.minimum(customers, 1).astype(np.float64)
        self.groups = []
        expected = np.minimum(customers, 1 + (fresh + discount) * np.log1p(customers / (fresh + discount)))
        kind = np.where((customers > 1) & (customers <= SINGLE), np.ceil(np.log2(np.maximum(expected, 2))), 0)
        for k in np.unique(kind[kind > 0]):
            rows = np.flatnonzero(kind == k)
            rows = rows[np.argsort(-customers[rows], kind="stable")]
            for lo in range(0, len(rows), size := max(1, (1 << 19) >> int(k))):
                own = rows[lo : lo + size]
                group = Tables(customers[own], discount, rng)
                group.fill(fresh[own])
                self.groups.append((own, group))
                self.tables[own] = group.count
        self.large = np.flatnonzero(customers > SINGLE)
        self.customers = customers[self.large].astype(np.int64)

    def sweep(self, fresh: np.ndarray) -> None:
        for own, group in self.groups:
            group.sweep(fresh[own])
            self.tables[own] = group.count
        self.tables[self.large] = draw_tables(self.customers, fresh[self.large], self.discount, self.rng)


def seat(word: np.ndarray, context: np.ndarray, count: np.ndarray, spread: np.ndarray, parts: int, part: int, s: Settings) -> tuple:
    """Seats a part's pairs (numbers of word and context from 0, and a count of at least 1 each); ``spread``: for each word,
    whether all parts have pairs of it. Averages over the samples: the customers less discounts of each pair, the tables of
    each context, the customers less discounts of each word in the shared restaurant, and that one's customers and
    tables."""
    rng = np.random.default_rng((s.seed, part))
    words, contexts = len(spread), int(context.max(initial=-1)) + 1
    tables = np.ones(len(count))
    sums = [np.zeros(len(count)), np.zeros(contexts), np.zeros(words), 0.0, 0.0]
    if not len(count):
        return tuple(sums)
    seating = None
    for turn in range(s.burn_in + s.samples):
        of_word, of_context = np.bincount(word, tables, words), np.bincount(context, tables, contexts)
        # the shared restaurant, over all parts as far as this one can tell
        known = of_word > 0
        types = parts * known.sum() + 1
        below = (s.root_strength + s.root_discount * parts * known.sum()) / types
        root = Seating(of_word[known], np.full(int(known.sum()), below), s.root_discount, rng)
        root.sweep(np.full(int(known.sum()), below))
        rest = np.zeros(words)
        rest[known] = of_word[known] - s.root_discount * root.tables
        if turn >= s.burn_in:
            for total, value in zip(sums, (count - s.discount * tables, of_context, rest), strict=False):
                total += value
            sums[3] += of_word.sum()
            sums[4] += root.tables.sum()
        parent = (rest * np.where(spread, parts, 1) + below) / (s.root_strength + parts * of_word.sum())
        # tables of a context in all parts, when numbers of tables fall with their square
        alone = parts / math.log(parts + 1) if parts > 1 else 1.0
        everywhere = of_context if parts == 1 else np.maximum(of_context, np.where(of_context > 1, parts * (of_context - 1), alone))
        fresh = (s.strength + s.discount * everywhere[context]) * parent[word]
        if turn + 1 == s.burn_in + s.samples:
            break
        if seating is None:
            seating = Seating(count, fresh, s.discount, rng)
        seating.sweep(fresh)
        tables = seating.tables.copy()
    return tuple(x / s.samples for x in sums)


# ---------------------------------------------------------------- bytes of arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each with its kind and length before it."""
    return b"".join(np.array([ord(a.dtype.kind), a.dtype.itemsize, len(a)], "<i8").tobytes() + a.tobytes() for a in arrays)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        kind, size, n = np.frombuffer(raw, "<i8", 3, at).tolist()
        out.append(np.frombuffer(raw, f"<{chr(kind)}{size}", n, at + 24))
        at += 24 + n * size
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes as the largest needs."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def six_bytes(a: np.ndarray) -> np.ndarray:
    """The upper 48 bits of hashes, as three numbers of 16 bits."""
    return np.ascontiguousarray(a.astype("<u8").view("<u2").reshape(-1, 4)[:, 1:]).ravel()


def of_six(a: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a) // 3, 4), "<u2")
    out[:, :3] = a.reshape(-1, 3)
    return out.view("<u8").ravel()


def few(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in a byte each, and those of 255 or more in a list of their own."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8), narrow(counts[large])


def of_few(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


# ---------------------------------------------------------------- blocks of texts


class Block:
    """Tokens of texts, the token before each text's first, and whether a text is a training text."""

    def __init__(self, number: int, id_type: pa.DataType | None = None):
        self.number, self.id_type, self.size = number, id_type, 0
        self.words: list[np.ndarray] = []
        self.before: list[np.uint64] = []
        self.lengths: list[int] = []
        self.texts: list[tuple] = []  # (row, id, training)

    def add(self, row: int, key: object, training: bool, words: np.ndarray, before: np.uint64) -> None:
        self.texts.append((row, key, training))
        self.words.append(words)
        self.before.append(before)
        self.lengths.append(len(words))
        self.size += len(words)

    def tokens(self) -> np.ndarray:
        self.words = [np.concatenate(self.words)]
        return self.words[0]

    def pairs(self, hot: np.ndarray, parts: int) -> None:
        """Sorts tokens by part, word and word before, and finds the distinct pairs."""
        vocabulary, number = np.unique(np.append(self.tokens(), np.array(self.before, _U64)), return_inverse=True)
        self.words.clear()
        number = number.astype(np.uint32)
        word, before = number[: self.size], np.empty(self.size, np.uint32)
        before[1:] = word[:-1]
        before[np.cumsum([0, *self.lengths[:-1]])] = number[self.size :]
        is_hot = np.isin(vocabulary, hot)
        part = ((vocabulary >> _U64(20)) % _U64(parts)).astype(np.uint32)[word]
        if is_hot.any():
            spread = np.flatnonzero(is_hot[word])
            part[spread] = (_words.mix(vocabulary[word[spread]] + _words.mix(vocabulary[before[spread]])) >> _U64(20)) % _U64(parts)
        text = np.repeat(np.arange(len(self.lengths), dtype=np.uint32), self.lengths)
        training = np.array([t[2] for t in self.texts], bool)[text]
        bits = int(len(vocabulary)).bit_length()
        pair = (word.astype(_U64) << _U64(bits)) | before
        del number, word, before
        if 2 * bits + parts.bit_length() <= 64:
            order = np.argsort((part.astype(_U64) << _U64(2 * bits)) | pair, kind="stable")
        else:
            order = np.lexsort((pair, part))
        pair, part = pair[order], part[order]
        first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (part[1:] != part[:-1]))))
        self.pair_word = vocabulary[pair[first] >> _U64(bits)]
        self.pair_before = vocabulary[pair[first] & _U64((1 << bits) - 1)]
        self.pair_part = part[first].astype(np.int64)
        self.pair_tokens = np.diff(np.append(first, self.size))
        self.pair_training = np.add.reduceat(training[order].astype(np.int64), first)
        self.token_text = text[order]
        self.check = zlib.crc32(self.pair_before.tobytes(), zlib.crc32(self.pair_word.tobytes()))

    def runs(self) -> np.ndarray:
        """Where a new part or word begins."""
        return np.flatnonzero(np.concatenate(([True], (self.pair_word[1:] != self.pair_word[:-1]) | (self.pair_part[1:] != self.pair_part[:-1]))))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of a task's texts (columns: id, text, training). A block is numbered by its task and place there."""
    base = TaskContext.get().partitionId() << 24
    done = row = 0
    block = Block(base)
    for batch in batches:
        block.id_type = batch.column(0).type
        for lo in range(0, batch.num_rows, 64):
            piece = batch.slice(lo, 64)
            ids, texts, training = (piece.column(i).to_pylist() for i in range(3))
            for a, b in _words.batches(texts):
                words = _words.Words(texts[a:b], lower=True)
                for i in range(a, b):
                    own = words.hash[words.bounds[i - a] : words.bounds[i - a + 1]]
                    tokens = np.append(own, END)
                    for at in range(0, len(tokens), BLOCK):
                        block.add((base << 16) + row, ids[i], bool(training[i]), tokens[at : at + BLOCK], tokens[at - 1] if at else BEGIN)
                        if block.size >= BLOCK:
                            yield block
                            done += 1
                            block = Block(base + done, block.id_type)
                    row += 1
    if block.size:
        yield block
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- the stages


def token_totals(texts: DataFrame) -> tuple[int, dict[int, int]]:
    """The number of tokens, and the training tokens of words that may be hot: those with more than HOT_SHARE of a block.
    Each task sends at most 1 / HOT_SHARE of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            training = np.repeat([t[2] for t in block.texts], block.lengths)
            word, count = np.unique(block.tokens()[training], return_counts=True)
            often = count > max(1, HOT_SHARE * block.size)
            words, counts = np.append(word[often].view(np.int64), 0), np.append(count[often], block.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(often.sum(), bool), True)), pa.array(words), pa.array(counts)], names=["every", "word", "n"])

    sums = map_arrow(texts, run, "every boolean, word long, n long").groupBy("every", "word").agg(F.sum("n").alias("n"))
    total = sums.where("every").agg(F.sum("n")).first()[0] or 0
    return total, {r.word: r.n for r in sums.where(~F.col("every") & (F.col("n") > HOT_SHARE * total)).collect()}


def block_pairs(texts: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """(part, block, raw): the pairs of a block that belong to a part, by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            block.pairs(hot, parts)
            runs = block.runs()
            edges = np.searchsorted(block.pair_part, np.arange(parts + 1))
            held = np.flatnonzero(edges[1:] > edges[:-1])
            raws = []
            for p in held:
                a, b = edges[p], edges[p + 1]
                own = runs[np.searchsorted(runs, a) : np.searchsorted(runs, b)]
                raws.append(pack(block.pair_word[own], narrow(np.diff(np.append(own, b))), six_bytes(block.pair_before[a:b]), *few(block.pair_training[a:b]), np.array([block.check], "<u4")))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([block.number] * len(held), pa.int64()), pa.array(raws, pa.binary())], names=["part", "block", "raw"])

    return map_arrow(texts, run, "part int, block long, raw binary")


def block_places(texts: DataFrame, id_kind: str, hot: np.ndarray, parts: int) -> DataFrame:
    """(block, ids, raw): which texts of a block have which of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            block.pairs(hot, parts)
            runs = block.runs()
            raw = pack(
                np.array([t[0] for t in block.texts], "<i8"), np.diff(np.append(runs, len(block.pair_word))).astype("<u4"), *few(block.pair_tokens), narrow(block.token_text), np.array([block.check], "<u4")
            )
            yield pa.RecordBatch.from_arrays([pa.array([block.number], pa.int64()), pa.array([[t[1] for t in block.texts]], pa.list_(block.id_type)), pa.array([raw], pa.binary())], names=["block", "ids", "raw"])

    return map_arrow(texts, run, f"block long, ids array<{id_kind}>, raw binary")


class Part:
    """The pairs of a part, added up over its blocks and seated."""

    def __init__(self, rows: pa.Table, hot: np.ndarray, parts: int, s: Settings):
        self.number = rows.column("part")[0].as_py()
        order = np.argsort(rows.column("block").to_numpy(), kind="stable")
        raws = rows.column("raw")
        self.blocks, read = rows.column("block").to_numpy()[order], [unpack(raws[i].as_py()) for i in order.tolist()]
        self.run_words, self.checks = [r[0] for r in read], [int(r[5][0]) for r in read]
        self.run_lengths = [r[1].astype(np.int64) for r in read]
        word = np.concatenate([np.repeat(w, n) for w, n in zip(self.run_words, self.run_lengths, strict=True)])
        before = np.concatenate([of_six(r[2]) for r in read])
        count = np.concatenate([of_few(r[3], r[4]) for r in read])
        del read
        self.words, w = np.unique(word, return_inverse=True)
        self.contexts, u = np.unique(before, return_inverse=True)
        pairs, self.pair = np.unique(w.astype(np.int64) << 32 | u, return_inverse=True)
        self.w, self.u = pairs >> 32, pairs & 0xFFFFFFFF
        self.count = np.bincount(self.pair, count, len(pairs))
        self.word_count = np.bincount(self.w, self.count, len(self.words))
        self.spread = np.isin(self.words, hot)
        held = np.flatnonzero(self.count)
        rest, tables, self.word_rest, self.customers, self.tables = seat(self.w[held], self.u[held], self.count[held], self.spread, parts, self.number, s)
        self.rest = np.zeros(len(pairs))
        self.rest[held] = rest
        self.context_tables = np.zeros(len(self.contexts))
        self.context_tables[: len(tables)] = tables
        self.context_count = np.bincount(self.u, self.count, len(self.contexts))
        # what all parts sum up: [totals, the shared restaurant, each context, each hot word]
        hot_here = np.flatnonzero(self.spread)
        one = _U64(1)
        self.ids = np.concatenate((np.array([0, 1], _U64), self.contexts << one | _U64(1 << 62), self.words[hot_here] | one | _U64(1 << 63)))
        known = int((self.word_count[~self.spread] > 0).sum())
        self.customers_of = np.concatenate(([self.count.sum(), self.customers], self.context_count, self.word_count[hot_here]))
        self.tables_of = np.concatenate(([known, self.tables], self.context_tables, self.word_rest[hot_here]))
        self.hot_here = hot_here

    def owners(self, parts: int) -> np.ndarray:
        """The part that sums up each id."""
        return ((_words.mix(self.ids) >> _U64(20)) % _U64(parts)).astype(np.int64)


def score_texts(
    docs: DataFrame, training: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", max_parts: int | None = None
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of all texts, by a model of those with ``training``.
    ``base_score``: log10 by the frequencies of single words with 0.5 added; ``score``: the model's log10 probability."""
    kind, out_id = docs.schema[id_col].dataType.simpleString(), own_name(id_col, OUT)
    texts = docs.select(F.col(id_col), F.col(text_col), F.coalesce(training, F.lit(False)))
    total, often = token_totals(texts)
    parts = max(1, min(-(-total // PART), max_parts or 1 << 24))
    share = max(HOT_SHARE, 1 / (4 * parts)) * total
    hot = np.array(sorted(w for w, n in often.items() if n > share), np.int64).view(_U64)
    s, n_hot = settings, len(hot)

    def sums_sent(rows: pa.Table) -> pa.Table:
        part = Part(rows, hot, parts, s)
        owner = part.owners(parts)
        order = np.argsort(owner, kind="stable")
        owners, starts = np.unique(owner[order], return_index=True)
        raws = [pack(part.ids[x], part.customers_of[x], part.tables_of[x]) for x in np.split(order, starts[1:])]
        return pa.table([pa.array(owners, pa.int32()), pa.array([part.number] * len(owners), pa.int32()), pa.array(raws, pa.binary())], names=["owner", "part", "raw"])

    def sums_made(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("part").to_numpy(), kind="stable").tolist()
        read = [unpack(rows.column("raw")[i].as_py()) for i in order]
        _, at = np.unique(np.concatenate([r[0] for r in read]), return_inverse=True)
        customers, tables = (np.bincount(at, np.concatenate([r[k] for r in read]))[at] for k in (1, 2))
        edges = np.cumsum([0, *(len(r[0]) for r in read)])
        raws = [pack(customers[a:b], tables[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        owner = rows.column("owner")[0].as_py()
        return pa.table([pa.array([rows.column("part")[i].as_py() for i in order], pa.int32()), pa.array([owner] * len(order), pa.int32()), pa.array(raws, pa.binary())], names=["part", "owner", "raw"])

    def answered(rows: pa.Table, sums: pa.Table) -> pa.Table:
        part = Part(rows, hot, parts, s)
        order = np.argsort(part.owners(parts), kind="stable")
        read = [unpack(sums.column("raw")[i].as_py()) for i in np.argsort(sums.column("owner").to_numpy(), kind="stable").tolist()]
        customers, tables = (np.empty(len(order)) for _ in range(2))
        customers[order], tables[order] = (np.concatenate([r[k] for r in read]) for k in (0, 1))
        n_contexts = len(part.contexts)
        train_tokens, known, root_customers, root_tables = customers[0], tables[0] + n_hot, customers[1], tables[1]
        of_context, context_tables = customers[2 : 2 + n_contexts], tables[2 : 2 + n_contexts]
        word_count, word_rest = part.word_count.copy(), part.word_rest.copy()
        word_count[part.hot_here], word_rest[part.hot_here] = customers[2 + n_contexts :], tables[2 + n_contexts :]
        below = (s.root_strength + s.root_discount * root_tables) / (known + 1)
        parent = (word_rest + below) / (s.root_strength + root_customers)
        chance = (part.rest + (s.strength + s.discount * context_tables[part.u]) * parent[part.w]) / (s.strength + of_context[part.u])
        log = np.log10(chance).astype("<f4")[part.pair]
        raws, at = [], 0
        totals = np.array([train_tokens, known], "<f8")
        for words, lengths, check in zip(part.run_words, part.run_lengths, part.checks, strict=True):
            n = int(lengths.sum())
            counts = narrow(word_count[np.searchsorted(part.words, words)].astype(np.int64))
            raws.append(pack(log[at : at + n], counts, totals, np.array([check], "<u4")))
            at += n
        return pa.table([pa.array(part.blocks, pa.int64()), pa.array([part.number] * len(raws), pa.int32()), pa.array(raws, pa.binary())], names=["block", "part", "raw"])

    def added_up(places: pa.Table, answers: pa.Table) -> pa.Table:
        rows, lengths, *tokens, text, check = unpack(places.column("raw")[0].as_py())
        read = [unpack(answers.column("raw")[i].as_py()) for i in np.argsort(answers.column("part").to_numpy(), kind="stable").tolist()]
        if any(r[3][0] != check[0] for r in read) or sum(len(r[0]) for r in read) != int(lengths.sum()):
            raise RuntimeError("the table of texts gave other rows when it was read again")
        tokens = of_few(*tokens)
        train_tokens, known = read[0][2].tolist()
        count = np.repeat(np.concatenate([r[1].astype(np.float64) for r in read]), lengths)
        base = np.log10((count + 0.5) / (train_tokens + 0.5 * (known + 1)))
        of_text = lambda values: np.bincount(text, np.repeat(values, tokens), len(rows))
        n_tokens = np.bincount(text, minlength=len(rows))
        columns = [pa.array(n_tokens), pa.array(of_text(count > 0).astype(np.int64)), pa.array([int(train_tokens)] * len(rows), pa.int64())]
        columns += [pa.array(of_text(x)) for x in (base, np.concatenate([r[0] for r in read]).astype(np.float64))]
        return pa.table([pa.array(rows, pa.int64()), places.column("ids").chunk(0).flatten(), *columns], names=["row", out_id, *OUT])

    pairs = block_pairs(texts, hot, parts)
    sent = pairs.groupBy("part").applyInArrow(sums_sent, "owner int, part int, raw binary")
    sums = sent.groupBy("owner").applyInArrow(sums_made, "part int, owner int, raw binary")
    answers = pairs.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(answered, "block long, part int, raw binary")
    schema = f"row long, `{out_id}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    places = block_places(texts, kind, hot, parts)
    scored = places.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(added_up, schema)
    # a text that lies in several blocks is one row again
    add = {"n_tokens": F.sum, "n_known": F.sum, "train_tokens": F.max, "base_score": F.sum, "score": F.sum}
    return scored.groupBy("row").agg(F.first(out_id).alias(out_id), *(f(c).alias(c) for c, f in add.items())).drop("row")


def perplexity(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row: the perplexity per token of scored texts."""
    return scored.agg(F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens")).alias("perplexity"))
