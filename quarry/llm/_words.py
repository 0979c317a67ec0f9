"""Vectorised word hashing of batches of texts (numpy, inside Spark tasks).

Words are maximal runs of bytes other than space and U+0009 to U+000D, so UTF-8 text is cut exactly as by
``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text hashed at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 18
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, at least n of each."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        base, size = _BASES[kind], max(n, BATCH_BYTES + 4096)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > 4 * BATCH_BYTES:  # a very long text: not kept
            return both[0], both[1]
        _powers[kind] = (both[0], both[1])
    return _powers[kind]


class Words:
    """The words of a batch of texts: byte offsets (starts, ends), hashes, and the range of words of each text."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = b" ".join(parts) + b" "
        raw = np.frombuffer(self.bytes, np.uint8)
        gap = SEPARATOR[raw]
        before = np.empty_like(gap)
        before[0], before[1:] = True, gap[:-1]
        self.starts = np.flatnonzero(~gap & before)
        self.ends = np.flatnonzero(gap & ~before)
        up, down = powers("byte", len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[raw] if lower else raw] * up[: len(raw)], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        self.text_starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.bounds = np.searchsorted(self.starts, self.text_starts)

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 places of the batch have none."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if k <= 8:
            up, _ = powers("word", k)
            out = self.hash[:n] * up[0]
            for j in range(1, k):
                out = out + self.hash[j : n + j] * up[j]
        else:
            up, down = powers("word", len(self.hash))
            total = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(self.hash * up[: len(self.hash)], out=total[1:])
            out = (total[k:] - total[:-k]) * down[:n]
        return mix(out + np.uint64(k))

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from begin up to end, for each pair."""
        up, down = powers("word", len(self.hash))
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[: len(self.hash)], out=total[1:])
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_BYTES each."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > BATCH_BYTES:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
