"""Words, lines and shingles of Arrow text batches as numpy arrays.

A word is a maximal run of characters other than space and U+0009 to U+000D. Those six never occur inside a longer
UTF-8 sequence, so bytes can be split without decoding. Hashes are 64-bit: a polynomial over random byte values, taken
from prefix sums, and a final mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
SHINGLE_WEIGHTS = (_rng.integers(1, 2**63, 64, dtype=np.int64).astype(U) << U(1)) | U(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept and grown as longer texts come."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(m, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (one more entry than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def slices(texts: pa.Array, most: int = 1 << 19):
    """Row ranges of about ``most`` bytes each, so that working arrays stay small; a longer text is a range of its own."""
    _, offsets = text_bytes(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of some texts: ``start`` and ``end`` are byte places in ``raw``; the words of text i are [first[i], first[i+1])."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.raw, self.offsets, self.lower = raw, offsets, lower
        word = ~IS_SPACE[raw]
        before = np.empty(len(raw), bool)
        before[1:] = word[:-1]
        after = np.empty(len(raw), bool)
        after[:-1] = word[1:]
        inside = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[inside] = False
        ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        after[ends] = False
        self.word = word
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            up, _ = powers(len(self.raw) + 1)
            self._sums = np.zeros(len(self.raw) + 1, U)
            np.cumsum((LOWER_VALUES if self.lower else BYTE_VALUES)[self.raw] * up[: len(self.raw)], out=self._sums[1:])
        return self._sums

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, end) of each span; equal bytes, equal hashes, wherever they are."""
        _, down = powers(len(self.raw) + 1)
        h = (self.sums[end] - self.sums[start]) * down[start]
        return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def text_of(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-word window and the number of its first word; windows do not cross texts."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(m, U)
    for k in range(n):
        h += mix(hashes[k : k + m] + SHINGLE_WEIGHTS[k]) * SHINGLE_WEIGHTS[n + k]
    whole = np.ones(m, bool)
    cut = first[1:-1]
    for k in range(1, n):
        at = cut - k
        whole[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(whole)
    return mix(h[at]), at


def shingle_sets(texts: pa.Array, n: int):
    """Sorted distinct hashes of the n-word shingles of each text, lower-cased in A-Z.

    A text of fewer words has its whole word sequence as its one shingle; a text without words has none.
    """
    for lo, hi in slices(texts):
        raw, offsets = text_bytes(texts.slice(lo, hi - lo))
        words = Words(raw, offsets)
        hashes = words.hashes()
        h, at = windows(hashes, words.first, n)
        begin = np.searchsorted(at, words.first)
        for i in range(hi - lo):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= n:
                yield np.unique(h[begin[i] : begin[i + 1]])
            elif b > a:
                few = hashes[a:b]
                yield mix((few * SHINGLE_WEIGHTS[32 : 32 + len(few)]).sum(keepdims=True) + np.array([len(few)], U) * SHINGLE_WEIGHTS[63:])
            else:
                yield np.zeros(0, U)
