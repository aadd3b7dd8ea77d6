"""Vectorised helpers over the UTF-8 bytes of one text.

Words, shingles and byte windows are hashed with one polynomial prefix sum modulo
2**64: any range of a text then costs one subtraction and one product, so no operator
of this subpackage loops over the bytes or shingles of a text in Python.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[tuple[int, str], np.ndarray] = {}

#: A-Z lower-cased; bytes of words 0-9, a-z and 0x80 upwards kept; all others to space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: A-Z lower-cased; tab to carriage return to space.
SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    if len(_tables.get((base, "up"), ())) <= n:
        size = 1 << max(16, n.bit_length() + 1)
        for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
            table = np.full(size, x, np.uint64)
            table[0] = 1
            _tables[base, name] = np.cumprod(table, dtype=np.uint64)
    return _tables[base, "up"], _tables[base, "down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHash:
    """64-bit hashes of byte ranges of one text; equal ranges of any texts hash alike."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        up, self._down = _powers(len(data), base)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all ranges of q bytes."""
        n = len(self._sums) - q
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self._sums[q:] - self._sums[:n]) * self._down[:n] + np.uint64(q))


def slices(batches, rows: int = 2048):
    """Arrow batches cut to `rows` rows, for functions that hold much more than a batch's texts."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def words_of(data: bytes | None, table: bytes) -> list[bytes]:
    """Words of a text after `table` (ALNUM or SPACED); null has none."""
    return data.translate(table).split() if data else []


def bounds(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each starts and ends there."""
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.zeros(len(words), np.int64)
    ends = np.full(len(words), len(joined), np.int64)
    if len(words) > 1:
        starts[1:] = gaps + 1
        ends[:-1] = gaps
    return joined, starts, ends


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of all runs of k words in order, or of the whole text if it has fewer; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, starts, ends = bounds(words)
    k = min(k, len(words))
    return RangeHash(np.frombuffer(joined, np.uint8))(starts[: len(words) - k + 1], ends[k - 1 :])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w entries, by doubling; empty if there are fewer."""
    if len(h) < w:
        return h[:0]
    have, span = h, 1
    while span * 2 <= w:
        have = np.minimum(have[: len(have) - span], have[span:])
        span *= 2
    rest = w - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w entries the index of its leftmost minimum."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, value, span = np.arange(len(h)), h, 1

    def least(a, va, b, vb):
        later = vb < va
        return np.where(later, b, a), np.where(later, vb, va)

    while span * 2 <= w:
        at, value = least(at[:-span], value[:-span], at[span:], value[span:])
        span *= 2
    rest = w - span
    if rest:
        at, value = least(at[:-rest], value[:-rest], at[rest:], value[rest:])
    return at


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of some window of w entries (all of them if shorter): equal runs of w entries of any two texts share one."""
    if len(h) <= w:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    least = sliding_min(h, w)
    pad = np.full(w - 1, 0, np.uint64)
    covering = ~sliding_min(~np.concatenate([pad, least, pad]), w)
    return np.flatnonzero(covering == h)
