"""Words of a whole text and their rolling hashes, in numpy.

A word is a run of characters other than space and tab to carriage return. All functions work on the UTF-8 bytes of one
text, so their memory is bounded by the longest text.
"""

from __future__ import annotations

import functools

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
STEP = np.uint64(0xD1342543DE82EF95)
#: Bytes whose hashes are summed at a time, and so the length of the tables that a worker keeps.
BLOCK = 1 << 18


def utf8(text: str | None, fold: bool = False) -> np.ndarray:
    """The bytes of a text; ``fold`` lower-cases A-Z only."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return _FOLD[raw] if fold else raw


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    solid = np.zeros(len(raw) + 2, bool)
    np.logical_not(_SPACE[raw], out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    steps = np.full(n, _BASE)
    steps[0] = 1
    powers = np.multiply.accumulate(steps)
    steps[1:] = _BASE_INVERSE
    return powers, np.multiply.accumulate(steps)


_kept_powers = functools.lru_cache(maxsize=1)(lambda: _powers(BLOCK + 1))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of one running polynomial hash over the bytes of a block of words.

    The inverse power takes away where in its block a word stands, so blocks don't show in the hashes.
    """
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        first = starts[at]
        until = max(at + 1, int(np.searchsorted(ends, first + BLOCK, side="right")))  # a longer word is a block of its own
        part = raw[first:ends[until - 1]]
        powers, inverses = _kept_powers() if len(part) <= BLOCK else _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[:len(part)], out=total[1:])
        a, b = starts[at:until] - first, ends[at:until] - first
        out[at:until] = mix((total[b] - total[a]) * inverses[a] + (b - a).astype(np.uint64))
        at = until
    return out


def longer(grams: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Rolls the hashes of all (n-1)-grams on to those of all n-grams."""
    return grams[:-1] * STEP + words[n - 1:]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows; none if there are fewer words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    grams = words
    for k in range(2, n + 1):
        grams = longer(grams, words, k)
    return mix(grams + np.uint64(n))
