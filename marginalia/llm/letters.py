"""Letters of a whole text as code points, for models on character n-grams."""

from __future__ import annotations

import functools
import sys

import numpy as np


@functools.cache
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def codes(text: str | None) -> np.ndarray:
    """Lower-case letters as code points; every run of other characters is one 0, and one 0 stands at both ends."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    framed = np.zeros(len(points) + 2, np.uint32)
    framed[1:-1] = np.where(_letter_table()[points], points, 0)
    keep = np.ones(len(framed), bool)
    keep[1:] = (framed[1:] != 0) | (framed[:-1] != 0)
    out = framed[keep]
    return out if len(out) == 1 or out[-1] == 0 else np.append(out, np.uint32(0))


_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 3812015801], np.uint32)


def gram_buckets(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Buckets of all n-grams of a code array, each from its characters and its length."""
    count = max(0, len(points) - n + 1)
    h = np.full(count, (n * 0x9E3779B1) & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h = (h ^ (points[j:j + count] * _FACTORS[j])) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - bits)).astype(np.int64)
