"""Quality rules on repetition: rolling hashes of several n-gram lengths measure the characters inside duplicated n-grams.

A text is hashed once per word; the hashes of (n-1)-word windows are rolled on to n words. Only windows that were
duplicated at one length can be at the next, so after the shortest length few are left to compare. The shares of the verdict
count the characters of words in windows, and in lines, that the text has had before, each once; so a passage said twice
counts once. ``n_repeat_words`` counts the words of all windows found twice or more, the first finding included.

Everything is computed inside the row, from the whole text: no shuffle; memory is a small multiple of the longest text.

Defined results: a null or empty text has no words, all counts and shares 0, ``base_failed`` true; a text shorter than a
window has no coverage at that length; an empty table gives no rows; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from marginalia.llm import words as W
from marginalia.llm.batches import over_rows

#: The largest share of word characters that may lie in repeats of earlier n-grams, by n, and of earlier lines.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
_BLANK = " \t\n\x0b\x0c\r"

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, "
            + ", ".join(f"dup_{n}gram_share double" for n in GRAM_LIMITS) + ", base_failed boolean, kept boolean")


def repeated(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks the values that occur twice or more, and of those the ones that have occurred before."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    twin, later = np.zeros(len(grams), bool), np.zeros(len(grams), bool)
    if len(grams) > 1:
        same = ranked[1:] == ranked[:-1]
        later[order[1:]] = same
        twin[order[1:]] = same
        twin[order[:-1]] |= same
    return twin, later


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Marks the words inside the n-word windows that begin at ``starts``."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def gram_coverage(hashes: np.ndarray, lengths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each n of ``lengths`` (rising), marks the words inside duplicated n-word windows, and inside repeats of earlier ones."""
    total, marks = len(hashes), {}
    spots = np.arange(total)  # window starts that were duplicated at the last length; at first all
    grams, n = hashes, 1
    for length in lengths:
        for n in range(n + 1, length + 1):
            keep = spots <= total - n
            spots, grams = spots[keep], grams[keep]
            grams = grams * W.STEP + hashes[spots + n - 1]
        n = length
        twin, later = repeated(W.mix(grams))
        again, spots, grams = spots[later], spots[twin], grams[twin]
        marks[length] = covered(spots, length, total), covered(again, length, total)
    return marks


def measure(text: str | None) -> tuple:
    """The values of ``MEASURES`` for one text."""
    text = text or ""
    raw = W.utf8(text)
    starts, ends = W.bounds(raw)
    n = len(starts)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
    size = points[ends] - points[starts]
    chars = int(size.sum())
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup_lines, dup_line_chars = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(map(len, line.translate(_TO_SPACE).split(" ")))
            else:
                seen.add(line)
    marks = gram_coverage(W.word_hashes(raw, starts, ends), list(GRAM_LIMITS))
    repeat_words = int(marks[WINDOW][0].sum())
    shares = {k: float(size[again].sum() / chars) if chars else 0.0 for k, (_, again) in marks.items()}
    line_share = dup_line_chars / chars if chars else 0.0
    failed = n < LEAST_WORDS or 100 * repeat_words > REPEAT_PERCENT * n
    kept = not failed and line_share <= LINE_LIMIT and all(shares[k] <= most for k, most in GRAM_LIMITS.items())
    return (n, chars, symbols, dup_lines, repeat_words, line_share, *shares.values(), failed, kept)


_TO_SPACE = str.maketrans({c: " " for c in _BLANK})


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measures of its whole text and the verdict."""
    return over_rows(docs, [id_col], [text_col], MEASURES, lambda: measure)
