"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces by the tokenizer's pattern; a piece begins as one symbol per byte. The symbols form a linked list,
and a heap holds each adjacent pair that has a merge, lowest rank first, the leftmost first among equal ones. The pair on
top merges in place, and its two new neighbours enter the heap; an entry whose symbols have changed since is passed over.
The count of a piece is its symbols at first less its merges, so no token is ever named. Counts of short pieces, and of short
words with the space before them, are kept in tables of bounded size; a piece of any length is merged whole, in time n log n.

The work is inside the row: no shuffle, memory bounded by the longest text.

Defined results: null and empty texts have 0 bytes and 0 tokens; the string of a special token inside a text is one token,
as the library reads it by default; repeated rows and ids give repeated results; other columns are not read, so their
names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

import regex
from pyspark.sql import DataFrame

from marginalia.llm.batches import over_rows

LIMIT = 512
VOCABULARY = "byte_bpe_50k.json"
#: Entries of a table of counts, and their longest.
KEPT, KEPT_LENGTH = 1 << 17, 40
#: Characters beyond which pieces are read one by one instead of as a list.
STREAMED = 1 << 20
#: No piece reaches over a space between two characters that aren't white space; it begins the next one.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_BITS = 32  # of a heap entry, for the place of its pair
_PLACE = (1 << _BITS) - 1


class Merges(NamedTuple):
    ranks: dict[tuple[int, int], int]  # by the pair of symbols
    made: list[int]  # symbol that the merge of each rank makes
    first: list[int]  # symbol of each byte


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it shows, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def merges_of(model: dict) -> Merges:
    """The merges of a byte-level model, as its file states them."""
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = model["vocab"]
    return Merges({(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}, [ids[a + b] for a, b in pairs],
                  [ids[letter] for letter in byte_letters()])


def count_merged(raw: bytes, merges: Merges) -> int:
    """Tokens of one piece."""
    symbols = [merges.first[b] for b in raw]
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks, push, pop = merges.ranks, heapq.heappush, heapq.heappop
    found = map(ranks.get, zip(symbols, symbols[1:]))
    heap = [rank << _BITS | i for i, rank in enumerate(found) if rank is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        top = pop(heap)
        rank, i = top >> _BITS, top & _PLACE
        j = after[i]
        if j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has merged since
        symbols[i], symbols[j] = merges.made[rank], -1
        after[i] = follower = after[j]
        left -= 1
        if follower < n:
            before[follower] = i
            if (rank := ranks.get((symbols[i], symbols[follower]))) is not None:
                push(heap, rank << _BITS | i)
        leader = before[i]
        if leader >= 0 and (rank := ranks.get((symbols[leader], symbols[i]))) is not None:
            push(heap, rank << _BITS | leader)
    return left


class _Kept(dict):
    """Counts by string, made when first asked for; a full table becomes the old one, from which strings in use come back."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self._count, self._old = count, {}

    def __missing__(self, key: str) -> int:
        if (n := self._old.get(key)) is None:
            n = self._count(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self._old = dict(self)
                self.clear()
            self[key] = n
        return n


class Counter:
    """Counts the tokens of texts by a byte-level tokenizer file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        shape = told.get("pre_tokenizer") or {}
        plain = shape.get("type") == "ByteLevel" and shape.get("use_regex") and not shape.get("add_prefix_space")
        if told["model"].get("type") != "BPE" or not plain or told.get("normalizer") or told["model"].get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        special = told.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError(f"{path} has tokens that take in their surroundings")
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._pieces = regex.compile(pattern)
        merges = merges_of(told["model"])
        self._of_piece = _Kept(lambda piece: count_merged(piece.encode("utf-8", "surrogatepass"), merges))
        self._of_word = _Kept(lambda word: self._cut(" " + word))

    def _cut(self, text: str) -> int:
        pieces: Iterable[str] = self._pieces.findall(text) if len(text) < STREAMED else \
            (found[0] for found in self._pieces.finditer(text))
        return sum(map(self._of_piece.__getitem__, pieces))

    def _plain(self, text: str) -> int:
        first, *words = BETWEEN.split(text)
        return self._cut(first) + sum(map(self._of_word.__getitem__, words))

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        parts = self._special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@functools.lru_cache(maxsize=2)  # once per worker, not per task
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None, pattern: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; the tokenizer file must be at ``path`` on every executor."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def work():
        tokens = counter(path, pattern).tokens

        def told(text: str | None) -> tuple[int, int, bool]:
            n = tokens(text)
            return len((text or "").encode("utf-8", "surrogatepass")), n, n > limit
        return told

    return over_rows(docs, [id_col], [text_col], "n_bytes long, n_tokens long, over_limit boolean", work)
