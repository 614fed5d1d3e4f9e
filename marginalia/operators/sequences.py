"""Longest common subsequence of two token sequences, and the overlap measures built on it (ROUGE-L)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from marginalia.functions.text import safe_ratio, terms

# Places of the longer sequence that one integer holds a bit for.
BLOCK = 4096


def lcs_length(a: Sequence[int], b: Sequence[int], block: int = BLOCK) -> int:
    """Length of the longest common subsequence, by dynamic programming with a column of the table in the bits of a number.

    The longer sequence is cut into blocks. For each, a row of the table is one addition: bits that are 0 mark the places
    where the length goes up, and what the addition carries out of the block enters the next one at the same row. Memory
    is one carry per token of the shorter sequence and the masks of one block.
    """
    shorter, longer = (a, b) if len(a) <= len(b) else (b, a)
    carries = bytearray(len(shorter))
    length = 0
    for at in range(0, len(longer), block):
        part = longer[at:at + block]
        masks: dict[int, int] = defaultdict(int)
        for i, token in enumerate(part):
            masks[token] |= 1 << i
        width = len(part)
        full = row = (1 << width) - 1
        for i, token in enumerate(shorter):
            met = row & masks[token] if token in masks else 0
            if met or carries[i]:
                total = row + met + carries[i]
                carries[i] = total >> width
                row = (total & full) | (row & ~met)
        length += width - row.bit_count()
    return length


@F.arrow_udf(T.LongType())
def _lengths(left: pa.Array, right: pa.Array) -> pa.Array:
    tokens = [side.flatten() for side in (left, right)]
    ids = pa.concat_arrays(tokens).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = [np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False))))
            for side in (left, right)]
    cuts[1] = cuts[1] + len(tokens[0])
    return pa.array([lcs_length(ids[a:b].tolist(), ids[c:d].tolist())
                     for a, b, c, d in zip(cuts[0][:-1], cuts[0][1:], cuts[1][:-1], cuts[1][1:])], pa.int64())


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of strings; 0 where one is NULL or empty."""
    return _lengths(a, b)


def rouge_l(candidate: Column, reference: Column, beta: float = 1.0) -> Column:
    """struct<lcs, precision, recall, f> of the terms of a text against those of a reference, by their order."""
    a, b = terms(F.coalesce(candidate, F.lit(""))), terms(F.coalesce(reference, F.lit("")))
    measured = F.struct(longest_common(a, b).alias("lcs"), F.size(a).alias("n"), F.size(b).alias("m"))
    # the struct is made once: a worker is asked for each pair of texts a single time
    return F.transform(F.array(measured), lambda x: F.struct(
        x["lcs"].alias("lcs"), safe_ratio(x["lcs"], x["n"]).alias("precision"), safe_ratio(x["lcs"], x["m"]).alias("recall"),
        safe_ratio((1 + beta ** 2) * x["lcs"], x["n"] + beta ** 2 * x["m"]).alias("f")))[0]
