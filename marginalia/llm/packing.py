"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents become token ids plus an end id, cut every ``LENGTH`` ids into pieces; each piece is known by its length alone,
so packing needs only the histogram of lengths (at most ``LENGTH`` numbers, whatever the input). Lengths are placed longest
first. A pattern is a way to fill a sequence, with the number of sequences filled that way; a length goes to the shortest
patterns (those with the most room left), whose counts split when fewer pieces remain. The patterns then join back to
pieces by rank among the pieces of equal length.

Ranks come from counts per bucket of a hash and a numbering inside each bucket, so neither a frequent length nor the table
meets one task. Token ids are read once; a piece carries only their checksum.

Defined results: null and empty texts are one piece of the end id alone; repeated rows and repeated ids are packed as
documents of their own; an empty table gives no rows; the text of a special token is read as the tokenizer reads it.
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.batches import over_rows
from marginalia.session import settle

LENGTH, END_ID, BUCKETS = 2048, 1, 1024
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the text of the vocabulary's one special token.
SPECIAL = "<|endoftext|>"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)  # once per worker, not per task
def _tokenizer(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@functools.lru_cache(maxsize=2)
def _ranks(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(json_path: str, ranks_path: str | None = None):
    """A function from a text to its ids as the tokenizer file gives them.

    The ranks file holds the same vocabulary for a faster reader of it, which gives equal ids on texts without special
    tokens; other texts go through the tokenizer itself, as all do if there is no ranks file. A worker loads each of the two
    once, when a text first needs it.
    """
    def ids(text: str):
        if ranks_path is None or SPECIAL in text:
            return _tokenizer(json_path).encode(text, add_special_tokens=False).ids
        return _ranks(ranks_path).encode_to_numpy(text, disallowed_special=())
    return ids


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, json_path: str | None = None,
           ranks_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), one row per piece of at most ``length`` ids."""
    json_path = json_path or vocabulary_path(f"{VOCABULARY}.json")
    ranks_path = ranks_path or vocabulary_path(f"{VOCABULARY}.tiktoken")

    def work():
        encode = encoder(json_path, ranks_path)

        def cut(text: str | None) -> tuple[int, list[int]]:
            ids = np.append(np.asarray(encode(text or ""), "<u4"), np.uint32(end_id)).astype("<u4")
            return len(ids), [zlib.crc32(ids[i:i + length].tobytes()) for i in range(0, len(ids), length)]
        return cut

    cut = over_rows(docs, ["doc_id"], ["text"], "doc_tokens long, sums array<bigint>", work)
    told = cut.select("doc_id", "doc_tokens", F.posexplode("sums").alias("i", "ids_crc32"))
    start = F.col("i").cast("long") * length
    return told.select("doc_id", start.alias("start"), F.least(F.lit(length), F.col("doc_tokens") - start).alias("length"),
                       "ids_crc32", "doc_tokens")


def pack_patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(pattern, number of sequences) for counts of piece lengths; a pattern is (length, times) runs, longest first."""
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    waiting: dict[int, list[tuple[tuple, int]]] = defaultdict(list)  # room left -> patterns with their counts
    rooms: list[int] = []  # negatives of the rooms in use, as a heap

    def put(room: int, pattern: tuple, count: int) -> None:
        if count and not room:
            done.append((pattern, count))
        elif count:
            if not waiting[room]:
                heapq.heappush(rooms, -room)
            waiting[room].append((pattern, count))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and rooms and -rooms[0] >= size:
            room = -rooms[0]
            pattern, count = waiting[room].pop()
            if not waiting[room]:
                heapq.heappop(rooms)
            used = min(count, left)
            put(room, pattern, count - used)
            *before, (last, times) = pattern
            longer = (*before, (last, times + 1)) if last == size else (*pattern, (size, 1))
            put(room - size, longer, used)
            left -= used
        # not even the shortest pack has room: piece by piece, each new pack would stay the shortest until it is full
        each = length // size
        put(length - size * each, ((size, each),), left // each)
        if left % each:
            put(length - size * (left % each), ((size, left % each),), 1)
    return done + [entry for entries in waiting.values() for entry in entries]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, tuple]:
    """For each length: first ranks, times in a row, first sequence and first offset of its runs, in order of rank."""
    runs, base, ranks = defaultdict(list), 0, defaultdict(int)
    for pattern, count in patterns:
        offset = 0
        for size, times in pattern:
            runs[size].append((ranks[size], times, base, offset))
            ranks[size] += times * count
            offset += size * times
        base += count
    return {size: tuple(np.array(c, np.int64) for c in zip(*rows)) for size, rows in runs.items()}


def place(ranked: DataFrame, table: dict[int, tuple]) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a ``rank`` (from 0) among those of their length."""
    shared = ranked.sparkSession.sparkContext.broadcast(table)  # bounded by the histogram's patterns
    schema = ranked.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = shared.value
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, times, base, begin = by_size[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                inside = rank[at] - first[k]
                sequence[at] = base[k] + inside // times[k]
                offset[at] = begin[k] + inside % times[k] * s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)],
                                             names=[*batch.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, json_path: str | None = None,
         ranks_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of (doc_id, text)."""
    cut = pieces(docs, length, end_id, json_path, ranks_path)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    cut = settle(cut)
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("found"))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("found").over(ahead), F.lit(0)))
    histogram = {r["length"]: r["found"] for r in counts.groupBy("length").agg(F.sum("found").alias("found")).collect()}
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.join(counts.drop("found"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(inside) - 1).drop("before", "bucket")
    placed = place(ranked, slots(pack_patterns(histogram, length)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
