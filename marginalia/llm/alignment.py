"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and how often ids meet.

Both tokenizers' tokens become arrays of end offsets. Diagonal run skipping: with the current shift between the two
indexes, runs of doubled length are compared as slices of the end arrays; as long as they are equal, tokens meet one to one
and are jumped. The slice that differs is walked to its first difference. There the irregular group is resolved token by
token, and the shift becomes that of its end.

Documents are read once, in blocks of bounded size. A block names its different id pairs once, and a document holds
places in that list. Pairs are counted over all blocks by an aggregate that combines first; the counts return to the blocks
by joins that adaptive execution can split, and a block's documents read their sums from its list. So a frequent pair costs
one row per block, and nothing is broadcast or held whole.

Defined results: texts that are null or empty, or of which one tokenizer's bytes differ from the space and the text, have
no tokens: zeros and an empty digest; strings of special tokens are plain text; repeated rows and ids are documents of
their own, null ids too; other columns are not read, so their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from marginalia.session import scratch_path

FIRST, SECOND = "byte_bpe_50k", "piece_bpe_32k.model"
#: Documents and links of a block; the last document may exceed the links.
BLOCK_DOCS, BLOCK_LINKS = 4_096, 1_000_000
SLICE = 64
#: Digits of the longest id, and groups that are written at a time.
WIDTH, CHUNK = 6, 1 << 18


class Tokens(NamedTuple):
    """A tokenizer: ids of a text, read for a space and the text, and of each id its bytes, their number, and its decimal.

    Decimals stand at the right of ``digits``; the column after them is free for a mark. ``parts``: tokens always are parts
    of the text, so their lengths tell whether all of it is there.
    """
    ids: Callable[[str], np.ndarray]
    raw: list[bytes]
    sizes: np.ndarray
    digits: np.ndarray
    lengths: np.ndarray
    parts: bool

    def spell(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether the tokens' bytes are those of the text."""
        if self.parts:
            return int(self.sizes[ids].sum()) == len(text)
        return b"".join(map(self.raw.__getitem__, ids.tolist())) == text


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int, int, bool]]:
    """Steps over two arrays of strictly rising ends with the same last one.

    A step (i, k, j, m, single) has tokens i to k of the first and j to m of the second, which meet one to one or are one group.
    """
    steps: list[tuple[int, int, int, int, bool]] = []
    i, shift, n, all_b = 0, 0, len(a), len(b)
    while i < n:
        if a[i] == b[i + shift]:
            start, step = i, 2
            i += 1
            while i + step <= n and a[i:i + step] == b[i + shift:i + shift + step]:
                i += step
                step *= 2
            most = min(n, all_b - shift)
            while i < most and a[i] == b[i + shift]:
                i += 1
            steps.append((start, i, start + shift, i + shift, True))
            if i == n:
                break
        first, j = i, i + shift
        second, left, right = j, a[i], b[j]
        while left != right:  # the side that lags takes its next token
            if left < right:
                i += 1
                left = a[i]
            else:
                j += 1
                right = b[j]
        i, j = i + 1, j + 1
        steps.append((first, i, second, j, False))
        shift = j - i
    return steps


def _tokens(ids: Callable[[str], np.ndarray], raw: list[bytes], parts: bool = False) -> Tokens:
    names = [str(i).encode() for i in range(len(raw))]
    digits = np.frombuffer(b"".join(n.rjust(WIDTH) + b"," for n in names), np.uint8).reshape(-1, WIDTH + 1)
    return Tokens(ids, raw, np.array(list(map(len, raw)), np.int64), digits, np.array(list(map(len, names)), np.int8), parts)


@functools.lru_cache(maxsize=2)  # once per worker, not per task
def byte_tokens(ranks_path: str, pattern: str) -> Tokens:
    """A byte-level tokenizer from its ranks, which has no special tokens; it reads the space as part of the text."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    raw = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        raw[rank] = word
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    return _tokens(lambda text: encode(" " + text, disallowed_special=()).astype(np.int64), raw, parts=True)


@functools.lru_cache(maxsize=2)
def piece_tokens(model_path: str) -> Tokens:
    """A sentence-piece tokenizer, which writes the space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    raw = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        raw.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return _tokens(lambda text: np.array(model.encode_as_ids(text), np.int64), raw)


def _group_ends(steps: list[tuple[int, int, int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side stand before the end of each group."""
    i, k, j, m, single = np.array(steps, np.int64).T
    found = np.where(single, k - i, 1)
    inside = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + 1
    return np.repeat(np.where(single, i, k - 1), found) + inside, np.repeat(np.where(single, j, m - 1), found) + inside


def _digest(x: np.ndarray, y: np.ndarray, ends: tuple[np.ndarray, np.ndarray], first: Tokens, second: Tokens) -> str:
    """SHA-256 of the groups, written as a1,a2|b1;a3|b2,b3 in decimals."""
    told = hashlib.sha256()
    for at in range(0, len(ends[0]), CHUNK):
        a, b = (e[at:at + CHUNK] for e in ends)
        low = (ends[0][at - 1], ends[1][at - 1]) if at else (0, 0)
        sides = ((x[low[0]:a[-1]], a - low[0], first, ord("|")), (y[low[1]:b[-1]], b - low[1], second, ord(";")))
        rows = np.empty((len(sides[0][0]) + len(sides[1][0]), WIDTH + 1), np.uint8)
        lengths = np.empty(len(rows), np.int8)
        # a token stands behind those of its side and those of the other side in the groups before, its own for the second
        before = (np.concatenate(([0], sides[1][1][:-1])), sides[0][1])
        for (ids, group, tokens, mark), other in zip(sides, before):
            place = np.arange(len(ids)) + np.repeat(other, np.diff(group, prepend=0))
            marked = tokens.digits[ids]
            marked[group - 1, WIDTH] = mark
            rows[place], lengths[place] = marked, tokens.lengths[ids]
        shown = rows[np.arange(WIDTH + 1) >= (WIDTH - lengths)[:, None]]
        told.update(shown if at + CHUNK < len(ends[0]) else shown[:-1])
    return told.hexdigest()


def aligned(text: str | None, first: Tokens, second: Tokens) -> tuple[int, int, int, str, np.ndarray]:
    """Numbers of tokens and groups, digest of the groups, and the linked ids as first * 2^32 + second."""
    nothing = (0, 0, 0, "", np.zeros(0, np.int64))
    if not text:
        return nothing
    whole = b" " + text.encode("utf-8", "surrogatepass")
    x, y = first.ids(text), second.ids(text)
    if not (first.spell(x, whole) and second.spell(y, whole)):
        return nothing
    left, right = first.sizes[x], second.sizes[y]
    if not (left.all() and right.all()):
        return nothing
    ends = _group_ends(align(np.cumsum(left).tolist(), np.cumsum(right).tolist()))
    links = x[ends[0] - 1] << 32 | y[ends[1] - 1]
    return len(x), len(y), len(links), _digest(x, y, ends, first, second), links


_TOLD = "block string, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs array<bigint>, found array<bigint>"


def blocks(docs: DataFrame, tokenizers: Callable[[], tuple[Tokens, Tokens]], most_docs: int = BLOCK_DOCS,
           most_links: int = BLOCK_LINKS) -> DataFrame:
    """A row per document, with places of its links in its block's pairs, and one row per block with pairs and their counts."""
    slim = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = StructType([StructField("doc_id", slim.schema[0].dataType), *StructType.fromDDL(_TOLD).fields])
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    step = min(SLICE, most_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        first, second = tokenizers()
        ids, rows, links = [], [], 0

        def told() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            places, pairs = pd.factorize(np.concatenate([r[4] for r in rows]))
            found = np.bincount(places, minlength=len(pairs))
            places = places.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
            cuts = [0, *accumulate(len(r[4]) for r in rows)]
            columns = [[name] * len(rows), *map(list, zip(*[r[:4] for r in rows])),
                       [places[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], [None] * len(rows), [None] * len(rows)]
            head = [name, None, None, None, None, None, pairs.tolist(), found.tolist()]
            doc_id = pa.chunked_array([*ids, pa.nulls(1, ids[0].type)]).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [doc_id, *[pa.array([*c, h], t) for c, h, t in zip(columns, head, types)]], names=schema.names)

        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                ids.append(batch.column(0))
                made = [aligned(text, first, second) for text in batch.column(1).to_pylist()]
                rows += made
                links += sum(len(r[4]) for r in made)
                if len(rows) >= most_docs or links >= most_links:
                    yield told()
                    ids.clear()
                    rows.clear()
                    links = 0
        if rows:
            yield told()

    return slim.mapInArrow(run, schema)


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one block with sums over their links, from the counts of the block's pairs."""
    order = np.argsort(pairs["place"].to_numpy())
    n, best = pairs["n"].to_numpy()[order], pairs["best"].to_numpy()[order]
    width = "<u2" if len(n) <= 1 << 16 else "<u4"
    links = [np.frombuffer(x, width) for x in docs["links"].to_pylist()]
    return pa.table([docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"],
                     pa.array([len(x) for x in links], pa.int64()), pa.array([int(best[x].sum()) for x in links], pa.int64()),
                     pa.array([int(n[x].sum()) for x in links], pa.int64()), docs["groups_sha256"]],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment(docs: DataFrame, tokenizers: Callable[[], tuple[Tokens, Tokens]] | None = None, most_docs: int = BLOCK_DOCS,
              most_links: int = BLOCK_LINKS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of (doc_id, text).

    ``tokenizers()`` runs in each task and gives the two tokenizers; their files must lie on every executor.
    """
    spark = docs.sparkSession
    if tokenizers is None:
        import public_tokenizers

        ranks, model, pattern = public_tokenizers.path(f"{FIRST}.tiktoken"), public_tokenizers.path(SECOND), public_tokenizers.PATTERN
        tokenizers = lambda: (byte_tokens(ranks, pattern), piece_tokens(model))
    path = scratch_path(spark, "aligned")
    made = blocks(docs, tokenizers, most_docs, most_links)
    made.write.option("compression", "zstd").parquet(path)
    told = lambda: spark.read.schema(made.schema).parquet(path)
    listed = told().where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "found")).alias("place", "entry")) \
        .select("block", "place", F.col("entry.pairs").alias("pair"), F.col("entry.found").alias("found"))
    pair_path = scratch_path(spark, "pair-counts")
    listed.groupBy("pair").agg(F.sum("found").alias("n")).write.parquet(pair_path)
    pairs = spark.read.schema("pair long, n long").parquet(pair_path).withColumn("second", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    highest = pairs.groupBy("second").agg(F.max("n").alias("highest"))
    pairs = pairs.join(highest, "second").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    known = listed.join(pairs, "pair").select("block", "place", "n", "best")
    rows = told().where("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    shape = StructType([StructField("doc_id", made.schema["doc_id"].dataType), *StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_summed, shape)
