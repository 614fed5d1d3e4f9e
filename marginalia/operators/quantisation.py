"""Compressed vector index: product quantisation inside coarse lists, with exact scores for a shortlist.

A unit vector is cut into parts, and each part is named by the nearest of its codebook's words, so a vector takes one byte
per part. A query makes one table per part, with its product with every word; the sum of the entries that a vector's codes
name is its approximate similarity. Codes are stored once, a folder per list, and a search reads the lists it probes. The
best by approximate similarity are scored again on their vectors.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from marginalia.operators.vectors import _matrix, _nearest_lists, _unit_rows, _usable, assign_lists, cosine
from marginalia.session import settle

# Codes of one block of a list, and queries whose tables stand in memory at a time.
BLOCK_CODES, BLOCK_QUERIES = 65_536, 256
_NEAR = "query_id long, document_chunk_id long, document_id long, approximate double"


class Codebooks(NamedTuple):
    words: np.ndarray  # [part, word, dimension of the part]

    def dims(self) -> int:
        return self.words.shape[0] * self.words.shape[2]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Nearest word of each part of each row; the first of equally near ones."""
        parts = unit.reshape(len(unit), self.words.shape[0], self.words.shape[2])
        out = np.empty(parts.shape[:2], np.uint8)
        for s, words in enumerate(self.words):
            out[:, s] = np.argmin((words ** 2).sum(1) - 2 * parts[:, s] @ words.T, axis=1)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query's parts with all words: [query, part, word]."""
        parts = queries.reshape(len(queries), self.words.shape[0], self.words.shape[2])
        return np.einsum("qsd,swd->qsw", parts, self.words)


def given_codebooks(heads: DataFrame, parts: int) -> Codebooks:
    """The parts of given vectors (word_id, embedding) as words, at most 256 of them."""
    rows = heads.select("word_id", "embedding").orderBy("word_id").limit(257).collect()
    unit = _unit_rows(np.array([r["embedding"] for r in rows], np.float64))
    if len(rows) > 256 or unit.shape[1] % parts:
        raise ValueError("a codebook has at most 256 words, and vectors fall into equal parts")
    return Codebooks(unit.reshape(len(unit), parts, -1).transpose(1, 0, 2).copy())


def fit_codebooks(chunks: DataFrame, parts: int = 16, words: int = 256, sample: int = 20_000, rounds: int = 12, seed: int = 7) -> Codebooks:
    """Words by k-means over each part of a bounded sample of the vectors, chosen by a hash of the chunk id."""
    spot = F.xxhash64(F.lit(seed), "document_chunk_id")
    rows = chunks.where("embedding is not null").select("document_chunk_id", "embedding").orderBy(spot, "document_chunk_id") \
        .limit(sample).select("embedding").collect()
    unit = _unit_rows(np.array([r["embedding"] for r in rows], np.float64))
    if unit.shape[1] % parts or words > 256:
        raise ValueError("a codebook has at most 256 words, and vectors fall into equal parts")
    rng, books = np.random.default_rng(seed), []
    for part in np.split(unit, parts, axis=1):
        centres = part[rng.choice(len(part), min(words, len(part)), replace=False)]
        for _ in range(rounds):
            nearest = np.argmin((centres ** 2).sum(1) - 2 * part @ centres.T, axis=1)
            found = np.bincount(nearest, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, part)
            centres = np.where(found[:, None] > 0, sums / np.maximum(found, 1)[:, None], centres)
        books.append(centres)
    return Codebooks(np.array(books))


def encode(chunks: DataFrame, centroids: np.ndarray, books: Codebooks) -> DataFrame:
    """``chunks`` without vectors, with their list and codes; write it partitioned by ``list_id``."""
    shared = chunks.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf(T.BinaryType())
    def codes(vectors: pa.Array) -> pa.Array:
        found = shared.value.codes(_unit_rows(_matrix(vectors)))
        offsets = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
        return pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(found.tobytes())])

    return assign_lists(chunks, centroids).withColumn("codes", codes("embedding")).drop("embedding")


def shortlist(queries: DataFrame, index: DataFrame, centroids: np.ndarray, books: Codebooks, size: int, probes: int) -> DataFrame:
    """The ``size`` best per query by approximate similarity, among the nearest ``probes`` lists.

    A list is dealt into blocks of codes; its queries go to each of its blocks, so codes never travel more than once.
    """
    spark = queries.sparkSession
    asked = _nearest_lists(_usable(queries.select("query_id", "qvec"), "qvec", centroids.shape[1]), centroids, probes)
    # one row per list, so bounded by the number of centroids
    counts = [(r["list_id"], math.ceil(r["count"] / BLOCK_CODES)) for r in index.groupBy("list_id").count().collect()]
    if not counts:
        return spark.createDataFrame([], _NEAR)
    blocks = F.broadcast(spark.createDataFrame(counts, "list_id int, blocks int"))
    left = asked.join(blocks, "list_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = index.select("list_id", "document_chunk_id", "document_id", "codes").join(blocks, "list_id") \
        .withColumn("block", F.pmod(F.xxhash64("document_chunk_id"), F.col("blocks")).cast("int")).drop("blocks")
    shared = spark.sparkContext.broadcast(books)

    def near(qs: pa.Table, cs: pa.Table) -> pa.Table:
        books, out = shared.value, []
        if qs.num_rows and cs.num_rows:
            ids, docs = cs["document_chunk_id"].to_numpy(), cs["document_id"].to_numpy()
            codes = np.frombuffer(b"".join(cs["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            names, unit = qs["query_id"].to_numpy(), _unit_rows(_matrix(qs["qvec"].combine_chunks()))
            for at in range(0, len(names), BLOCK_QUERIES):
                tables = books.tables(unit[at:at + BLOCK_QUERIES])
                for i, table in enumerate(tables):
                    sims = table[np.arange(len(table)), codes].sum(1)
                    best = np.lexsort((ids, -sims))[:size]
                    out.append((np.full(len(best), names[at + i]), ids[best], docs[best], sims[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pa.table(columns, names=["query_id", "document_chunk_id", "document_id", "approximate"])

    on = ["list_id", "block"]
    hits = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(near, _NEAR)
    order = W.partitionBy("query_id").orderBy(F.desc("approximate"), "document_chunk_id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).drop("place")


def _scored(queries: DataFrame, near: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact similarity of the shortlists; only their vectors are read."""
    asked = near.join(queries.select("query_id", "qvec"), "query_id")
    full = vectors.select("document_chunk_id", "embedding").join(asked, "document_chunk_id")
    told = full.withColumn("similarity_score", cosine(F.col("qvec"), F.col("embedding")))
    order = W.partitionBy("query_id").orderBy(F.desc("similarity_score"), "document_chunk_id")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "document_chunk_id", "document_id", "similarity_score", "rank")


def compressed_topk(queries: DataFrame, index: DataFrame, vectors: DataFrame, centroids: np.ndarray, books: Codebooks, k: int = 10,
                    probes: int = 4, reach: int = 10) -> DataFrame:
    """Top-k per query from the compressed index: ``reach * k`` codes are scored again on ``vectors``.

    A filter is a condition on ``index``, applied before anything is ranked. A query that finds fewer than k in its nearest
    lists looks in all of them, so it has fewer only if no more fit.
    """
    hits = settle(_scored(queries, shortlist(queries, index, centroids, books, reach * k, probes), vectors, k))
    if probes >= len(centroids):
        return hits
    full = hits.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = settle(queries.join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return hits
    more = _scored(short, shortlist(short, index, centroids, books, reach * k, len(centroids)), vectors, k)
    return hits.join(short.select("query_id"), "query_id", "left_anti").unionByName(more)
