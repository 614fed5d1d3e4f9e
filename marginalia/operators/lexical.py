"""Corpus statistics, stored and versioned, and what is scored with them: BM25 and weighted hashed embeddings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from marginalia.functions.text import terms
from marginalia.operators.vectors import counted_topk, hashed_buckets

# Digits of a BM25 score, so that sums in another order are the same score.
DIGITS = 9


# ---- document frequencies of terms, and BM25 ----

class Statistics(NamedTuple):
    """Document frequency of each term (term, df), the number of texts, their mean number of terms, and a version."""
    terms: DataFrame
    texts: int
    mean_terms: float
    version: str


def write_statistics(texts: DataFrame, path: str, text: str = "content") -> None:
    """Counts all texts in one aggregate and stores the result below ``path``.

    A text gives its distinct terms and one row without a term, which carries its length; a frequent term leaves a task as
    one row. NULL texts count as empty ones.
    """
    own = terms(F.coalesce(F.col(text), F.lit("")))
    none = F.array(F.lit(None).cast("string"))
    # made before the explode, or every term would read its text again
    told = texts.select(own.alias("own")).select(F.size("own").cast("long").alias("length"), F.concat(F.array_distinct("own"), none).alias("list"))
    rows = told.select("length", F.explode("list").alias("term"))
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("length"))
    counts.select("term", "df", F.when(F.col("term").isNull(), F.col("length")).alias("length")).write.mode("errorifexists").parquet(path)


def read_statistics(spark: SparkSession, path: str) -> Statistics:
    """Stored statistics; the version is a sum over all their rows, so it differs where any count does."""
    rows = spark.read.schema("term string, df long, length long").parquet(path)
    mark = F.sum(F.xxhash64("term", "df", "length").bitwiseAND(F.lit((1 << 40) - 1)))
    total = rows.where("term is null").select("df", "length").first()
    if total is None or not total["df"]:
        return Statistics(rows.where("term is not null").select("term", "df"), 0, 0.0, "0")
    return Statistics(rows.where("term is not null").select("term", "df"), total["df"], total["length"] / total["df"],
                      f"{rows.agg(mark).first()[0]:x}")


def bm25(candidates: DataFrame, statistics: Statistics, key: tuple[str, ...] = ("query_id", "document_chunk_id"),
         query: str = "qtext", content: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Adds ``bm25_score`` to candidates (one row per ``key``): the query's distinct terms, weighed by their rarity.

    Only terms that a candidate has leave its row, with their frequency; they meet the corpus counts in one join, whose hot
    terms adaptive execution splits. Terms that the corpus lacks, and candidates without any of the terms, score 0.
    """
    asked, own = terms(F.coalesce(F.col(query), F.lit(""))), terms(F.coalesce(F.col(content), F.lit("")))
    told = candidates.select(*key, asked.alias("asked"), own.alias("own"))
    found = F.transform(F.array_intersect("asked", "own"), lambda t: F.struct(
        t.alias("term"), F.size(F.filter("own", lambda x: x == t)).alias("tf")))
    told = told.select(*key, F.size("own").alias("length"), found.alias("hits"))
    hits = told.select(*key, "length", F.explode("hits").alias("hit")).select(*key, "length", "hit.term", "hit.tf")
    rare = F.log1p((F.lit(float(statistics.texts)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worn = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(statistics.mean_terms or 1.0))
    sums = hits.join(statistics.terms, "term").groupBy(*key).agg(F.sum(rare * F.col("tf") * (k1 + 1) / worn).alias("bm25_score"))
    return candidates.join(sums, list(key), "left") \
        .withColumn("bm25_score", F.round(F.coalesce("bm25_score", F.lit(0.0)), DIGITS))


def rerank_bm25(candidates: DataFrame, statistics: Statistics, top_n: int = 5, **how) -> DataFrame:
    """Best ``top_n`` candidates per query by BM25, with ``rank`` from 1; equal scores go by chunk id."""
    order = W.partitionBy("query_id").orderBy(F.desc("bm25_score"), "document_chunk_id")
    return bm25(candidates, statistics, **how).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


# ---- hashed embeddings with fitted weights ----

class BucketWeights(NamedTuple):
    """Inverse document frequency of each bucket, with a version that vectors carry along."""
    weights: np.ndarray
    version: str


def fit_weights(texts: DataFrame, text: str = "content", dims: int = 256, buckets: str | None = None) -> BucketWeights:
    """Weights from one aggregate over all texts; ``dims`` + 1 rows come back to the driver.

    ``buckets`` names a column that holds the texts' ``hashed_buckets`` already, of the same ``dims``.
    """
    made = F.coalesce(F.col(buckets), F.array().cast("array<int>")) if buckets else hashed_buckets(F.coalesce(F.col(text), F.lit("")), dims)
    own = F.array_distinct(made)
    rows = texts.select(F.explode(F.concat(own, F.array(F.lit(-1)))).alias("bucket"))
    counts = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
    total = counts.pop(-1, 0)
    df = np.array([counts.get(i, 0) for i in range(dims)], np.float64)
    weights = np.log((1 + total) / (1 + df)) + 1
    return BucketWeights(weights, hashlib.sha256(json.dumps([dims, total, sorted(counts.items())]).encode()).hexdigest()[:16])


def write_weights(spark: SparkSession, fitted: BucketWeights, path: str) -> None:
    rows = [(i, float(w), fitted.version) for i, w in enumerate(fitted.weights)]
    spark.createDataFrame(rows, "bucket int, weight double, version string").coalesce(1).write.mode("errorifexists").parquet(path)


def read_weights(spark: SparkSession, path: str) -> BucketWeights:
    rows = spark.read.schema("bucket int, weight double, version string").parquet(path).orderBy("bucket").collect()
    versions = {r["version"] for r in rows}
    if len(versions) != 1 or [r["bucket"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"{path} holds no single table of weights")
    return BucketWeights(np.array([r["weight"] for r in rows]), versions.pop())


def weighted_embedder(fitted: BucketWeights, hashed: bool = False) -> Callable[[Column], Column]:
    """Unit-length hashed term counts, each bucket weighed by its rarity; NULL for a blank or NULL text.

    Takes texts, or with ``hashed`` their buckets.
    """
    dims, weights = len(fitted.weights), fitted.weights

    @F.arrow_udf(T.ArrayType(T.DoubleType(), False))
    def vectors(buckets: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cells = np.repeat(np.arange(len(sizes)) * dims, sizes) + buckets.flatten().to_numpy(zero_copy_only=False)
        matrix = np.bincount(cells, minlength=len(sizes) * dims).reshape(len(sizes), dims) * weights
        norms = np.sqrt((matrix ** 2).sum(1, keepdims=True))
        unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
        offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dims, mask=np.append(sizes == 0, False))
        return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))

    return vectors if hashed else lambda text: vectors(hashed_buckets(text, dims))


def embed_weighted(df: DataFrame, text: Column | None, fitted: BucketWeights, name: str = "embedding",
                   buckets: str | None = None) -> DataFrame:
    """Adds the vectors of a text and, as ``<name>_version``, the version of the weights they were made with.

    ``buckets`` names a column that holds the texts' ``hashed_buckets`` already.
    """
    vectors = weighted_embedder(fitted, True)(F.col(buckets)) if buckets else weighted_embedder(fitted)(text)
    return df.withColumns({name: vectors, f"{name}_version": F.lit(fitted.version)})


def text_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Top-k of chunks (document_chunk_id, document_id, embedding, embedding_version) for queries (query_id, qvec, qvec_version).

    Vectors of different weights have different axes, so both sides must carry one and the same version.
    """
    versions = set()
    for df, column in ((queries, "qvec_version"), (chunks, "embedding_version")):
        row = df.agg(F.min(column), F.max(column), F.count_if(F.col(column).isNull())).first()
        versions |= {v for v in row[:2] if v is not None} | ({None} if row[2] else set())
    if len(versions) > 1 or None in versions:
        raise ValueError(f"vectors of different weights: {sorted(map(str, versions))}")
    return counted_topk(queries.select("query_id", "qvec"), chunks.select("document_chunk_id", "document_id", "embedding"), k)[0]
