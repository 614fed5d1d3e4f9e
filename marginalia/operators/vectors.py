"""Exact and approximate vector top-k for whole batches of queries, and text embedding.

Exact search never pairs rows with rows in a join. Each task multiplies its chunk batches with the
query matrix and keeps the k best per query, so at most (queries x k) rows leave a task. The query
matrix is broadcast only below a row cap; larger query sets go through a grid of query blocks and
chunk blocks with the same kernel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from marginalia.operators.ordinals import fixed_batches
from marginalia.session import scratch_path

# Rows of the broadcast query matrix: 4,096 x 768 doubles are 25 MB.
BROADCAST_QUERIES = 4096
# Chunks of one grid cell: 65,536 x 768 floats are 200 MB.
GRID_CHUNKS = 65536
# Scores of one multiplication in a scan: 4M doubles are 32 MB.
SCORES = 4_000_000

HIT_SCHEMA = "query_id long, document_chunk_id long, document_id long, similarity_score double"
_ARROW_HITS = pa.schema([("query_id", pa.int64()), ("document_chunk_id", pa.int64()),
                         ("document_id", pa.int64()), ("similarity_score", pa.float64())])


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays as a Column; NULL for a NULL or zero vector."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                           lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


class _Best:
    """The k best (score desc, chunk id asc) per query seen so far."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        none = (np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        self.rows = [none] * len(query_ids)
        self.floor = np.full(len(query_ids), -np.inf)  # k-th best score so far

    def add(self, sims: np.ndarray, chunk_ids: np.ndarray, doc_ids: np.ndarray,
            allowed: np.ndarray | None = None) -> None:
        fits = sims >= self.floor[:, None]
        if allowed is not None:
            fits &= allowed
        for q in np.flatnonzero(fits.any(axis=1)):
            old_s, old_c, old_d = self.rows[q]
            cand = np.flatnonzero(fits[q])
            s = sims[q, cand]
            if len(s) > self.k:
                # keep ties of the k-th score, the id decides among them below
                kth = np.partition(s, len(s) - self.k)[len(s) - self.k]
                keep = s >= kth
                cand, s = cand[keep], s[keep]
            s = np.concatenate([old_s, s])
            c = np.concatenate([old_c, chunk_ids[cand]])
            d = np.concatenate([old_d, doc_ids[cand]])
            top = np.lexsort((c, -s))[:self.k]
            self.rows[q] = (s[top], c[top], d[top])
            if len(top) == self.k:
                self.floor[q] = s[top[-1]]

    def batch(self) -> pa.RecordBatch:
        counts = [len(r[0]) for r in self.rows]
        cat = lambda i, t: np.concatenate([r[i] for r in self.rows]) if self.rows else np.empty(0, t)
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(self.query_ids, counts)), pa.array(cat(1, np.int64)), pa.array(cat(2, np.int64)),
            pa.array(cat(0, np.float64))], schema=_ARROW_HITS)


def _matrix(column: pa.Array) -> np.ndarray:
    """List column to a (rows x dims) double matrix without a Python object per row."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _score_batch(best: _Best, queries: np.ndarray, batch: pa.RecordBatch, allowed=None) -> None:
    names = batch.schema.names
    fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(names.index("embedding"))), queries.shape[1]), False)
    if not pc.all(fits, min_count=0).as_py():
        if allowed is not None:
            allowed = allowed[:, fits.to_numpy(zero_copy_only=False)]
        batch = batch.filter(fits)
    if batch.num_rows == 0:
        return
    vectors = _matrix(batch.column(names.index("embedding")))
    live = np.linalg.norm(vectors, axis=1) > 0
    ids = batch.column(names.index("document_chunk_id")).to_numpy(zero_copy_only=False)
    docs = batch.column(names.index("document_id")).to_numpy(zero_copy_only=False)
    sims = queries @ _unit_rows(vectors[live]).T
    best.add(sims, ids[live], docs[live], None if allowed is None else allowed[:, live])


def _usable(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    return vectors.where(F.col(column).isNotNull() & (F.size(column) == dims))


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, **limits) -> DataFrame:
    """Top-k hits; see ``counted_topk``."""
    return counted_topk(queries, chunks, k, **limits)[0]


def counted_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    broadcast_queries: int = BROADCAST_QUERIES,
    grid_chunks: int = GRID_CHUNKS,
) -> tuple[DataFrame, int | None]:
    """The k nearest chunks per query by cosine: (query_id, document_chunk_id, document_id, similarity_score, rank).

    ``queries``: query_id long, qvec array. ``chunks``: document_chunk_id, document_id, embedding. NULL,
    and zero vectors take no part, and vectors are compared with those of their own width only. Ties go to the smaller
    chunk id.

    Also returns the number of queries when it is at most ``broadcast_queries``, else None: callers may broadcast
    hit lists only where this bounds them.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", "qvec")
    rows = asked.limit(broadcast_queries + 1).collect()
    corpus = chunks.select("document_chunk_id", "document_id", "embedding")
    if len(rows) <= broadcast_queries:
        block = [r for r in rows if r["qvec"]]
        if not block:
            return spark.createDataFrame([], HIT_SCHEMA + ", rank int"), 0
        # the kernel leaves out unusable vectors; a filter here would run an embedding function twice
        return best_per_query(_scan_topk(spark, block, corpus, k), k), len(block)
    # vectors of one width meet each other
    width = lambda df, c: df.where(F.size(c) > 0).withColumn("width", F.size(c))
    # counted by id, so that no vector is read for it
    cells = math.ceil(chunks.select("document_chunk_id").count() * 2 / grid_chunks)
    hits = _grid_topk(width(asked, "qvec"), width(corpus, "embedding"), k, _blocks(queries, broadcast_queries),
                      F.lit(max(1, cells)), ["width"])
    return best_per_query(hits, k), None


def _blocks(queries: DataFrame, rows: int) -> int:
    # half-full on average, so that uneven hashing stays below the limit
    return max(1, math.ceil(queries.select("query_id").count() * 2 / rows))


def best_per_query(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("similarity_score"), F.asc("document_chunk_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _query_block(rows) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    return ids, _unit_rows(np.array([r["qvec"] for r in rows], dtype=np.float64))


def _scan_topk(spark, rows, corpus: DataFrame, k: int) -> DataFrame:
    widths = sorted({len(r["qvec"]) for r in rows})
    shared = spark.sparkContext.broadcast([_query_block([r for r in rows if len(r["qvec"]) == w]) for w in widths])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(matrix, _Best(ids, k)) for ids, matrix in shared.value]
        for batch in batches:
            for matrix, best in blocks:
                # at most so many scores at a time, whatever the number of queries
                for at in range(0, batch.num_rows, max(1, SCORES // len(matrix))):
                    _score_batch(best, matrix, batch.slice(at, max(1, SCORES // len(matrix))))
        for _, best in blocks:
            yield best.batch()

    return corpus.mapInArrow(scan, HIT_SCHEMA)


def _grid_topk(queries: DataFrame, corpus: DataFrame, k: int, n_q: int, n_c: Column, keys: list[str]) -> DataFrame:
    """Query blocks x chunk blocks, within ``keys`` when given.

    Blocks come from hashes of unique ids, so they are even whatever the data; ``n_c`` is the number of chunk
    blocks and may depend on a key, so a hot key is cut into more blocks.
    """
    block = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = queries.withColumn("qb", block("query_id", F.lit(n_q))).withColumn("cb", every(n_c))
    right = corpus.withColumn("cb", block("document_chunk_id", n_c)).withColumn("qb", every(F.lit(n_q)))

    def cell(qs: pa.Table, cs: pa.Table) -> pa.Table:
        if not qs.num_rows or not cs.num_rows:
            return _ARROW_HITS.empty_table()
        ids = qs.column("query_id").to_numpy()
        best, matrix = _Best(ids, k), _unit_rows(_matrix(qs.column("qvec").combine_chunks()))
        for batch in cs.combine_chunks().to_batches(max_chunksize=8192):
            _score_batch(best, matrix, batch)
        return pa.Table.from_batches([best.batch()])

    on = [*keys, "qb", "cb"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(cell, HIT_SCHEMA)


# ---- coarse partitions: approximate search that reads only the probed lists ----

def fit_centroids(chunks: DataFrame, lists: int, seed: int = 7, max_iter: int = 10) -> np.ndarray:
    """Unit centroids of the coarse partitions, by distributed k-means over all vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = chunks.where("embedding is not null and size(embedding) > 0").select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="features").transform(rows)
    model = KMeans(k=lists, seed=seed, maxIter=max_iter).fit(unit)
    return _unit_rows(np.array(model.clusterCenters(), dtype=np.float64))


def given_centroids(heads: DataFrame) -> np.ndarray:
    """Unit centroids of lists 0, 1, ... from rows (list_id, embedding), one per list."""
    rows = heads.select("list_id", "embedding").orderBy("list_id").collect()
    if [r["list_id"] for r in rows] != list(range(len(rows))):
        raise ValueError("lists must be numbered from 0 without gaps")
    return _unit_rows(np.array([r["embedding"] for r in rows], dtype=np.float64))


def assign_lists(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``list_id``; write the result partitioned by it so that a search prunes whole lists."""
    shared = chunks.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf(T.IntegerType())
    def nearest(vectors: pa.Array) -> pa.Array:
        return pa.array(np.argmax(_matrix(vectors) @ shared.value.T, axis=1).astype(np.int32))

    dims = centroids.shape[1]
    return _usable(chunks, "embedding", dims).withColumn("list_id", nearest("embedding"))


def probe_topk(queries: DataFrame, listed: DataFrame, centroids: np.ndarray, k: int, probes: int,
               broadcast_queries: int = BROADCAST_QUERIES, grid_chunks: int = GRID_CHUNKS) -> DataFrame:
    """Top-k among the chunks of each query's ``probes`` nearest lists; may miss neighbours in other lists.

    Query sets above the cap go through the block grid within each list; a large list is cut into more blocks.
    """
    spark = queries.sparkSession
    rows = queries.select("query_id", "qvec").limit(broadcast_queries + 1).collect()
    if len(rows) <= broadcast_queries:
        block = [r for r in rows if r["qvec"] and len(r["qvec"]) == centroids.shape[1]]
        if not block:
            return spark.createDataFrame([], HIT_SCHEMA + ", rank int")
        return best_per_query(_probe_block(spark, block, listed, centroids, k, probes), k)
    asked = _usable(queries.select("query_id", "qvec"), "qvec", centroids.shape[1])
    # one row per list, so bounded by the number of centroids
    cells = [(r["list_id"], math.ceil(r["count"] * 2 / grid_chunks)) for r in listed.groupBy("list_id").count().collect()]
    sizes = lambda: F.broadcast(spark.createDataFrame(cells, "list_id int, cells int"))
    aimed = _nearest_lists(asked, centroids, probes).join(sizes(), "list_id")
    corpus = listed.select("document_chunk_id", "document_id", "embedding", "list_id").join(sizes(), "list_id")
    hits = _grid_topk(aimed, corpus, k, _blocks(queries, broadcast_queries), F.col("cells"), ["list_id"])
    return best_per_query(hits, k)


def _nearest_lists(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def lists(vectors: pa.Array) -> pa.Array:
        order = _probe_order(_unit_rows(_matrix(vectors)), shared.value, probes).astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1], order.ravel())

    return queries.withColumn("list_id", F.explode(lists("qvec")))


def _probe_order(unit: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :probes]


def _probe_block(spark, rows, listed: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    ids, matrix = _query_block(rows)
    order = _probe_order(matrix, centroids, probes)
    wanted = np.zeros((len(ids), centroids.shape[0]), dtype=bool)
    np.put_along_axis(wanted, order, True, axis=1)
    shared = spark.sparkContext.broadcast((ids, matrix, wanted))
    probed = sorted(int(x) for x in np.unique(order))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, matrix_, wanted_ = shared.value
        best = _Best(ids_, k)
        for batch in batches:
            lists = batch.column(batch.schema.names.index("list_id")).to_numpy(zero_copy_only=False)
            _score_batch(best, matrix_, batch, wanted_[:, lists])
        yield best.batch()

    return listed.where(F.col("list_id").isin(probed)) \
        .select("document_chunk_id", "document_id", "embedding", "list_id").mapInArrow(scan, HIT_SCHEMA)


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    keys = ["query_id", "document_chunk_id"]
    found = approximate.select(*keys).withColumn("hit", F.lit(1))
    return exact.select(*keys).join(found, keys, "left").groupBy("query_id").agg(
        (F.count("hit") / F.count(F.lit(1))).alias("recall"))


# ---- embedding of texts ----

def hashed_buckets(text: Column, dims: int) -> Column:
    """Feature hashing: each lower-cased word falls into one of ``dims`` buckets by its md5."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\S+)"), F.lit(1))
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dims).cast("int"))


def hashing_embedder(dims: int = 64) -> Callable[[Column], Column]:
    """Offline stand-in for an embedding model: unit-length hashed term counts; NULL for a blank text."""
    @F.arrow_udf(T.ArrayType(T.FloatType(), False))
    def counts(buckets: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cells = np.repeat(np.arange(len(sizes)) * dims, sizes) + buckets.flatten().to_numpy(zero_copy_only=False)
        matrix = np.bincount(cells, minlength=len(sizes) * dims).reshape(len(sizes), dims)
        unit = _unit_rows(matrix.astype(np.float64)).astype(np.float32)
        # a text without words has no vector
        offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dims, mask=np.append(sizes == 0, False))
        return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))

    return lambda text: counts(hashed_buckets(text, dims))


def embed_texts(df: DataFrame, text: Column, embedder: Callable[[Column], Column], name: str = "embedding") -> DataFrame:
    """Vectors for a text column; a failed text gives NULL and keeps its row."""
    return df.withColumn(name, embedder(text))


def embed_documents(
    docs: DataFrame,
    chunks: DataFrame,
    embedder: Callable[[Column], Column],
    text: Callable[[Column, Column, Column], Column],
    batch_size: int = 50,
    commit_scope: str = "batch",
    staging: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Embeds all chunks of documents in status ``chunked``.

    A failed vector keeps back its whole batch of documents (``commit_scope="batch"``) or only its document
    (``"document"``). Returns (chunk rows with their vectors, one report row per document: document_id,
    batch_id, n_chunks, n_failed, new_status). Vectors are written once to ``staging`` in the shared folder,
    because the commit rule and the result both need them and a model must not run twice.
    """
    staging = staging or scratch_path(chunks.sparkSession, "vectors")
    work = docs.where(F.col("ingestion_status") == "chunked").select("document_id", "title")
    batches = fixed_batches(work, "document_id", batch_size)
    vectors = chunks.drop("embedding").join(batches, "document_id").withColumn(
        "embedding", embedder(text(F.col("title"), F.col("section"), F.col("content"))))
    vectors.write.parquet(staging)
    vectors = chunks.sparkSession.read.parquet(staging)
    per_doc = vectors.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("embedding").isNull()).alias("n_failed"))
    report = batches.join(per_doc, "document_id", "left").select(
        "document_id", "batch_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"))
    if commit_scope == "batch":
        bad = report.where("n_failed > 0").select("batch_id").distinct().withColumn("bad", F.lit(True))
        report = report.join(bad, "batch_id", "left")
    elif commit_scope == "document":
        report = report.withColumn("bad", F.col("n_failed") > 0)
    else:
        raise ValueError("commit_scope is 'batch' or 'document'")
    ok = (F.col("n_chunks") > 0) & ~F.coalesce("bad", F.lit(False))
    report = report.select("document_id", "batch_id", "n_chunks", "n_failed",
                           F.when(ok, "embedded").otherwise("chunked").alias("new_status"))
    done = report.where("new_status = 'embedded'").select("document_id")
    return vectors.drop("title", "batch_id").join(done, "document_id", "left_semi"), report
