"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

A bounded sample fits the list centres; every usable vector joins the list of its nearest centre. A query probes the lists
nearest to it until they hold the wanted share of all vectors. Inside a list, vectors are rotated at random and scanned in
blocks of columns: after each block, the distance so far, scaled to all dimensions, is tested against the distance to beat,
and candidates that fail are abandoned. Survivors are measured exactly, in double precision, on the original vectors.

Lists are cut into blocks of bounded size and queries into chunks, and each (list, block, chunk) is one task's group, so
neither a hot list nor a large query set meets one task. Centres, rotation and the sample behind each query's first bound
have fixed sizes.

Defined results: vectors null, zero or with null or non-finite components, and rows with a null id, take no part; vectors
are compared with those of their own length only; a query does not find rows of its own id; ties go to the smaller id; rows
that repeat an id are candidates of their own, and repeat-rows of a query are searched once per different vector; a query
gets all candidates if they are fewer than wanted; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import settle


class Settings(NamedTuple):
    lists: int = 128
    share: float = 0.65  # of all vectors, in the lists that a query probes
    sample: int = 20_000  # vectors that fit the centres
    bound_sample: int = 2_000  # of them, those that give a query its first distance to beat
    block_rows: int = 8192
    chunk_queries: int = 4096
    columns: int = 16
    strictness: float = 2.1  # of the test: larger abandons later
    rounds: int = 12
    seed: int = 5


class Index(NamedTuple):
    centres: np.ndarray
    rotation: np.ndarray
    bound_ids: np.ndarray
    bound_vectors: np.ndarray


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    told = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    return told.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None] - 2 * a @ b.T


def fit(rows: list[tuple[int, list[float]]], settings: Settings) -> Index:
    """Centres by k-means on a sample, and a random rotation."""
    ids = np.array([i for i, _ in rows], np.int64)
    points = np.array([v for _, v in rows], float)
    rng = np.random.default_rng(settings.seed)
    different = np.unique(points, axis=0)
    centres = different[rng.choice(len(different), min(settings.lists, len(different)), replace=False)]
    for _ in range(settings.rounds):
        own = _squares(points, centres).argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    rotation, _ = np.linalg.qr(rng.normal(size=(points.shape[1],) * 2))
    few = settings.bound_sample
    return Index(centres, rotation, ids[:few], points[:few])


def scan(query: np.ndarray, own: int, rotated: np.ndarray, bound: float, turned: np.ndarray, vectors: np.ndarray,
         ids: np.ndarray, wanted: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of a block's nearest vectors to a query; ``bound`` is the distance to beat at first.

    Rows of the query's ``own`` id take no place. ``rotated`` and ``turned`` are the query and the block after rotation.
    """
    width, best, far = len(query), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(ids), 1024):
        alive = start + np.flatnonzero(ids[start:start + 1024] != own)
        part = np.zeros(len(alive))
        limit = min(bound, far[wanted - 1] if len(far) >= wanted else np.inf) ** 2
        for at in range(0, width, settings.columns):
            seen = min(at + settings.columns, width)
            part += ((turned[alive, at:seen] - rotated[at:seen]) ** 2).sum(1)
            if seen < width and limit < np.inf:
                stay = part <= limit * (seen / width) * (1 + settings.strictness / np.sqrt(seen)) ** 2
                alive, part = alive[stay], part[stay]
        near = np.sqrt(((vectors[alive] - query) ** 2).sum(1))
        best, far = np.concatenate([best, alive]), np.concatenate([far, near])
        order = np.lexsort((ids[best], far))[:wanted]
        best, far = best[order], far[order]
    return best, far


def _search(points: DataFrame, queries: DataFrame, width: int, wanted: int, settings: Settings) -> DataFrame:
    spark = points.sparkSession
    rows = points.orderBy(F.xxhash64(F.lit(settings.seed), "vec_id"), "vec_id").limit(settings.sample).collect()
    index = spark.sparkContext.broadcast(fit([(r["vec_id"], r["v"]) for r in rows], settings))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = index.value.centres
        for batch in batches:
            if batch.num_rows:
                own = _squares(_matrix(batch.column("v"), width), centres).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["vec_id", "v", "list"])

    listed = points.mapInArrow(assign, "vec_id long, v array<double>, list int")
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}
    blocks = {i: -(-n // settings.block_rows) for i, n in sizes.items()}
    chunks = max(1, -(-queries.count() // settings.chunk_queries))
    held = np.array([sizes.get(i, 0) for i in range(len(index.value.centres))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = _matrix(batch.column("v"), width), batch.column("vec_id").to_numpy()
            # enough rows for the wanted ones even where all rows of the query's id are among them
            least = np.maximum(settings.share * held.sum(), np.minimum(wanted + batch.column("copies").to_numpy(), held.sum()))
            order = np.argsort(_squares(v, known.centres), 1, kind="stable")
            before = np.cumsum(held[order], 1) - held[order]
            probed = [o[(b < n) & (held[o] > 0)] for o, b, n in zip(order, before, least)]
            bound = np.full(len(v), np.inf)
            for i, (query, own) in enumerate(zip(v, ids)):
                near = ((known.bound_vectors[known.bound_ids != own] - query) ** 2).sum(1)
                if len(near) >= wanted:
                    bound[i] = np.sqrt(np.partition(near, wanted - 1)[wanted - 1]) * (1 + 1e-9)
            times = np.array(list(map(len, probed)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(np.repeat(np.arange(len(v)), times))) for c in ("q", "vec_id", "v")]
                + [pa.array(np.repeat(bound, times)), pa.array(np.concatenate(probed).astype(np.int32))],
                names=["q", "query_id", "v", "bound", "list"])

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            vectors, ids = _matrix(left.column("v"), width), left.column("vec_id").to_numpy()
            asked, rotation = _matrix(right.column("v"), width), index.value.rotation
            turned, turned_asked = vectors @ rotation, asked @ rotation
            for i, (q, query_id, bound) in enumerate(zip(*(right.column(c).to_pylist() for c in ("q", "query_id", "bound")))):
                best, far = scan(asked[i], query_id, turned_asked[i], bound, turned, vectors, ids, wanted, settings)
                found += [(q, query_id, int(ids[b]), float(f)) for b, f in zip(best, far)]
        columns = list(zip(*found)) if found else [()] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("q", "query_id", "vec_id", "score"), columns,
                                                              (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})

    blocks_of = F.element_at(F.create_map(*[F.lit(x) for i, n in blocks.items() for x in (i, n)]), F.col("list"))
    # points are checkpointed, so a row keeps its number; rows of one id go to blocks of their own
    left = listed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), blocks_of).cast("int"))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = queries.mapInArrow(probe, "q long, query_id long, v array<double>, bound double, list int")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), blocks_of - 1)))
    right = right.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int"))
    keys = ["list", "block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)) \
        .applyInArrow(meet, "q long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 100, wanted: int = 10, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) for each vector whose id is divisible by ``every``, against all rows."""
    points = settle(usable(vectors).withColumn("width", F.size("v")))
    queries = points.where(F.col("vec_id") % every == 0)
    copies = queries.groupBy("vec_id", "width").agg(F.count(F.lit(1)).alias("copies"))
    queries = queries.withColumn("q", F.xxhash64("vec_id", "v")).dropDuplicates(["q"]).join(copies, ["vec_id", "width"])
    found = points.sparkSession.range(0).select(F.col("id").alias("q"), F.col("id").alias("query_id"),
                                                F.col("id").alias("vec_id"), F.col("id").cast("double").alias("score"))
    for row in points.select("width").distinct().orderBy("width").collect():  # vectors of one length meet each other
        width = row["width"]
        found = found.unionByName(_search(points.where(F.col("width") == width).select("vec_id", "v"),
                                          queries.where(F.col("width") == width).select("q", "vec_id", "v", "copies"),
                                          width, wanted, settings))
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    return ranked.select("query_id", "rank", "vec_id", "score")
