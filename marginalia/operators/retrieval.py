"""Retrieval composites: search, section-balanced expansion, reranking, hybrid context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions.text import section_priority, terms
from marginalia.operators.vectors import counted_topk
from marginalia.session import settle

# A result set of at most this many rows (ids and scores, ~64 bytes each) is broadcast to the big tables.
BROADCAST_HITS = 1_000_000

# Up to this many document ids (~50 bytes each in a hash table) are broadcast: 100 MB.
BROADCAST_IDS = 2_000_000

RESULT_COLUMNS = ["query_id", "rank", "document_chunk_id", "section", "content", "similarity_score", "document_id",
                  "source_id", "title", "authors", "publication_date", "journal", "doi"]


def small(hits: DataFrame, bound: int | None) -> DataFrame:
    """Broadcast hint for a set known to have at most ``bound`` rows; none beyond the limit or without a bound."""
    return F.broadcast(hits) if bound is not None and bound <= BROADCAST_HITS else hits


def _times(queries: int | None, per_query: int) -> int | None:
    return None if queries is None else queries * per_query


def live_chunks(chunks: DataFrame, docs: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Chunks of documents that are not excluded from search.

    The searchable ids are counted first: up to the limit they are broadcast and the vectors stay where they
    are read; beyond it the tables join by document id, without a shuffle when both are bucketed by it.
    """
    live = docs.where(F.col("priority") > 0).select("document_id")
    return chunks.join(F.broadcast(live) if live.count() <= broadcast_ids else live, "document_id", "left_semi")


def document_fields(metadata: str = "metadata") -> dict[str, Column]:
    """Metadata fields with the defaults of absent keys."""
    return {
        "authors": F.coalesce(F.col(f"{metadata}.authors"), F.array().cast("array<string>")),
        "publication_date": F.coalesce(F.col(f"{metadata}.pub_date"), F.lit("")),
        "journal": F.coalesce(F.col(f"{metadata}.journal"), F.lit("")),
        "doi": F.coalesce(F.col(f"{metadata}.doi"), F.lit("")),
    }


def variant_fields(metadata: str = "metadata") -> dict[str, Column]:
    """The fields and defaults of ``document_fields`` out of a VARIANT column, whose keys differ from source to source.

    A key that is absent, null or of a type that has no such value gives the default; a number or boolean where text is
    wanted gives its text.
    """
    def text(path: str) -> Column:
        value = F.try_variant_get(F.col(metadata), path, "variant")
        nested = F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")  # their text would be JSON
        return F.coalesce(F.when(~nested, F.try_variant_get(F.col(metadata), path, "string")), F.lit(""))

    return {
        "authors": F.coalesce(F.try_variant_get(F.col(metadata), "$.authors", "array<string>"), F.array().cast("array<string>")),
        "publication_date": text("$.pub_date"),
        "journal": text("$.journal"),
        "doi": text("$.doi"),
    }


def parse_metadata(metadata: Column) -> Column:
    """JSON text as VARIANT; null where it is null, empty or no JSON."""
    return F.try_parse_json(metadata)


def with_documents(hits: DataFrame, docs: DataFrame, bound: int | None = None) -> DataFrame:
    slim = docs.select("document_id", "source_id", "title", "metadata")
    return slim.join(small(hits, bound), "document_id").withColumns(document_fields()).drop("metadata")


def with_chunks(hits: DataFrame, chunks: DataFrame, bound: int | None = None) -> DataFrame:
    """Section and content, read only for the hits."""
    texts = chunks.select("document_chunk_id", "section", "content")
    return texts.join(small(hits, bound), "document_chunk_id")


def nearest_chunks(queries: DataFrame, chunks: DataFrame, docs: DataFrame, top_k: int = 10) -> DataFrame:
    """Ids, scores and ranks of the top_k searchable chunks per query."""
    return counted_nearest(queries, chunks, docs, top_k)[0]


def counted_nearest(queries: DataFrame, chunks: DataFrame, docs: DataFrame, top_k: int) -> tuple[DataFrame, int | None]:
    """``nearest_chunks``, and the number of queries where it is small enough for the hits to be broadcast, else None."""
    vectors = live_chunks(chunks.select("document_chunk_id", "document_id", "embedding"), docs)
    return counted_topk(queries, vectors, top_k)


def lexical_score(query: Column, content: Column) -> Column:
    """Default pair scorer: share of the query's distinct terms that the passage has."""
    asked = F.array_distinct(terms(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, terms(content))), F.size(asked)), F.lit(0.0))


def rerank(
    candidates: DataFrame,
    top_n: int = 5,
    scorer: Callable[[Column, Column], Column] = lexical_score,
    query: str = "qtext",
    position: tuple[str, ...] = ("position",),
) -> DataFrame:
    """Best top_n candidates per query by pair score; equal scores keep the input order."""
    scored = candidates.withColumn("rerank_score", scorer(F.col(query), F.col("content")))
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), *[F.asc(p) for p in position])
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def expand_documents(
    wanted: DataFrame,
    chunks: DataFrame,
    exclude: DataFrame | None = None,
    chunks_per_document: int = 5,
    max_excluded: int = 0,
    bound: int | None = None,
) -> DataFrame:
    """Additional chunks of documents, taken round-robin over sections, answer-rich sections first.

    ``wanted``: (query_id, document_id). ``exclude``: (query_id, document_chunk_id), at most
    ``max_excluded`` per query. ``bound``: proven limit of the rows of both. Returns (query_id, document_id,
    document_chunk_id, overall_rank).

    A document asked for by many queries is ranked once, before it meets the queries: of each section only
    its first n + max_excluded chunks can be chosen, and only from the first n + max_excluded sections.
    Both limits are exact and run before the shuffles, so a document holding a third of all chunks passes
    on a few rows.
    """
    reach = chunks_per_document + max_excluded
    wanted = wanted.select("query_id", "document_id").distinct()
    meta = chunks.select("document_id", "document_chunk_id", "chunk_index", "section").join(
        small(wanted.select("document_id").distinct(), bound), "document_id", "left_semi")
    in_section = W.partitionBy("document_id", "section").orderBy("chunk_index", "document_chunk_id")
    near = meta.withColumn("r", F.row_number().over(in_section)).where(F.col("r") <= reach).drop("r")
    near = near.withColumn("section_priority", section_priority(F.col("section")))
    sections = W.partitionBy("document_id").orderBy("section_priority", F.asc_nulls_last("section"))
    near = near.withColumn("s", F.dense_rank().over(sections)).where(F.col("s") <= reach).drop("s")

    asked = near.join(small(wanted, bound), "document_id")
    if exclude is not None:
        asked = asked.join(small(exclude.select("query_id", "document_chunk_id"), bound),
                           ["query_id", "document_chunk_id"], "left_anti")
    per_section = W.partitionBy("query_id", "document_id", "section").orderBy("chunk_index", "document_chunk_id")
    overall = W.partitionBy("query_id", "document_id").orderBy(
        "section_rank", "section_priority", F.asc_nulls_last("section"))
    return asked.withColumn("section_rank", F.row_number().over(per_section)) \
        .where(F.col("section_rank") <= chunks_per_document) \
        .withColumn("overall_rank", F.row_number().over(overall)) \
        .where(F.col("overall_rank") <= chunks_per_document) \
        .select("query_id", "document_id", "document_chunk_id", "overall_rank")


def semantic_search(
    queries: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    top_k: int = 10,
    top_n: int = 5,
    use_reranker: bool = False,
    additional_chunks_per_doc: int = 0,
    scorer: Callable[[Column, Column], Column] = lexical_score,
) -> DataFrame:
    """Search results per query: nearest chunks, optionally expanded within their documents and reranked.

    Hit lists are broadcast to the chunk and document tables where the counted queries bound them.
    """
    hits, n = counted_nearest(queries, chunks, docs, top_k)
    if use_reranker and additional_chunks_per_doc > 0:
        # used four times below: keep the ids, so that the vectors are scanned once
        hits = settle(hits)
    if not use_reranker:
        kept = hits.where(F.col("rank") <= top_n)
        out = with_documents(with_chunks(kept, chunks, _times(n, top_n)), docs, _times(n, top_n))
        return out.select(*RESULT_COLUMNS)

    bound = _times(n, top_k)
    candidates = hits.select("query_id", "document_id", "document_chunk_id", "similarity_score",
                             F.lit(0).alias("stage"), F.col("rank").cast("long").alias("position"), F.lit(0).alias("place"))
    if additional_chunks_per_doc > 0:
        more = expand_documents(hits, chunks, hits, additional_chunks_per_doc, top_k, bound)
        candidates = candidates.unionByName(more.select(
            "query_id", "document_id", "document_chunk_id", F.lit(None).cast("double").alias("similarity_score"),
            F.lit(1).alias("stage"), F.col("document_id").alias("position"), F.col("overall_rank").alias("place")))
        bound = _times(n, top_k * (1 + additional_chunks_per_doc))
    texts = with_chunks(candidates, chunks, bound)
    asked = queries.select("query_id", "qtext")
    pairs = texts.join(small(asked, n), "query_id")
    best = rerank(pairs, top_n, scorer, "qtext", ("stage", "position", "place"))
    out = with_documents(best.drop("qtext", "stage", "position", "place"), docs, _times(n, top_n))
    return out.select(*RESULT_COLUMNS, "rerank_score")


def fetch_chunks(ids: DataFrame, chunks: DataFrame, docs: DataFrame, bound: int | None = None) -> DataFrame:
    """Chunks by id with document fields; the similarity is NULL. Unknown ids give no row."""
    hits = ids.select("document_chunk_id").distinct()
    found = chunks.select("document_chunk_id", "document_id", "section", "content").join(
        small(hits, bound), "document_chunk_id", "left_semi")
    slim = docs.select("document_id", "source_id", "title", "metadata")
    return found.join(slim, "document_id").withColumns(document_fields()).drop("metadata") \
        .withColumn("similarity_score", F.lit(None).cast("double"))


def historical_chunks(fresh: DataFrame, history: DataFrame, max_historical_chunks: int = 15) -> DataFrame:
    """Chunks cited earlier in the conversation that the fresh results lack, newest turn first, at most the cap.

    ``fresh``: (query_id, document_chunk_id). ``history``: (query_id, turn, pos, document_chunk_id). A chunk
    cited again counts at its newest turn. Returns (query_id, document_chunk_id, position).
    """
    seen = history.groupBy("query_id", "document_chunk_id").agg(
        F.min(F.struct((-F.col("turn")).alias("age"), F.col("pos"))).alias("at"))
    new = seen.join(fresh.select("query_id", "document_chunk_id"), ["query_id", "document_chunk_id"], "left_anti")
    order = W.partitionBy("query_id").orderBy("at.age", "at.pos", "document_chunk_id")
    return new.withColumn("position", F.row_number().over(order)) \
        .where(F.col("position") <= max_historical_chunks).select("query_id", "document_chunk_id", "position")


def hybrid_retrieval(
    queries: DataFrame,
    history: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    top_k: int = 20,
    top_n: int = 5,
    max_historical_chunks: int = 15,
    **options,
) -> DataFrame:
    """Fresh results followed by chunks cited earlier in the conversation."""
    # used twice below: at most top_n rows per query, so that the vectors are scanned once
    fresh = settle(semantic_search(queries, chunks, docs, top_k, top_n, **options).drop("rerank_score"))
    old = historical_chunks(fresh, history, max_historical_chunks)
    found = chunks.select("document_chunk_id", "document_id", "section", "content").join(old, "document_chunk_id")
    found = with_documents(found, docs).select(
        "query_id", "document_chunk_id", "section", "content", F.lit(None).cast("double").alias("similarity_score"),
        "document_id", "source_id", "title", "authors", "publication_date", "journal", "doi", "position")
    return fresh.withColumn("origin", F.lit("fresh")).unionByName(
        found.withColumn("rank", F.lit(top_n) + F.col("position")).drop("position")
        .withColumn("origin", F.lit("history")))


def filtered_chunks(chunks: DataFrame, docs: DataFrame, date_from: str | None = None, date_to: str | None = None,
                    journals: list[str] | None = None, sections: list[str] | None = None) -> DataFrame:
    """Restricts the corpus by publication date, journal or section before any vector work."""
    if sections:
        chunks = chunks.where(F.lower("section").isin([s.lower() for s in sections]))
    wanted = docs
    if date_from is not None:
        wanted = wanted.where(F.col("metadata.pub_date") >= date_from)
    if date_to is not None:
        wanted = wanted.where(F.col("metadata.pub_date") <= date_to)
    if journals:
        wanted = wanted.where(F.col("metadata.journal").isin(journals))
    return chunks.join(wanted.select("document_id"), "document_id", "left_semi")


def weight_sections(hits: DataFrame, weight: float = 0.1) -> DataFrame:
    """Ranks hits again with a bonus for answer-rich sections."""
    bonus = F.when(section_priority(F.col("section")) == 1, weight).otherwise(0.0)
    scored = hits.withColumn("weighted_score", F.col("similarity_score") + bonus)
    order = W.partitionBy("query_id").orderBy(F.desc("weighted_score"), F.asc("document_chunk_id"))
    return scored.withColumn("weighted_rank", F.row_number().over(order))


def diversify(hits: DataFrame, k: int, trade_off: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over the candidates of each query (a top-k list, so groups are small).

    ``hits``: query_id, document_chunk_id, similarity_score, embedding.
    """
    import numpy as np
    import pandas as pd

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("document_chunk_id")
        m = np.array(group["embedding"].tolist(), dtype=np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        pairs, rel = m @ m.T, group["similarity_score"].to_numpy()
        chosen: list[int] = []
        left = list(range(len(group)))
        while left and len(chosen) < k:
            worst = pairs[np.ix_(left, chosen)].max(axis=1) if chosen else np.zeros(len(left))
            gain = trade_off * rel[left] - (1 - trade_off) * worst
            chosen.append(left.pop(int(np.argmax(gain))))
        out = group.iloc[chosen][["query_id", "document_chunk_id"]].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    return hits.groupBy("query_id").applyInPandas(pick, "query_id long, document_chunk_id long, mmr_rank int")
