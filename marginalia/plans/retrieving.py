"""Vector search, expansion, reranking and the hybrid context."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import graph, lexical as L, quantisation as C, retrieval as R, vectors as E
from marginalia.plans import fixtures as V
from marginalia.plans.registry import query
from marginalia.session import scratch_path, settle, stored


def _long(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _score(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _near(spark, sf, k=10):
    return R.nearest_chunks(V.questions(spark, sf), V.bare_vec_chunks(spark, sf), V.slim_docs(spark, sf), k)


@query("j1_semantic_topk", """select query_id, rank, document_chunk_id, document_id, round(sim, 6) as similarity_score
from top10""")
def _(spark, sf):
    return _long(_score(_near(spark, sf), "similarity_score"), "rank")


@query("f2_semantic_topn", """select query_id, rank, document_chunk_id, section, md5(content) as content, source_id, title,
  case when has_meta then journal else '' end as journal, round(sim, 6) as similarity_score
from top10 join docs using (document_id) where rank <= 5""")
def _(spark, sf):
    out = R.semantic_search(V.questions(spark, sf), V.vec_chunks(spark, sf), V.slim_docs(spark, sf))
    return _long(_score(out, "similarity_score"), "rank").select(
        "query_id", "rank", "document_chunk_id", "section", F.md5("content").alias("content"), "source_id", "title",
        "journal", "similarity_score")


_TERMS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"
_OVERLAP = (f"coalesce(len(list_intersect({_TERMS.format('qtext')}, {_TERMS.format('content')}))::double "
            f"/ nullif(len({_TERMS.format('qtext')}), 0), 0)")


@query("j5_f3_rerank", f"""select query_id, row_number() over (partition by query_id order by score desc, rank) as rank,
  document_chunk_id, round(score, 6) as rerank_score from (select *, {_OVERLAP} as score from top10)
qualify row_number() over (partition by query_id order by score desc, rank) <= 5""")
def _(spark, sf):
    out = R.semantic_search(V.questions(spark, sf), V.vec_chunks(spark, sf), V.slim_docs(spark, sf), 10, 5, True)
    return _long(_score(out, "rerank_score"), "rank").select("query_id", "rank", "document_chunk_id", "rerank_score")


_BM25 = """words as (select regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as ws from documents),
  totals as (select count(*)::double as n, sum(len(ws))::double / count(*) as mean from words),
  counts as (select term, count(*) as df from (select unnest(list_distinct(ws)) as term from words) group by 1),
  asked as (select query_id, document_chunk_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') as ws,
    unnest(list_distinct(regexp_extract_all(lower(qtext), '[\\p{L}\\p{N}]+'))) as term from top10),
  found as (select query_id, document_chunk_id, term, len(ws) as length, len(list_filter(ws, lambda x: x = term)) as tf from asked),
  rated as (select t.query_id, t.document_chunk_id, round(coalesce(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double))
      * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / mean))), 0), 9) as score
    from top10 t left join (select * from found join counts using (term), totals where tf > 0) f
      on f.query_id = t.query_id and f.document_chunk_id = t.document_chunk_id group by 1, 2)"""


def _statistics(spark, sf):
    """Counts over all documents, stored and read back."""
    path = scratch_path(spark, "statistics")
    L.write_statistics(V.table(spark, sf, "documents"), path, "text")
    return L.read_statistics(spark, path)


@query("j5_bm25", f"""with {_BM25}
select query_id, row_number() over (partition by query_id order by score desc, document_chunk_id) as rank, document_chunk_id,
  round(score, 6) as bm25_score from rated
qualify row_number() over (partition by query_id order by score desc, document_chunk_id) <= 5""")
def _(spark, sf):
    """The ten nearest passages of every question, ranked by BM25 with the counts of the whole corpus."""
    near, bound = R.counted_nearest(V.questions(spark, sf), V.bare_vec_chunks(spark, sf), V.slim_docs(spark, sf), 10)
    hits = R.with_chunks(near.select("query_id", "document_chunk_id"), V.vec_chunks(spark, sf),
                         None if bound is None else bound * 10)
    asked = hits.join(V.questions(spark, sf).select("query_id", "qtext"), "query_id")
    out = L.rerank_bm25(asked, _statistics(spark, sf))
    return _long(_score(out, "bm25_score"), "rank").select("query_id", "rank", "document_chunk_id", "bm25_score")


@query("j5_term_statistics", """with words as (select regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as ws from documents)
select term, count(*) as df, null::bigint as length from (select unnest(list_distinct(ws)) as term from words) group by 1
union all select null, count(*), sum(len(ws))::bigint from words""")
def _(spark, sf):
    """The stored statistics themselves: document frequencies, and the row of totals."""
    path = scratch_path(spark, "statistics")
    L.write_statistics(V.table(spark, sf, "documents"), path, "text")
    return spark.read.parquet(path).select("term", "df", "length")


_EXPAND = """expanded as (select * from (
  select *, row_number() over (partition by query_id, document_id order by section_rank, section_priority,
    section nulls last) as overall_rank
  from (select w.query_id, c.document_id, c.document_chunk_id, c.section, c.content, w.qtext,
      row_number() over (partition by w.query_id, c.document_id, c.section order by c.chunk_index) as section_rank,
      case when regexp_matches(lower(c.section), 'abstract|conclusion|discussion|result|introduction|background|limitation')
        then 1 else 2 end as section_priority
    from (select distinct query_id, qtext, document_id from top10) w join vec_chunks c using (document_id)
    where not exists (select 1 from top10 t where t.query_id = w.query_id and t.document_chunk_id = c.document_chunk_id)))
  where overall_rank <= 3)"""


@query("j4_e1_e2_expand_documents", f"with {_EXPAND} select query_id, document_id, document_chunk_id, overall_rank from expanded")
def _(spark, sf):
    hits = settle(_near(spark, sf))  # used twice: the vectors are scanned once
    wanted = hits.select("query_id", "document_id")
    return _long(R.expand_documents(wanted, V.bare_vec_chunks(spark, sf), hits, 3, 10), "overall_rank")


@query("j1_full_search", f"""with {_EXPAND}, pool as (
  select query_id, document_chunk_id, qtext, content, 0 as stage, rank as position, 0 as place from top10
  union all select query_id, document_chunk_id, qtext, content, 1, document_id, overall_rank from expanded)
select query_id, rank, document_chunk_id, round(score, 6) as rerank_score from (
  select *, row_number() over (partition by query_id order by score desc, stage, position, place) as rank
  from (select *, {_OVERLAP} as score from pool)) where rank <= 5""")
def _(spark, sf):
    out = R.semantic_search(V.questions(spark, sf), V.vec_chunks(spark, sf), V.slim_docs(spark, sf), 10, 5, True, 3)
    return _long(_score(out, "rerank_score"), "rank").select("query_id", "rank", "document_chunk_id", "rerank_score")


@query("g10_candidate_pool", f"""with {_EXPAND} select query_id, document_chunk_id, 'initial' as stage from top10
union all select query_id, document_chunk_id, 'expanded' from expanded""")
def _(spark, sf):
    hits = settle(_near(spark, sf))  # used three times: the vectors are scanned once
    more = R.expand_documents(hits, V.bare_vec_chunks(spark, sf), hits, 3, 10)
    return hits.select("query_id", "document_chunk_id", F.lit("initial").alias("stage")).unionByName(
        more.select("query_id", "document_chunk_id", F.lit("expanded").alias("stage")))


@query("j3_fetch_chunks", """select document_chunk_id, document_id, section, md5(content) as content, source_id, title
from vec_chunks join docs using (document_id) where document_chunk_id in (select distinct src * 5 from turn_cites)""")
def _(spark, sf):
    conv, turn = F.col("conv_id"), F.col("turn")
    a = (conv * 7 + turn * 3) % 100
    ids = V.table(spark, sf, "conversations").where("role = 'assistant'").select(
        F.explode(F.array(a * 5, (a + turn % 3) % 100 * 5)).alias("document_chunk_id"))
    out = R.fetch_chunks(ids, V.vec_chunks(spark, sf), V.slim_docs(spark, sf))
    return out.select("document_chunk_id", "document_id", "section", F.md5("content").alias("content"), "source_id", "title")


def _history(spark, sf):
    """Chunks cited per turn; the conversation of a query has the query's id."""
    c = V.turn_chunks(spark, sf)
    return c.select(F.col("conv_id").alias("query_id"), "turn", F.col("rank").alias("pos"),
                    F.col("chunk_id").alias("document_chunk_id"))


_HISTORY = """hist as (select * from (select *, row_number() over (partition by query_id order by age, pos, cid) as position
  from (select conv_id as query_id, chunk_id as cid, arg_min(-turn, (-turn, rank)) as age, arg_min(rank, (-turn, rank)) as pos
    from turn_chunks where not exists (select 1 from top10 t where t.rank <= 5 and t.query_id = conv_id
      and t.document_chunk_id = chunk_id) group by conv_id, chunk_id)) where position <= 4)"""


@query("g9_historical_chunks", f"with {_HISTORY} select query_id, cid as document_chunk_id, position from hist")
def _(spark, sf):
    fresh = _near(spark, sf).where("rank <= 5").select("query_id", "document_chunk_id")
    return _long(R.historical_chunks(fresh, _history(spark, sf), 4), "position")


_ASKED = """asked as (select distinct conv_id as query_id, conv_id % (select count(*) from questions) as item from conversations),
  fresh as (select a.query_id, t.rank, t.document_chunk_id, t.document_id from asked a join top10 t on t.query_id = a.item
    where t.rank <= 5)"""


def _asked(spark, sf):
    """A question of every conversation; the questions follow one another by conversation id."""
    q = V.questions(spark, sf).withColumnRenamed("query_id", "item")
    conversations = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    return conversations.withColumn("item", F.col("query_id") % q.count()).join(q, "item").select("query_id", "qtext", "qvec")


@query("j6_c13_hybrid_retrieval", f"""with {_ASKED}, {_HISTORY.replace("top10 t where t.rank <= 5 and", "fresh t where")}
select query_id, rank, document_chunk_id, document_id, 'fresh' as origin from fresh
union all select query_id, 5 + position, cid, document_id, 'history' from hist join vec_chunks on cid = document_chunk_id""")
def _(spark, sf):
    """Every conversation asks once more, with what its earlier turns have cited."""
    out = R.hybrid_retrieval(_asked(spark, sf), _history(spark, sf), V.vec_chunks(spark, sf), V.slim_docs(spark, sf), 20, 5, 4)
    return _long(out, "rank").select("query_id", "rank", "document_chunk_id", "document_id", "origin")


@query("c13_ordered_lookup", """select conv_id, turn, rank::bigint as pos, chunk_id, section
from turn_chunks join vec_chunks on chunk_id = document_chunk_id""")
def _(spark, sf):
    ids = V.turn_chunks(spark, sf).select("conv_id", "turn", F.col("rank").cast("long").alias("pos"), "chunk_id")
    c = V.vec_chunks(spark, sf).select(F.col("document_chunk_id").alias("chunk_id"), "section")
    return ids.join(c, "chunk_id")


@query("h12_cosine_columns", """select vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)
  as similarity from embeddings e join (select vec_id as label, embedding from embeddings) q using (label)""")
def _(spark, sf):
    e = V.table(spark, sf, "embeddings")
    heads = e.select(F.col("vec_id").alias("label"), F.col("embedding").alias("other"))
    return e.join(heads, "label").select("vec_id", F.round(E.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


# Lists around the vectors of eight given ids, so that the oracle can state them.
_LISTS, _STEP = 8, 7

_LISTED = f"""heads as (select vec_id // {_STEP} as list_id, embedding::double[] as v from embeddings
    where vec_id % {_STEP} = 0 and vec_id < {_LISTS * _STEP}),
  listed as (select document_chunk_id, arg_max(list_id, list_cosine_similarity(embedding, v)) as list_id
    from vec_chunks, heads where embedding is not null group by 1),
  aimed as (select query_id, list_id, row_number() over (partition by query_id order by list_cosine_similarity(qvec, v) desc) as near
    from questions, heads),
  probed as (select s.*, row_number() over (partition by query_id order by sim desc, document_chunk_id) as rank
    from scored s join listed using (document_chunk_id) join aimed a using (query_id, list_id) where near <= {{probes}}
    qualify rank <= 10)"""


def _stored_lists(spark, sf):
    """The searchable chunks, written once in one folder per list, and the centroids."""
    heads = V.table(spark, sf, "embeddings").where(f"vec_id % {_STEP} = 0 and vec_id < {_LISTS * _STEP}")
    centroids = E.given_centroids(heads.select(F.expr(f"vec_id div {_STEP}").alias("list_id"), "embedding"))
    path = scratch_path(spark, "lists")
    live = R.live_chunks(V.bare_vec_chunks(spark, sf).select("document_chunk_id", "document_id", "embedding"), V.slim_docs(spark, sf))
    E.assign_lists(live, centroids).write.partitionBy("list_id").parquet(path)
    return spark.read.parquet(path), centroids


@query("j2_list_search", f"""with {_LISTED.format(probes=2)}
select query_id, rank, document_chunk_id, round(sim, 6) as similarity_score from probed""")
def _(spark, sf):
    """Approximate search over stored lists; a quarter of them is probed, the others are not read."""
    listed, centroids = _stored_lists(spark, sf)
    hits = E.probe_topk(V.questions(spark, sf), listed, centroids, 10, 2)
    return _long(_score(hits, "similarity_score"), "rank").select("query_id", "rank", "document_chunk_id", "similarity_score")


@query("j2_all_lists", """select query_id, rank, document_chunk_id, round(sim, 6) as similarity_score from top10""")
def _(spark, sf):
    """Probing every list gives the exact result."""
    v = R.live_chunks(V.bare_vec_chunks(spark, sf), V.slim_docs(spark, sf))
    centroids = E.fit_centroids(v, 8)
    hits = E.probe_topk(V.questions(spark, sf), E.assign_lists(v, centroids), centroids, 10, 8)
    return _long(_score(hits, "similarity_score"), "rank").select("query_id", "rank", "document_chunk_id", "similarity_score")


# Words around the vectors of given ids too: 16 of them, in 8 parts of the 64 dimensions.
_PARTS, _WORDS, _APART, _REACH = 8, 16, 5, 4

_QUANTISED = _LISTED.format(probes=2) + f""",
  units as (select vec_id, list_transform(v, lambda x: x / norm) as u from (
    select vec_id, embedding::double[] as v, sqrt(list_inner_product(embedding::double[], embedding::double[])) as norm from embeddings)),
  cut as (select vec_id, s, u[s * 8 + 1 : s * 8 + 8] as part from units, (select unnest(range({_PARTS})) as s) p),
  coded as (select c.vec_id, c.s, arg_min(w.part, list_distance(c.part, w.part)) as word from cut c join cut w on w.s = c.s
    and w.vec_id % {_APART} = 0 and w.vec_id < {_WORDS * _APART} group by 1, 2),
  pool as (select s.query_id, s.document_chunk_id, s.document_id, s.sim from scored s join listed using (document_chunk_id)
    join aimed a using (query_id, list_id) where a.near <= 2),
  guessed as (select query_id, document_chunk_id, any_value(sim) as sim, sum(list_inner_product(q.part, c.word)) as guess
    from pool p join cut q on q.vec_id = p.query_id join coded c on c.vec_id = p.document_chunk_id and c.s = q.s group by 1, 2),
  chosen as (select * from guessed
    qualify row_number() over (partition by query_id order by guess desc, document_chunk_id) <= {_REACH * 10})"""


def _compressed(spark, sf):
    """Codes of the searchable chunks, written once in one folder per list, with their sections."""
    heads = V.table(spark, sf, "embeddings")
    centroids = E.given_centroids(heads.where(f"vec_id % {_STEP} = 0 and vec_id < {_LISTS * _STEP}")
                                  .select(F.expr(f"vec_id div {_STEP}").alias("list_id"), "embedding"))
    books = C.given_codebooks(heads.where(f"vec_id % {_APART} = 0 and vec_id < {_WORDS * _APART}")
                              .select(F.col("vec_id").alias("word_id"), "embedding"), _PARTS)
    live = R.live_chunks(V.bare_vec_chunks(spark, sf).where("embedding is not null"), V.slim_docs(spark, sf))
    path = scratch_path(spark, "codes")
    C.encode(live, centroids, books).write.partitionBy("list_id").parquet(path)
    return spark.read.parquet(path), centroids, books


@query("j2_compressed_search", f"""with {_QUANTISED}
select query_id, row_number() over (partition by query_id order by sim desc, document_chunk_id) as rank, document_chunk_id,
  round(sim, 6) as similarity_score from chosen
qualify row_number() over (partition by query_id order by sim desc, document_chunk_id) <= 10""")
def _(spark, sf):
    """Two lists of codes are read per question; forty of their chunks are scored on their vectors."""
    index, centroids, books = _compressed(spark, sf)
    hits = C.compressed_topk(V.questions(spark, sf), index, V.bare_vec_chunks(spark, sf), centroids, books, 10, 2, _REACH)
    return _long(_score(hits, "similarity_score"), "rank").select("query_id", "rank", "document_chunk_id", "similarity_score")


@query("j2_compressed_filter", """select query_id, least(10, count(*)) as found from scored where section = 'methods' group by 1""")
def _(spark, sf):
    """A filter leaves every question its ten, or all that fit, though the nearest list holds fewer."""
    index, centroids, books = _compressed(spark, sf)
    hits = C.compressed_topk(V.questions(spark, sf), index.where("section = 'methods'"), V.bare_vec_chunks(spark, sf), centroids, books, 10, 1)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))


@query("j2_recall", f"""with {_LISTED.format(probes=4)}
select t.query_id, count(p.document_chunk_id) / count(*)::double as recall from top10 t
left join probed p on p.query_id = t.query_id and p.document_chunk_id = t.document_chunk_id group by 1""")
def _(spark, sf):
    listed, centroids = _stored_lists(spark, sf)
    near = E.probe_topk(V.questions(spark, sf), listed, centroids, 10, 4)
    return E.recall_at_k(near, _near(spark, sf))


@query("n4_enrich_results", """select query_id, rank, source_id, p.pmid, citation_count, m.nih_percentile
from top10 join docs using (document_id) left join (select * from papers where pmid > 0) p on p.pmc_id = source_id
left join metrics m on m.pmid = p.pmid""")
def _(spark, sf):
    hits = R.with_documents(_near(spark, sf), V.slim_docs(spark, sf))
    out = graph.enrich_results(hits, V.papers(spark, sf), V.metrics(spark, sf))
    return _long(out, "rank", "citation_count").select(
        "query_id", "rank", "source_id", "pmid", "citation_count", "nih_percentile")


@query("n5_filtered_search", """select query_id, rank, document_chunk_id, round(sim, 6) as similarity_score from (
  select *, row_number() over (partition by query_id order by sim desc, document_chunk_id) as rank
  from scored join docs using (document_id) where has_meta and pub_date between '2024-01-05' and '2024-01-20'
    and section in ('abstract', 'results', 'discussion')) where rank <= 10""")
def _(spark, sf):
    corpus = R.filtered_chunks(V.bare_vec_chunks(spark, sf), V.slim_docs(spark, sf), "2024-01-05", "2024-01-20",
                               sections=["Abstract", "results", "discussion"])
    hits = R.nearest_chunks(V.questions(spark, sf), corpus, V.slim_docs(spark, sf), 10)
    return _long(_score(hits, "similarity_score"), "rank").select("query_id", "rank", "document_chunk_id", "similarity_score")


@query("n5_section_weighting", """select query_id, document_chunk_id, round(w, 6) as weighted_score,
  row_number() over (partition by query_id order by w desc, document_chunk_id) as weighted_rank
from (select *, sim + case when regexp_matches(lower(section),
  'abstract|conclusion|discussion|result|introduction|background|limitation') then 0.1 else 0 end as w from top10)""")
def _(spark, sf):
    v = V.bare_vec_chunks(spark, sf).select("document_chunk_id", "section")
    hits = v.join(_near(spark, sf), "document_chunk_id")
    return _long(_score(R.weight_sections(hits), "weighted_score"), "weighted_rank").select(
        "query_id", "document_chunk_id", "weighted_score", "weighted_rank")


def _mmr_sql(k: int) -> str:
    """One selection step after the other: relevance less likeness to what is chosen."""
    steps = ["pool as (select t.query_id, t.document_chunk_id, t.sim, c.embedding from top10 t join vec_chunks c using (document_chunk_id))"]
    for i in range(1, k + 1):
        chosen = " union all ".join(f"select * from m{j}" for j in range(1, i)) or "select * from pool where false"
        steps.append(f"""m{i} as materialized (select query_id, document_chunk_id, sim, embedding from (select p.*, 0.7::double * sim - 0.3::double
          * coalesce((select max(list_cosine_similarity(p.embedding, c.embedding)) from ({chosen}) c where c.query_id = p.query_id), 0) as gain
          from pool p where not exists (select 1 from ({chosen}) c where c.query_id = p.query_id and c.document_chunk_id = p.document_chunk_id))
          qualify row_number() over (partition by query_id order by gain desc, document_chunk_id) = 1)""")
    picks = " union all ".join(f"select query_id, document_chunk_id, {i}::bigint as mmr_rank from m{i}" for i in range(1, k + 1))
    return f"with {', '.join(steps)} {picks}"


@query("n5_diversified", _mmr_sql(5))
def _(spark, sf):
    v = V.bare_vec_chunks(spark, sf).select("document_chunk_id", "embedding")
    hits = v.join(_near(spark, sf), "document_chunk_id")
    return _long(R.diversify(hits, 5), "mmr_rank")


# ---- embedding ----

_EMBED = """bins as (select document_id, document_chunk_id, b, count(*) as n from (
    select document_id, document_chunk_id, ('0x' || substr(md5(regexp_replace(w, '\\s+$', '')), 1, 8))::bigint % 64 as b from (
      select c.document_id, document_chunk_id, unnest(regexp_extract_all(lower('Doc: ' || title || chr(10) || 'Section: ' || section
        || chr(10) || chr(10) || content), '\\S+\\s*')) as w from chunks c join docs using (document_id)
        where ingestion_status = 'chunked')) group by all),
  norms as (select document_chunk_id, sqrt(sum(n * n)) as norm from bins group by all)"""


def _embedded(spark, sf, scope="batch", embedder=None):
    docs, chunks = V.slim_docs(spark, sf), V.chunks(spark, sf)
    return E.embed_documents(docs, chunks, embedder or E.hashing_embedder(64), X.embedding_text, 50, scope)


@query("i11_hashed_embeddings", f"""with {_EMBED}
select document_chunk_id, b as bucket, round((n / norm)::float::double, 5) as weight from bins join norms using (document_chunk_id)""")
def _(spark, sf):
    vectors, _ = _embedded(spark, sf)
    return vectors.select("document_chunk_id", F.posexplode("embedding").alias("bucket", "w")).where("w <> 0").select(
        "document_chunk_id", F.col("bucket").cast("long").alias("bucket"),
        F.round(F.col("w").cast("double"), 5).alias("weight"))


_REPORT = """sizes as (select document_id, count(*) as n, count(*) filter (where token_count = 7) as f from chunks group by all),
  work as (select document_id, (row_number() over (order by document_id) - 1) // 50 as batch_id from docs
    where ingestion_status = 'chunked'),
  report as (select *, coalesce(n, 0) as n_chunks, coalesce(f, 0) as n_failed from work left join sizes using (document_id))"""


@query("i10_embed_commit_batch", f"""with {_REPORT} select document_id, batch_id, n_chunks, n_failed,
  case when n_chunks > 0 and not max(n_failed > 0) over (partition by batch_id) then 'embedded' else 'chunked' end as new_status
from report""")
def _(spark, sf):
    return _commit(spark, sf, "batch")


@query("i10_embed_commit_document", f"""with {_REPORT} select document_id, batch_id, n_chunks, n_failed,
  case when n_chunks > 0 and n_failed = 0 then 'embedded' else 'chunked' end as new_status from report""")
def _(spark, sf):
    return _commit(spark, sf, "document")


def _commit(spark, sf, scope):
    """Texts of seven tokens fail in this run."""
    hashing = E.hashing_embedder(64)
    docs, chunks = V.slim_docs(spark, sf), V.chunks(spark, sf)
    failing = lambda t: F.when(X.token_count(t) != 7, hashing(t))
    return E.embed_documents(docs, chunks, failing, lambda title, section, content: content, 50, scope)[1]


@query("b14_embedding_text", """select document_chunk_id, md5('Doc: ' || title || chr(10) || 'Section: ' || section || chr(10)
  || chr(10) || content) as text from chunks join docs using (document_id)""")
def _(spark, sf):
    t = V.chunks(spark, sf).join(V.slim_docs(spark, sf).select("document_id", "title"), "document_id")
    return t.select("document_chunk_id", F.md5(X.embedding_text(F.col("title"), F.col("section"), F.col("content"))).alias("text"))


@query("b15_query_text", "select item_id, 'search_query: ' || text as text from benchmark")
def _(spark, sf):
    return V.table(spark, sf, "benchmark").select("item_id", X.query_text(F.col("text")).alias("text"))


@query("j1_text_search", """with bins as (select kind, id, b, count(*) as n from (
    select kind, id, ('0x' || substr(md5(regexp_replace(w, '\\s+$', '')), 1, 8))::bigint % 64 as b from (
      select 'q' as kind, item_id as id, unnest(regexp_extract_all(lower('search_query: ' || text), '\\S+\\s*')) as w from benchmark
      union all select 'c', document_chunk_id, unnest(regexp_extract_all(lower(content), '\\S+\\s*')) from chunks)) group by all),
  norms as (select kind, id, sqrt(sum(n * n)) as norm from bins group by all),
  sims as (select q.id as query_id, c.id as document_chunk_id, sum(q.n * c.n) / any_value(nq.norm) / any_value(nc.norm) as sim
    from bins q join bins c on q.b = c.b and q.kind = 'q' and c.kind = 'c' join norms nq on nq.kind = 'q' and nq.id = q.id
    join norms nc on nc.kind = 'c' and nc.id = c.id group by all)
select query_id, round(max(sim), 4) as best, count(*) as n from (select s.* from sims s join chunks using (document_chunk_id)
  join docs using (document_id) where priority > 0
  qualify row_number() over (partition by query_id order by sim desc) <= 5) group by query_id""")
def _(spark, sf):
    """Text to text: questions and chunk texts embedded offline, then exact search."""
    embed = E.hashing_embedder(64)
    q = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), embed(X.query_text(F.col("text"))).alias("qvec"))
    c = R.live_chunks(V.chunks(spark, sf), V.slim_docs(spark, sf)).select(
        "document_chunk_id", "document_id", embed(F.col("content")).alias("embedding"))
    return E.vector_topk(q, c, 5).groupBy("query_id").agg(
        F.round(F.max("similarity_score"), 4).alias("best"), F.count(F.lit(1)).alias("n"))


_BUCKETS = """('0x' || substr(md5(regexp_replace(w, '\\s+$', '')), 1, 8))::bigint % 256"""
_WEIGHTED = f"""passages as (select min(document_chunk_id) as id, any_value(content) as content from chunks join docs using (document_id)
    where priority > 0 group by md5(content)),
  bins as (select kind, id, {_BUCKETS} as b, count(*) as n from (
    select 'q' as kind, item_id as id, unnest(regexp_extract_all(lower('search_query: ' || text), '\\S+\\s*')) as w from benchmark
    union all select 'c', id, unnest(regexp_extract_all(lower(content), '\\S+\\s*')) from passages) group by all),
  weights as (select b, ln((1 + (select count(*) from passages))::double / (1 + count(*))) + 1 as weight from bins where kind = 'c' group by 1),
  unseen as (select ln((1 + (select count(*) from passages))::double) + 1 as weight),
  weighed as (select kind, id, b, n * coalesce(weight, (select weight from unseen)) as v from bins left join weights using (b)),
  norms as (select kind, id, sqrt(sum(v * v)) as norm from weighed group by all)"""


@query("i11_weighted_search", f"""with {_WEIGHTED},
  sims as (select q.id as query_id, c.id as document_chunk_id, round(sum(q.v * c.v) / any_value(nq.norm) / any_value(nc.norm), 9) as sim
    from weighed q join weighed c on q.b = c.b and q.kind = 'q' and c.kind = 'c' join norms nq on nq.kind = 'q' and nq.id = q.id
    join norms nc on nc.kind = 'c' and nc.id = c.id group by all)
select query_id, rank, document_chunk_id, round(sim, 6) as similarity_score from (
  select *, row_number() over (partition by query_id order by sim desc, document_chunk_id) as rank from sims) where rank <= 5""")
def _(spark, sf):
    """Text to text over the different passages, hashed buckets weighed by how few passages hold them."""
    live = R.live_chunks(V.chunks(spark, sf), V.slim_docs(spark, sf))
    passages = live.groupBy(F.md5("content")).agg(
        F.min(F.struct("document_chunk_id", "document_id", "content")).alias("c")).select("c.*")
    # words are hashed once, for the weights and for the vectors
    passages = stored(passages.select("document_chunk_id", "document_id", E.hashed_buckets(F.col("content"), 256).alias("buckets")), "passages")
    path = scratch_path(spark, "weights")
    L.write_weights(spark, L.fit_weights(passages, dims=256, buckets="buckets"), path)
    weights = L.read_weights(spark, path)
    q = L.embed_weighted(V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"),
                         X.query_text(F.col("text")), weights, "qvec")
    hits = L.text_topk(q, L.embed_weighted(passages, None, weights, buckets="buckets"), 5)
    return _long(_score(hits, "similarity_score"), "rank").select("query_id", "rank", "document_chunk_id", "similarity_score")
