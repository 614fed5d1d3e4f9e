"""Scans, predicates, joins, counts, upserts and status changes on the paper and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import curation as C, graph, keyed, quality as Q
from marginalia.operators.ordinals import fixed_batches, number_ids
from marginalia.operators.retrieval import document_fields, live_chunks, parse_metadata, variant_fields
from marginalia.operators.packing import greedy_batches
from marginalia.plans import fixtures as V
from marginalia.plans.registry import query


@query("a1_papers_to_fetch",
       "select pmc_id, fetch_status, priority::bigint as priority from papers where fetch_status in ('pending', 'failed')")
def _(spark, sf):
    return V.papers(spark, sf).where(F.col("fetch_status").isin("pending", "failed")).select(
        "pmc_id", "fetch_status", F.col("priority").cast("long").alias("priority"))


@query("a2_documents_to_chunk", "select document_id, title from docs where ingestion_status = 'fetched'")
def _(spark, sf):
    return V.slim_docs(spark, sf).where("ingestion_status = 'fetched'").select("document_id", "title")


@query("b1_searchable_documents", "select document_id, priority::bigint as priority from docs where priority > 0")
def _(spark, sf):
    return V.slim_docs(spark, sf).where("priority > 0").select(
        "document_id", F.col("priority").cast("long").alias("priority"))


@query("b3_pmid_work_list", "select pmc_id, pmid from papers where pmid is null")
def _(spark, sf):
    return C.pmid_work_list(V.papers(spark, sf)).select("pmc_id", "pmid")


@query("b3_metric_work_list", "select pmc_id, pmid from papers where pmid > 0 and nih_percentile is null")
def _(spark, sf):
    return C.metric_work_list(V.papers(spark, sf)).select("pmc_id", "pmid")


@query("b4_metric_bounds", """select pmid, nih_percentile, "year"::bigint as "year", citation_count from metrics
where nih_percentile >= 40 and "year" between 1992 and 1995 and citation_count >= 25""")
def _(spark, sf):
    return V.metrics(spark, sf).where(C.metric_predicate(40, 1992, 1995, 25)).select(
        "pmid", "nih_percentile", F.col("year").cast("long").alias("year"),
        F.col("citation_count").cast("long").alias("citation_count"))


@query("b5_chunks_of_listed_documents", """select document_chunk_id, document_id from vec_chunks
where document_id in (select doc_id from labels where quality = 1)""")
def _(spark, sf):
    listed = V.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    return V.vec_chunks(spark, sf).join(listed, "document_id", "left_semi").select("document_chunk_id", "document_id")


@query("b6_chunks_not_listed", """select document_chunk_id, document_id from vec_chunks
where document_id not in (select doc_id from labels where quality = 1)""")
def _(spark, sf):
    listed = V.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    return V.vec_chunks(spark, sf).join(listed, "document_id", "left_anti").select("document_chunk_id", "document_id")


@query("b7_metadata_defaults", """select document_id, case when has_meta then author else '' end as authors,
  case when has_meta then pub_date else '' end as publication_date,
  case when has_meta then journal else '' end as journal, '' as doi from docs""")
def _(spark, sf):
    d = V.slim_docs(spark, sf).withColumns(document_fields())
    return d.select("document_id", F.array_join("authors", ",").alias("authors"), "publication_date", "journal", "doi")


@query("b7_variant_metadata", """select document_id, case when has_meta then author else '' end as authors,
  case when has_meta then pub_date else '' end as publication_date,
  case when has_meta then journal else '' end as journal, case when has_meta and document_id % 2 = 0 then '7' else '' end as doi from docs""")
def _(spark, sf):
    """Metadata as JSON of mixed schemas: keys absent, wrongly typed, of other sources; no JSON at all where there is none."""
    d, key = V.slim_docs(spark, sf), F.col("document_id") % 4
    other = F.array(F.lit('{"authors": {"first": 1}, "journal": ["a"], "pub_date": {}, "doi": null}'), F.lit("no { json"),
                    F.lit('["a list"]'), F.lit(None).cast("string"))
    full = F.to_json(F.struct("metadata.authors", "metadata.pub_date", "metadata.journal",
                              F.when(key % 2 == 0, F.lit(7)).alias("doi"), F.struct(F.lit("x").alias("y")).alias("extra")))
    text = F.when(F.col("metadata").isNotNull(), full).otherwise(F.get(other, key.cast("int")))
    d = d.select("document_id", parse_metadata(text).alias("metadata")).withColumns(variant_fields())
    return d.select("document_id", F.array_join("authors", ",").alias("authors"), "publication_date", "journal", "doi")


@query("b8_section_priority", """select section, case when lower(section) like '%abstract%' or lower(section) like '%conclusion%'
  or lower(section) like '%discussion%' or lower(section) like '%result%' or lower(section) like '%introduction%'
  or lower(section) like '%background%' or lower(section) like '%limitation%' then 1 else 2 end::bigint as section_priority,
  count(*) as n from vec_chunks group by all""")
def _(spark, sf):
    return V.bare_vec_chunks(spark, sf).groupBy(
        "section", X.section_priority(F.col("section")).cast("long").alias("section_priority")).agg(
        F.count(F.lit(1)).alias("n"))


@query("b9_priority_labels", """select p_size::bigint as priority, case p_size when 0 then 'EXCLUDE' when 10 then 'LOW'
  when 50 then 'NORMAL' when 100 then 'HIGH' else 'OTHER (' || p_size || ')' end as label, count(*) as n
from part group by all""")
def _(spark, sf):
    p = V.table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"))
    return p.withColumn("label", X.priority_label(F.col("priority")))


@query("b12_dry_run_insert", """select distinct cast(l_partkey + 500 as varchar) as pmc_id from lineitem
where cast(l_partkey + 500 as varchar) not in (select pmc_id from papers)""")
def _(spark, sf):
    new = V.table(spark, sf, "lineitem").select((F.col("l_partkey") + 500).cast("string").alias("pmc_id"))
    return keyed.new_rows(V.papers(spark, sf), new, ["pmc_id"])


@query("b13_sentinel_fill", "select pmid, coalesce(nih_percentile, -1) as nih_percentile, is_clinical from metrics")
def _(spark, sf):
    return V.metrics(spark, sf).select(
        "pmid", X.fill_sentinel(F.col("nih_percentile")).alias("nih_percentile"), "is_clinical")


@query("b16_id_prefix", "select pmc_id, 'PMC' || pmc_id as prefixed, pmc_id as stripped from papers")
def _(spark, sf):
    p = V.papers(spark, sf).select("pmc_id", X.add_source_prefix(F.col("pmc_id")).alias("prefixed"))
    return p.withColumn("stripped", X.strip_source_prefix(F.col("prefixed")))


@query("b17_search_catalogue", """select pmc_id, title, pub_date::varchar as pub_date from papers
where contains(lower(title), 'ring') and open_access and pub_date between date '2021-01-01' and date '2024-06-30'""")
def _(spark, sf):
    return C.search_catalogue(V.papers(spark, sf), "ring", "2021-01-01", "2024-06-30").select(
        "pmc_id", "title", F.col("pub_date").cast("string").alias("pub_date"))


@query("b18_exclude_non_research", """select pmc_id,
  case when pub_type in ('Review', 'Letter') then 0 else priority end::bigint as priority from papers""")
def _(spark, sf):
    return C.exclude_non_research(V.papers(spark, sf)).select("pmc_id", F.col("priority").cast("long").alias("priority"))


@query("b19_year_thresholds", """select pmc_id, "year"::bigint as "year", m.nih_percentile
from papers p join metrics m using (pmid) where pmid > 0
and case "year" when 1992 then m.nih_percentile >= 80 when 1993 then m.nih_percentile >= 70
  when 1994 then m.nih_percentile >= 60 when 1995 then m.nih_percentile >= 40 else true end""")
def _(spark, sf):
    # the fixture's years lie earlier, so the same steps are set on them
    steps = {1992: 80, 1993: 70, 1994: 60, 1995: 40}
    return C.threshold_filter(V.papers(spark, sf), V.metrics(spark, sf), steps).select(
        "pmc_id", F.col("year").cast("long").alias("year"), "nih_percentile")


@query("c1_chunks_with_documents", """select document_chunk_id, document_id, source_id, title, priority::bigint as priority
from vec_chunks join docs using (document_id)""")
def _(spark, sf):
    d = V.slim_docs(spark, sf).select("document_id", "source_id", "title", F.col("priority").cast("long").alias("priority"))
    return V.vec_chunks(spark, sf).select("document_chunk_id", "document_id").join(d, "document_id")


@query("c2_filter_by_metrics", """select pmc_id from papers p join metrics m using (pmid)
where fetch_status = 'wont_fetch' and pmid > 0 and m.nih_percentile >= 50 and "year" >= 1992""")
def _(spark, sf):
    return C.filter_by_metrics(V.papers(spark, sf), V.metrics(spark, sf), "wont_fetch", min_percentile=50, min_year=1992)


_BOUNDS = {
    "none": {}, "percentile": {"min_percentile": 95}, "from_year": {"min_year": 1993}, "to_year": {"max_year": 1992},
    "citations": {"min_citation_count": 30},
    "all": {"min_percentile": 40, "min_year": 1992, "max_year": 1994, "min_citation_count": 20},
}
_BOUND_SQL = {
    "none": "true", "percentile": "nih_percentile >= 95", "from_year": '"year" >= 1993', "to_year": '"year" <= 1992',
    "citations": "citation_count >= 30",
    "all": 'nih_percentile >= 40 and "year" >= 1992 and "year" <= 1994 and citation_count >= 20',
}


@query("m9_filter_counts", "with j as (select m.* from papers p join metrics m using (pmid) where p.fetch_status = 'pending' "
       "and p.pmid > 0) select * from (" + " union all ".join(
           f"select '{k}' as bounds, count(*) filter (where {v}) as n from j" for k, v in _BOUND_SQL.items()) + ")")
def _(spark, sf):
    return C.filter_counts(V.papers(spark, sf), V.metrics(spark, sf), "pending", _BOUNDS)


@query("c11_propagate_priority", """select document_id, coalesce(p.priority, d.priority)::bigint as priority
from docs d left join papers p on d.source_id = p.pmc_id""")
def _(spark, sf):
    return C.propagate_priority(V.slim_docs(spark, sf), V.papers(spark, sf)).select(
        "document_id", F.col("priority").cast("long").alias("priority"))


@query("c17_populate_metrics", """select pmc_id,
  case when hit then coalesce(m.nih_percentile, -1) else p.nih_percentile end as nih_percentile,
  case when hit then "year" end::bigint as publication_year, case when hit then citation_count end as citation_count,
  case when hit then m.is_clinical end as is_clinical
from (select *, coalesce(pmid > 0 and nih_percentile is null and exists (select 1 from metrics where metrics.pmid = papers.pmid),
  false) as hit from papers) p left join metrics m using (pmid)""")
def _(spark, sf):
    return C.populate_metrics(V.papers(spark, sf), V.metrics(spark, sf)).select(
        "pmc_id", "nih_percentile", F.col("publication_year").cast("long").alias("publication_year"),
        F.col("citation_count").cast("long").alias("citation_count"), "is_clinical")


@query("d1_count_by_status", """select 'papers' as of, fetch_status as status, count(*) as n from papers group by all
union all select 'documents', ingestion_status, count(*) from docs group by all""")
def _(spark, sf):
    a = V.papers(spark, sf).groupBy(F.col("fetch_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    b = V.slim_docs(spark, sf).groupBy(F.col("ingestion_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return a.withColumn("of", F.lit("papers")).unionByName(b.withColumn("of", F.lit("documents")))


@query("d2_count_by_priority", """select priority::bigint as priority, count(*) as n,
  case priority when 0 then 'EXCLUDE' when 10 then 'LOW' when 50 then 'NORMAL' else 'HIGH' end as label
from papers where fetch_status = 'fetched' and pmc_id in (select cast(l_partkey as varchar) from lineitem
  where l_returnflag = 'R') group by all""")
def _(spark, sf):
    ids = V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_partkey").cast("string").alias("pmc_id"))
    return C.count_by_priority(V.papers(spark, sf), ids, "fetched").withColumn("priority", F.col("priority").cast("long"))


@query("d7_embedding_cost", """select model, tokens, tokens / 1e6 * price * 0.5 as cost, tokens / 1e6 * price * 0.5 <= 0.01
  as within_budget from (select sum(token_count)::bigint as tokens from chunks),
  (values ('text-embedding-3-small', 0.02::double), ('text-embedding-3-large', 0.13::double),
   ('text-embedding-ada-002', 0.10::double)) v(model, price)""")
def _(spark, sf):
    return C.embedding_cost(V.chunks(spark, sf), True, 0.01).drop("price")


@query("d22_match_report", """select count(*) as candidates, count(m.pmid) as matching,
  round(count(m.pmid) * 100.0 / count(*), 2)::double as percent
from papers p left join (select pmid from metrics where nih_percentile >= 60) m on p.pmid = m.pmid
where fetch_status = 'pending'""")
def _(spark, sf):
    return C.match_report(V.papers(spark, sf), V.metrics(spark, sf), "pending", min_percentile=60)


@query("e7_request_batches", """select n // 200 as batch_id, count(*) as n, string_agg('PMC' || pmc_id, ',' order by k) as ids
from (select pmc_id, pmc_id::bigint as k, row_number() over (order by pmc_id::bigint) - 1 as n from papers
  where pmid is null) group by all""")
def _(spark, sf):
    return C.conversion_requests(V.papers(spark, sf)).select("batch_id", "n", "ids")


@query("e7_document_batches", """select document_id, (row_number() over (order by document_id) - 1) // 50 as batch_id
from docs where ingestion_status = 'chunked'""")
def _(spark, sf):
    work = V.slim_docs(spark, sf).where("ingestion_status = 'chunked'").select("document_id")
    return fixed_batches(work, "document_id", 50)


@query("f7_work_order", """select document_id, row_number() over (order by document_id) as n from docs
where ingestion_status = 'chunked'""")
def _(spark, sf):
    work = V.slim_docs(spark, sf).where("ingestion_status = 'chunked'").select("document_id")
    return number_ids(work, "document_id", "n", 1)


@query("e9_pack_batches", """with sizes as (select document_id, count(*) as c, sum(token_count)::bigint as t from chunks group by 1),
  placed as (select *, coalesce(sum(c) over w, 0)::bigint as cb, coalesce(sum(t) over w, 0)::bigint as tb from sizes
    window w as (order by document_id rows between unbounded preceding and 1 preceding)),
  cut as (select *, cb // 400 as c0, (cb + c - 1) // 400 as c1, tb // 20000 as t0, (tb + t - 1) // 20000 as t1 from placed)
select min(document_id) as batch, count(*) as doc_count, sum(c)::bigint as chunk_count, sum(t)::bigint as token_count
from cut group by c0, t0, case when c0 <> c1 or t0 <> t1 then document_id end""")
def _(spark, sf):
    sizes = V.chunks(spark, sf).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum("token_count").alias("token_count"))
    return C.batch_totals(C.pack_batches(sizes, 400, 20000))


@query("e9_greedy_batches", """with recursive sizes as (select document_id, count(*)::bigint as c, sum(token_count)::bigint as t,
    row_number() over (order by document_id) as i from chunks group by 1),
  walk(i, document_id, batch, c, t, used_c, used_t) as (
    select i, document_id, document_id, c, t, c, t from sizes where i = 1
    union all
    select s.i, s.document_id, case when used_c + s.c > 400 or used_t + s.t > 20000 then s.document_id else batch end, s.c, s.t,
      case when used_c + s.c > 400 or used_t + s.t > 20000 then s.c else used_c + s.c end,
      case when used_c + s.c > 400 or used_t + s.t > 20000 then s.t else used_t + s.t end
    from walk w join sizes s on s.i = w.i + 1)
select document_id, batch, c as chunk_count, t as token_count from walk""")
def _(spark, sf):
    """Each batch as full as both limits allow, exactly as one pass by id would fill it."""
    sizes = V.chunks(spark, sf).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum("token_count").alias("token_count"))
    return greedy_batches(sizes, 400, 20000)


_NEW_IDS = """(select distinct cast(l_partkey + 500 as varchar) as pmc_id from lineitem)"""


def _found(spark, sf):
    return V.table(spark, sf, "lineitem").select((F.col("l_partkey") + 500).cast("string").alias("pmc_id"))


@query("g1_insert_ignore", f"""select pmc_id, fetch_status, priority::bigint as priority from papers
union all select pmc_id, 'pending', 50 from {_NEW_IDS} where pmc_id not in (select pmc_id from papers)""")
def _(spark, sf):
    return C.collect_ids(V.papers(spark, sf), _found(spark, sf)).select(
        "pmc_id", "fetch_status", F.col("priority").cast("long").alias("priority"))


@query("g2_insert_or_reset", f"""select coalesce(p.pmc_id, n.pmc_id) as pmc_id,
  case when n.pmc_id is not null then 'wont_fetch' else fetch_status end as fetch_status,
  case when p.pmc_id is null then 50 else priority end::bigint as priority
from papers p full join {_NEW_IDS} n on p.pmc_id = n.pmc_id""")
def _(spark, sf):
    return C.collect_ids(V.papers(spark, sf), _found(spark, sf), "wont_fetch", True).select(
        "pmc_id", "fetch_status", F.col("priority").cast("long").alias("priority"))


@query("g3_upsert_documents", """with incoming as (select 'pmc' as source, cast(p_partkey * 2 as varchar) as source_id,
    case when p_partkey % 3 = 0 then 'again ' else '' end || p_name as title from part),
  fresh as (select i.*, row_number() over (order by md5(source || '|' || source_id)) as n from incoming i
    where source_id not in (select source_id from docs))
select document_id, source_id, coalesce(i.title, d.title) as title, priority::bigint as priority,
  case when i.title is not null then 'fetched' else ingestion_status end as ingestion_status
from docs d left join incoming i using (source_id)
union all
select (select max(document_id) from docs) + n, source_id, title, 50, 'fetched' from fresh""")
def _(spark, sf):
    incoming = V.table(spark, sf, "part").select(
        F.lit("pmc").alias("source"), (F.col("p_partkey") * 2).cast("string").alias("source_id"),
        F.col("p_name").alias("title"), F.lit(1).alias("landed"))
    again = incoming.where(F.col("source_id").cast("long") % 3 == 0).withColumns(
        {"title": F.concat(F.lit("again "), "title"), "landed": F.lit(2)})
    return keyed.upsert_documents(V.slim_docs(spark, sf), incoming.unionByName(again), order="landed").select(
        "document_id", "source_id", "title", F.col("priority").cast("long").alias("priority"), "ingestion_status")


@query("g4_replace_children", """select document_id, chunk_index::bigint as chunk_index, 'old' as made from vec_chunks
where document_id not in (select document_id from docs where ingestion_status = 'fetched')
union all select document_id, chunk_index::bigint, 'new' from chunks
where document_id in (select document_id from docs where ingestion_status = 'fetched')""")
def _(spark, sf):
    work = V.slim_docs(spark, sf).where("ingestion_status = 'fetched'").select("document_id")
    pick = lambda df, m: df.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                                   F.lit(m).alias("made"))
    new = pick(V.chunks(spark, sf), "new").join(work, "document_id", "left_semi")
    return keyed.replace_children(pick(V.vec_chunks(spark, sf), "old"), new, work, "document_id")


@query("g5_set_fetch_status", """select pmc_id, case when fetch_status = 'wont_fetch' and p.pmid > 0 and m.nih_percentile >= 70
  then 'pending' else fetch_status end as fetch_status from papers p left join metrics m on p.pmid = m.pmid""")
def _(spark, sf):
    return C.set_fetch_status(V.papers(spark, sf), V.metrics(spark, sf), "wont_fetch", "pending", min_percentile=70) \
        .select("pmc_id", "fetch_status")


@query("g6_set_priority", """select pmc_id, case when pmc_id in (select cast(l_partkey as varchar) from lineitem
  where l_quantity > 49) then 100 else priority end::bigint as priority from papers""")
def _(spark, sf):
    ids = V.table(spark, sf, "lineitem").where("l_quantity > 49").select(
        F.col("l_partkey").cast("string").alias("pmc_id"))
    return C.set_priority(V.papers(spark, sf), ids, 100).select("pmc_id", F.col("priority").cast("long").alias("priority"))


@query("g7_missing_ids", """select distinct cast(o_custkey as varchar) as pmc_id from orders
where cast(o_custkey as varchar) not in (select pmc_id from papers where pmid is not null)""")
def _(spark, sf):
    asked = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("pmc_id"))
    return keyed.missing(asked, V.papers(spark, sf).where("pmid is not null"), "pmc_id")


def _converted(spark, sf):
    """A response for three of four asked ids; every fifth record lacks the pmid."""
    before = V.papers(spark, sf)
    asked = before.select("pmc_id")
    k = F.col("pmc_id").cast("long")
    response = before.where(k % 4 != 3).select(
        "pmc_id", F.when(k % 5 != 0, (k + 5000000).cast("string")).alias("pmid"),
        F.concat(F.lit("10.1/"), "pmc_id").alias("doi"))
    return before, C.apply_id_conversion(before, asked, response)


@query("g8_apply_id_conversion", """select pmc_id, case when pmid is not null then pmid
  when pmc_id::bigint % 4 <> 3 and pmc_id::bigint % 5 <> 0 then pmc_id::bigint + 5000000 else -1 end as pmid,
  case when pmid is null and pmc_id::bigint % 4 <> 3 then '10.1/' || pmc_id end as doi from papers""")
def _(spark, sf):
    return _converted(spark, sf)[1].select("pmc_id", "pmid", "doi")


@query("d23_conversion_counts", """select count(*) filter (where k % 4 <> 3 and k % 5 <> 0) as with_pmid,
  count(*) filter (where not (k % 4 <> 3 and k % 5 <> 0)) as without_pmid
from (select pmc_id::bigint as k from papers where pmid is null)""")
def _(spark, sf):
    return C.conversion_counts(*_converted(spark, sf))


@query("g13_difference", """select *, 'left' as side from (select source_id as id from docs where priority > 0
  except select pmc_id from papers where priority > 0)
union all select *, 'right' from (select pmc_id from papers where priority > 0
  except select source_id from docs where priority > 0)""")
def _(spark, sf):
    a = V.slim_docs(spark, sf).where("priority > 0").select(F.col("source_id").alias("id"))
    b = V.papers(spark, sf).where("priority > 0").select(F.col("pmc_id").alias("id"))
    return keyed.difference_report(a, b, ["id"])


@query("g14_mark_fetched", """with tries as (select cast(l_partkey as varchar) as pmc_id, bool_or(l_returnflag = 'R') as ok
  from lineitem where l_linestatus = 'O' group by all)
select pmc_id, case when ok then 'fetched' when not ok then 'failed' else fetch_status end as fetch_status
from papers left join tries using (pmc_id)""")
def _(spark, sf):
    tries = V.table(spark, sf, "lineitem").where("l_linestatus = 'O'").select(
        F.col("l_partkey").cast("string").alias("pmc_id"), (F.col("l_returnflag") == "R").alias("ok"))
    return C.mark_fetched(V.papers(spark, sf), tries).select("pmc_id", "fetch_status")


# ---- quality: a broken copy of the chunks ----

DIM = 64
_BROKEN = """broken as (
select document_id, chunk_index, section, embedding, case when document_chunk_id % 60 = 7 then '' else content end as content
  from (select * replace (case when document_chunk_id % 40 = 3 then embedding[1:32] else embedding end as embedding) from vec_chunks)
union all select document_id, chunk_index, section, embedding, content from vec_chunks where chunk_index = 0 and document_id % 25 = 0
union all select document_id + 1000000000, chunk_index, section, embedding, content from vec_chunks where document_id % 30 = 4)"""


def _broken(spark, sf):
    """Chunks with shortened vectors, blank texts, duplicates and orphans."""
    v = V.vec_chunks(spark, sf).select("document_chunk_id", "document_id", "chunk_index", "section", "content", "embedding")
    key = F.col("document_chunk_id")
    base = v.withColumns({
        "embedding": F.when(key % 40 == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")),
        "content": F.when(key % 60 == 7, F.lit("")).otherwise(F.col("content"))})
    twice = v.where((F.col("chunk_index") == 0) & (F.col("document_id") % 25 == 0))
    lost = v.where(F.col("document_id") % 30 == 4).withColumn("document_id", F.col("document_id") + 1000000000)
    return base.unionByName(twice).unionByName(lost)


@query("m1_c4_orphan_chunks", f"with {_BROKEN} select document_id, count(*) as n from broken where document_id not in "
       "(select document_id from docs) group by all")
def _(spark, sf):
    return Q.orphan_chunks(_broken(spark, sf), V.slim_docs(spark, sf)).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("m2_c5_embedded_without_vectors", f"""with {_BROKEN} select document_id, title from docs d where ingestion_status = 'embedded'
and not exists (select 1 from broken b where b.document_id = d.document_id and embedding is not null)""")
def _(spark, sf):
    return Q.embedded_without_vectors(V.slim_docs(spark, sf), _broken(spark, sf)).select("document_id", "title")


@query("f8_offender_sample", f"""with {_BROKEN} select document_id, title from docs d where ingestion_status = 'embedded'
and not exists (select 1 from broken b where b.document_id = d.document_id and embedding is not null) order by document_id limit 10""")
def _(spark, sf):
    bad = Q.embedded_without_vectors(V.slim_docs(spark, sf), _broken(spark, sf)).select("document_id", "title")
    return Q.offender_sample(bad)


@query("m3_d5_duplicate_chunks", f"""with {_BROKEN} select document_id, chunk_index::bigint as chunk_index, count(*) as copies
from broken group by all having count(*) > 1""")
def _(spark, sf):
    return Q.duplicate_chunks(_broken(spark, sf)).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("m4_d6_dimensions", f"""with {_BROKEN} select len(embedding) as dimension, count(*) as n from broken
where embedding is not null group by all""")
def _(spark, sf):
    return Q.dimension_counts(_broken(spark, sf)).withColumn("dimension", F.col("dimension").cast("long"))


@query("m5_c6_status_conflicts", f"""with {_BROKEN} select document_id, 'fetched_with_chunks' as conflict from docs
where ingestion_status = 'fetched' and document_id in (select document_id from broken)
union all select document_id, 'chunked_with_embeddings' from docs where ingestion_status = 'chunked'
and document_id in (select document_id from broken where embedding is not null)""")
def _(spark, sf):
    return Q.status_conflicts(V.slim_docs(spark, sf), _broken(spark, sf))


@query("m6_d3_null_counts", f"""with {_BROKEN} select unnest(['title', 'source', 'source_id', 'content', 'section']) as field,
  unnest([count(*) filter (where title is null), count(*) filter (where source is null), count(*) filter (where source_id is null),
  (select count(*) from broken where content is null or content = ''), (select count(*) from broken where section is null)]) as n
from docs""")
def _(spark, sf):
    return Q.null_counts(V.slim_docs(spark, sf), _broken(spark, sf)).withColumn(
        "field", F.replace("field", F.lit("null_"), F.lit("")))


@query("m7_d4_length_stats", """select count(*) as total, count(*) filter (where n < 50) as very_short,
  count(*) filter (where n > 5000) as very_long, round(sum(n)::double / count(*))::bigint as avg_length,
  min(n) as min_length, max(n) as max_length, count(*) filter (where n < 50) > 0.05 * count(*) as short_warning,
  count(*) filter (where n > 5000) > 0.01 * count(*) as long_warning from (select length(content) as n from chunks)""")
def _(spark, sf):
    s = Q.length_stats(V.chunks(spark, sf))
    return s.withColumns({c: F.col(c).cast("long") for c in ("min_length", "max_length")})


@query("m8_corpus_stats", """select (select count(*) from docs) as documents,
  (select count(*) from docs where ingestion_status = 'fetched') as fetched,
  (select count(*) from docs where ingestion_status = 'chunked') as chunked,
  (select count(*) from docs where ingestion_status = 'embedded') as embedded, count(*) as chunks,
  count(embedding) as with_embedding, count(*) - count(embedding) as without_embedding,
  round(count(*)::double / (select count(*) from docs), 4) as avg_chunks_per_doc from vec_chunks""")
def _(spark, sf):
    return Q.corpus_stats(V.slim_docs(spark, sf), V.vec_chunks(spark, sf))


@query("m_audit", f"""with {_BROKEN}, s as (select count(*) as n, count(embedding) as vec, count(*) filter (where len(embedding) <> 64) as bad,
    count(*) filter (where content = '') as blank, count(*) filter (where section is null) as nosec,
    count(*) filter (where length(content) < 50) as short, count(*) filter (where length(content) > 5000) as long,
    count(*) filter (where document_id not in (select document_id from docs)) as orph,
    count(distinct (document_id, chunk_index)) as keys from broken),
  x as (select d.*, exists (select 1 from broken b where b.document_id = d.document_id) as has,
    exists (select 1 from broken b where b.document_id = d.document_id and embedding is not null) as hasvec from docs d),
  t as (select count(*) as docs_n, count(*) filter (where ingestion_status = 'embedded') as emb,
    count(*) filter (where ingestion_status = 'embedded' and not hasvec) as bare,
    count(*) filter (where (ingestion_status = 'fetched' and has) or (ingestion_status = 'chunked' and hasvec)) as conf from x),
  r as (select unnest([
    {{'check': 'orphan_chunks', 'severity': 'error', 'n_bad': orph, 'n_total': n}},
    {{'check': 'embedded_without_vectors', 'severity': 'error', 'n_bad': bare, 'n_total': emb}},
    {{'check': 'duplicate_chunks', 'severity': 'error', 'n_bad': (select count(*) from (select 1 from broken
       group by document_id, chunk_index having count(*) > 1)), 'n_total': keys}},
    {{'check': 'embedding_dimension', 'severity': 'error', 'n_bad': bad, 'n_total': vec}},
    {{'check': 'status_conflicts', 'severity': 'warning', 'n_bad': conf, 'n_total': docs_n}},
    {{'check': 'null_document_fields', 'severity': 'error', 'n_bad': 0, 'n_total': docs_n}},
    {{'check': 'empty_content', 'severity': 'error', 'n_bad': blank, 'n_total': n}},
    {{'check': 'null_section', 'severity': 'warning', 'n_bad': nosec, 'n_total': n}},
    {{'check': 'very_short_chunks', 'severity': 'info', 'n_bad': short, 'n_total': n}},
    {{'check': 'very_long_chunks', 'severity': 'info', 'n_bad': long, 'n_total': n}}]) as k from s, t)
select k['check'] as "check", k['severity'] as severity, k['n_bad'] as n_bad, k['n_total'] as n_total,
  k['n_bad'] = 0 or k['severity'] <> 'error' as passed from r""")
def _(spark, sf):
    return Q.audit(V.slim_docs(spark, sf), _broken(spark, sf), DIM)


@query("c14_fetched_without_chunks", """select document_id from docs where ingestion_status = 'fetched'
and document_id not in (select document_id from vec_chunks)""")
def _(spark, sf):
    return Q.fetched_without_chunks(V.slim_docs(spark, sf), V.vec_chunks(spark, sf)).select("document_id")


@query("d15_ingestion_report", """select count(n) as success, count(*) - count(n) as failed, coalesce(sum(n), 0)::bigint as total_chunks,
  round(coalesce(avg(n), 0), 4) as avg_chunks_per_doc
from (select document_id from docs where ingestion_status = 'fetched') left join
  (select document_id, count(*) as n from vec_chunks group by all) using (document_id)""")
def _(spark, sf):
    return Q.ingestion_report(V.slim_docs(spark, sf), V.vec_chunks(spark, sf))


# ---- graph ----

@query("n1_h20_citation_edges", """select distinct pmid as citing, trim(x)::bigint as referenced
from (select pmid, unnest(string_split(refs, ',')) as x from metrics)""")
def _(spark, sf):
    return graph.citation_edges(V.metrics(spark, sf))


@query("n2_cocited_with", """select s.referenced as seed, o.referenced as other, count(*) as n from edges s join edges o using (citing)
where s.referenced in (select item_id from benchmark) and s.referenced <> o.referenced group by all""")
def _(spark, sf):
    seeds = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("seed"))
    return graph.cocited_with(seeds, V.edges(spark, sf))


@query("n3_key_authors", """select author, sum(citation_count)::bigint as citations, count(*) as papers
from (select distinct pmid, citation_count, trim(a) as author from (select *, unnest(string_split(authors, ',')) as a from metrics))
group by all order by citations desc, author limit 20""")
def _(spark, sf):
    return graph.key_authors(V.metrics(spark, sf))


@query("m_live_chunks", """select document_chunk_id from vec_chunks join docs using (document_id) where priority > 0""")
def _(spark, sf):
    return live_chunks(V.vec_chunks(spark, sf), V.slim_docs(spark, sf)).select("document_chunk_id")
