"""Sources and sinks: what Spark derives from the tables is landed, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import schemas as S
from marginalia.operators import conversations as K, evaluation as E
from marginalia.operators.articles import fetch_details
from marginalia.operators.chunking import chunk_documents
from marginalia.plans import fixtures as V
from marginalia.plans.evaluating import _cited, _merged, _scored
from marginalia.plans.registry import query
from marginalia.plans.texts import _BODY_TABLE, _SQUEEZE, article_xml
from marginalia.session import scratch_path, stored
from marginalia.sources import readers as R, writers as W
from marginalia.streaming import ingest


@query("a3_id_file", "select cast(p_partkey as varchar) as id from part")
def _(spark, sf):
    path = scratch_path(spark, "ids")
    lines = V.table(spark, sf, "part").select(F.explode(F.array(
        F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit(" ")), F.lit(" "))).alias("line"))
    W.write_ids(lines, "line", path)
    return R.read_ids(spark, path)


def _search_pages(spark, sf):
    """Result pages of 100 ids each; the first id of a page also ends the page before."""
    path = scratch_path(spark, "search")
    key = F.col("p_partkey")
    ids = V.table(spark, sf, "part").select(key, F.explode(F.array_distinct(F.array(
        F.expr("p_partkey div 100"), F.expr("greatest(p_partkey - 1, 0) div 100")))).alias("page"))
    total = V.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n")).scalar()
    pages = ids.groupBy("page").agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    pages.select(F.struct(
        total.cast("string").alias("count"), (F.col("page") * 100).cast("string").alias("retstart"),
        F.col("keys").cast("array<string>").alias("idlist")).alias("esearchresult")).write.json(path)
    return path


@query("a4_search_pages", "select cast(p_partkey as varchar) as pmc_id from part")
def _(spark, sf):
    return R.read_search_pages(spark, _search_pages(spark, sf))


@query("a4_search_count", "select count(*) as total from part")
def _(spark, sf):
    return R.search_count(spark, _search_pages(spark, sf))


@query("a7_id_conversion", """select cast(p_partkey as varchar) as pmc_id, case when p_partkey % 5 <> 0 then cast(p_partkey + 7 as varchar) end as pmid,
  '10.1/' || p_partkey as doi from part""")
def _(spark, sf):
    path = scratch_path(spark, "conversion")
    key = F.col("p_partkey")
    record = F.struct(F.concat(F.lit("PMC"), key).alias("pmcid"), F.when(key % 5 != 0, (key + 7).cast("string")).alias("pmid"),
                      F.concat(F.lit("10.1/"), key).alias("doi"))
    V.table(spark, sf, "part").select(F.array(record).alias("records")).write.json(path)
    return R.read_id_conversion(spark, path, multi_line=False)


def _qa_file(spark, sf):
    """Question records keyed by pmid, one object per line."""
    path = scratch_path(spark, "qa")
    i = F.col("item_id")
    record = F.struct(
        F.col("text").alias("QUESTION"), F.transform(F.sequence(F.lit(0), i % 4), lambda j: j.cast("string")).alias("CONTEXTS"),
        F.array(F.lit("m1"), F.concat(F.lit("m"), i)).alias("MESHES"), F.when(i % 3 != 0, F.lit("2020")).alias("YEAR"),
        F.concat(F.lit("long, \"quoted\"\n"), F.col("text")).alias("LONG_ANSWER"), V.pick(("yes", "no", "maybe"), i % 3).alias("final_decision"))
    lines = V.table(spark, sf, "benchmark").select(F.to_json(F.create_map((1000000 + i).cast("string"), record)).alias("line"))
    W.write_text(lines, "line", path)
    return path


@query("a8_qa_dataset", """select cast(1000000 + item_id as varchar) as pmid, text as question, item_id % 4 + 1 as contexts from benchmark""")
def _(spark, sf):
    rows = R.read_qa_dataset(spark, _qa_file(spark, sf), whole_file=False)
    return rows.select("pmid", F.col("r.QUESTION").alias("question"), F.size("r.CONTEXTS").cast("long").alias("contexts"))


@query("i15_c8_a9_golden_dataset", """select 'pubmedqa_' || pmid as question_id, pmc_id, text as question, case item_id % 3 when 0 then 'yes' when 1 then 'no' else 'maybe' end
  as expected_answer, md5('long, "quoted"' || chr(10) || text) as long_answer, case when item_id % 3 <> 0 then '2020' end as "year",
  'm1|m' || item_id as meshes, item_id % 4 + 1 as num_contexts from benchmark b join papers on pmid = 1000000 + item_id""")
def _(spark, sf):
    """Built from the question file and the paper ids, written as CSV and read back."""
    path = scratch_path(spark, "golden")
    mapping = V.papers(spark, sf).where("pmid > 0").select(F.col("pmid").cast("string").alias("pmid"), "pmc_id")
    W.write_csv(E.golden_dataset(R.read_qa_dataset(spark, _qa_file(spark, sf), whole_file=False), mapping), path)
    return R.read_golden(spark, path).select(
        "question_id", "pmc_id", "question", "expected_answer", F.md5("long_answer").alias("long_answer"), "year", "meshes",
        F.col("num_contexts").cast("long").alias("num_contexts"))


@query("a10_a12_result_files", """select question_id, correct_article_retrieved, conclusion_match from merged""")
def _(spark, sf):
    auto, judge = scratch_path(spark, "auto"), scratch_path(spark, "judge")
    scored = _scored(spark, sf)
    W.write_results(scored.select("question_id", "pmc_id", "raw_llm_response", "retrieved_chunk_ids", "correct_article_retrieved",
                                  "citation_validity_rate", "response_time_ms", "error"), auto)
    # the position within the judge's list travels as a number, since files have no order among themselves
    W.write_results(V.judgements(spark, sf).withColumn("notes", F.col("pos").cast("string")).drop("pos"), judge, "evaluations")
    rows = R.read_judge_results(spark, judge).withColumn("pos", F.col("notes").cast("long")).drop("notes")
    return E.merge_judgements(R.read_auto_results(spark, auto), rows).select(
        "question_id", "correct_article_retrieved", "conclusion_match")


@query("a12_metrics_csv", """select count(*) as n, count(*) filter (where correct_article_retrieved) as hits, count(conclusion_match) as judged from merged""")
def _(spark, sf):
    path = scratch_path(spark, "metrics-csv")
    rows = E.metrics_rows(_merged(spark, sf))
    W.write_csv(rows, path)
    back = spark.read.schema(rows.schema).csv(path, header=True)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if("correct_article_retrieved").alias("hits"),
                    F.count("conclusion_match").alias("judged"))


@query("a12_judge_prompt_text", "select count(*) as blocks from evaluations")
def _(spark, sf):
    path = scratch_path(spark, "prompt")
    results = V.evaluations(spark, sf).withColumns({"long_answer": F.col("question"), "rag_answer": F.col("raw_llm_response")})
    rich = E.enrich_citations(_cited(spark, sf), V.vec_chunks(spark, sf), V.slim_docs(spark, sf), V.papers(spark, sf))
    W.write_text(E.judge_blocks(results, rich), "block", path)
    return spark.read.text(path).agg(F.count_if(F.col("value").startswith("## Question ")).alias("blocks"))


@query("a11_metrics_snapshot", """select "year"::bigint as "year", count(*) as n, sum(citation_count)::bigint as citations, count(nih_percentile) as ranked
from metrics group by all""")
def _(spark, sf):
    """The snapshot file is read with its fixed schema and stored sorted by pmid."""
    csv, table = scratch_path(spark, "snapshot"), scratch_path(spark, "metrics")
    m = V.metrics(spark, sf)
    W.write_csv(m.select(*[F.col(f.name) if f.name in m.columns else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in S.METRICS.fields]), csv)
    W.write_table(R.read_metrics_snapshot(spark, csv).repartitionByRange("pmid"), table, sort_by=["pmid"])
    return spark.read.parquet(table).groupBy(F.col("year").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("citation_count").alias("citations"), F.count("nih_percentile").alias("ranked"))


@query("a13_a16_stream_log", """select conv_id || '-' || turn as conversation_id, 500 as time_to_first_token, len(toks) - 1 as total_tokens,
  gap * len(toks) + stall as total_stream_time from answer_tokens where outcome = 'complete' and len(toks) > 1""")
def _(spark, sf):
    """Metrics appended to the log in two runs, then read back as a table."""
    path = scratch_path(spark, "stream-log")
    m = K.stream_metrics(V.token_events(spark, sf)).withColumn("conversation_id", F.concat_ws("-", "conv_id", "turn"))
    for half in (0, 1):
        W.append_log(m.where(F.col("conv_id") % 2 == half).select(W.metrics_line()), path)
    return R.read_stream_log(spark, path).select(
        "conversation_id", "time_to_first_token", "total_tokens", "total_stream_time")


@query("a14_chunk_and_flip", """select d.document_id, case when ingestion_status = 'fetched' then 'chunked' else ingestion_status end as ingestion_status,
  count(c.document_id) as chunks from docs d left join (select * from chunks where document_id in
  (select document_id from docs where ingestion_status = 'fetched')) c using (document_id) group by all""")
def _(spark, sf):
    """Chunks of the fetched documents and the status of those that gave some, in one commit; a writer that began earlier loses."""
    from marginalia.operators.keyed import set_where_listed
    from marginalia.sources import catalog

    path = scratch_path(spark, "catalog")
    docs = V.docs(spark, sf)
    status = docs.select("document_id", "ingestion_status")
    begun = catalog.commit(spark, catalog.snapshot(spark, path), {"documents": status})
    made = stored(chunk_documents(docs.where("ingestion_status = 'fetched'"), V.SIZE, V.OVERLAP), "chunks")
    flipped = set_where_listed(begun.read(spark, "documents"), made, "document_id", {"ingestion_status": "chunked"})
    catalog.commit(spark, begun, {"chunks": made, "documents": flipped})
    try:
        catalog.commit(spark, begun, {"documents": status.withColumn("ingestion_status", F.lit("failed"))})
    except catalog.Conflict:
        pass
    now = catalog.snapshot(spark, path)
    n = now.read(spark, "chunks").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return now.read(spark, "documents").join(n, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


@query("a12_id_map_json", "select pmid, pmc_id from papers where pmid > 0")
def _(spark, sf):
    path = scratch_path(spark, "id-map")
    V.papers(spark, sf).where("pmid > 0").select("pmid", "pmc_id").write.json(path)
    return spark.read.schema("pmid bigint, pmc_id string").json(path)


@query("g12_missing_conversions", """select cast(p_partkey as varchar) as pmid from part where 1000000 + p_partkey not in
(select pmid from papers where pmid is not null)""")
def _(spark, sf):
    from marginalia.operators.keyed import missing

    asked = V.table(spark, sf, "part").select((F.col("p_partkey") + 1000000).alias("pmid"))
    out = missing(asked, V.papers(spark, sf).where("pmid is not null"), "pmid")
    return out.select((F.col("pmid") - 1000000).cast("string").alias("pmid"))


@query("l6_incremental_ingest", """select document_id, count(*) as chunks, sum(token_count)::bigint as tokens from chunks group by all""")
def _(spark, sf):
    """Articles land twice, first with a provisional text; the newest version of each counts.

    A second stream then brings older copies late; all versions are compacted.
    """
    landing, out = scratch_path(spark, "landed"), scratch_path(spark, "ingested")
    docs = V.docs(spark, sf).select(F.col("document_id").cast("string").alias("source_id"), "title", "abstract", "full_text",
                                    "section_offsets")
    draft = docs.withColumn("full_text", F.upper("full_text")).withColumn("landed_at", F.timestamp_seconds(F.lit(1)))
    draft.write.option("compression", "zstd").parquet(landing)
    first, second = scratch_path(spark, "ingest-state"), scratch_path(spark, "ingest-state")

    def run(folder, checkpoint):
        stream = spark.readStream.schema(ingest.LANDED).parquet(folder)
        ingest.start_ingest(stream, out, checkpoint, V.SIZE, V.OVERLAP).awaitTermination()

    run(landing, first)
    docs.withColumn("landed_at", F.timestamp_seconds(F.lit(2))).write.mode("append").option("compression", "zstd").parquet(landing)
    run(landing, first)
    late = scratch_path(spark, "landed-late")
    draft.withColumn("landed_at", F.timestamp_seconds(F.lit(0))).write.option("compression", "zstd").parquet(late)
    run(late, second)
    small = scratch_path(spark, "compacted")
    ingest.compact(spark, out, small)
    return ingest.current_chunks(spark, small).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))


@query("l6_landed_once_stream", """select document_id, case when document_id % 2 = 0 then 264 else 1 end as hour, count(*) as chunks,
  sum(token_count)::bigint as tokens from chunks group by all""")
def _(spark, sf):
    """Repeats within a day of the first arrival are left out of the ingest, and so are rows later than the watermark.

    All documents land, land again an hour later, and odd ones after ten days, which ends the first day's memory. Even ones
    that land after that count as new; a last delivery carries the times of the first day and is too late.
    """
    landing, out, state = scratch_path(spark, "landed-once"), scratch_path(spark, "ingested-once"), scratch_path(spark, "once-state")
    docs = V.docs(spark, sf).select("document_id", F.col("document_id").cast("string").alias("source_id"), "title", "abstract",
                                    "full_text", "section_offsets")
    even = F.col("document_id") % 2 == 0
    odd = docs.where(~even)
    # all, repeats, a reminder that moves the watermark, newer copies, late rows
    for rows, at in ((docs, 1), (docs, 2), (odd, 240), (docs.where(even), 264), (docs, 3)):
        rows.drop("document_id").withColumn("landed_at", F.timestamp_seconds(F.lit(at * 3600))) \
            .write.mode("append").option("compression", "zstd").parquet(landing)
        arrivals = ingest.first_arrivals(ingest.places(spark.readStream.schema(ingest.LANDED).parquet(landing)))
        ingest.start_ingest(arrivals, out, state, V.SIZE, V.OVERLAP).awaitTermination()
    small = scratch_path(spark, "compacted-once")
    ingest.compact(spark, out, small)
    chunks = ingest.current_chunks(spark, small).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
    hour = (F.unix_timestamp("landed_at") / 3600).cast("long").alias("hour")
    return ingest.current_documents(spark, small).select("document_id", hour).join(chunks, "document_id")


@query("a5_landed_files", f"""with d as (select *, source = 'src3' as cut, doc_id in (select doc_id from labels) as known,
    case when doc_id % 5 = 0 then '' else {_SQUEEZE.format('lines[1]')} end as head from doclines join documents using (doc_id)),
  landed as (select *, case when not known then 0 when not cut then 1 when doc_id % 2 = 0 then 2 else 0 end as run from d)
select doc_id::varchar as pmc_id, run, case when run > 0 then coalesce(nullif(head, ''), 'Summary title') end as title,
  case when run > 0 then source end as journal, case when run = 0 then cut and (doc_id % 2 = 1) end as malformed, case when run > 0 then
  md5(case when head <> '' then 'TITLE' || chr(10) || head || chr(10) || chr(10) else '' end
    || case when len(lines) > 1 then 'ABSTRACT' || chr(10) || {_SQUEEZE.format('lines[2]')} || chr(10) || chr(10) else '' end
    || coalesce((select string_agg(upper(section) || chr(10) || {_SQUEEZE.format('text')}, chr(10) || chr(10) order by pos)
      || chr(10) || chr(10) from docparts p where p.doc_id = l.doc_id and pos > 2), '')
    || 'TABLE' || chr(10) || {_BODY_TABLE}) end as full_text from landed l""")
def _(spark, sf):
    """Article files land, those of one source cut off; half of these land again whole, and only the new files are read.

    Every fifth article has no title of its own. What failed in the end comes with its reason.
    """
    files, notes = scratch_path(spark, "article-files"), scratch_path(spark, "article-summaries")
    articles = V.articles(spark, sf)
    title = F.when(F.col("document_id") % 5 == 0, "").otherwise(F.col("title"))
    whole = stored(article_xml(articles.withColumn("title", title)).join(articles.select("document_id", "source"), "document_id"), "xml")
    cut = F.col("source") == "src3"
    W.write_articles(whole.withColumn("xml", F.when(cut, F.expr("left(xml, length(xml) - 9)")).otherwise(F.col("xml"))), files)
    V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id", "left_semi").select(
        F.concat(F.lit("PMC"), "doc_id").alias("Id"), F.lit("Summary title").alias("Title"), F.array("lang").alias("AuthorList"),
        F.col("source").alias("FullJournalName"), F.lit("2024").alias("PubDate")).write.json(notes)
    summaries = R.read_article_summaries(spark, notes)

    def fetched(after, run):
        landed = R.read_landed_articles(spark, files, after)
        docs, failed = fetch_details(landed.drop("landed_at"), summaries)
        done = docs.select(F.col("source_id").alias("pmc_id"), F.lit(run).alias("run"), "title",
                           F.col("doc_metadata.journal").alias("journal"), F.md5("full_text").alias("full_text"))
        return stored(done, f"fetched-{run}"), failed

    first, failed = fetched(None, 1)
    failed = stored(failed, "failed-1")
    seen = R.read_landed_articles(spark, files).agg(F.max("landed_at")).first()[0]
    W.write_articles(whole.where(cut & (F.col("document_id") % 2 == 0)), files)
    second, again = fetched(seen, 2)
    # an id that landed anew is judged by its second file only
    retried = second.select("pmc_id").unionByName(again.select("pmc_id"))
    rest = failed.join(retried, "pmc_id", "left_anti").unionByName(again).select(
        "pmc_id", F.lit(0).alias("run"), (F.col("error") != "no summary").alias("malformed"))
    return first.unionByName(second).unionByName(rest, allowMissingColumns=True)


@query("d15_run_report", """select count(n) as success, count(*) - count(n) as failed, coalesce(sum(n), 0)::bigint as total_chunks,
  round(coalesce(avg(n), 0), 4) as avg_chunks_per_doc, count(*) - count(n) as remaining, coalesce(sum(n), 0) > 0 as timed, true as stored
from (select document_id from docs where ingestion_status = 'fetched') left join
  (select document_id, count(*) as n from chunks group by all) using (document_id)""")
def _(spark, sf):
    """All documents that wait are chunked in one run; its counters must agree with the table it wrote."""
    from marginalia.sources.runs import chunk_run

    path = scratch_path(spark, "chunk-run")
    report = chunk_run(V.docs(spark, sf), path, size=V.SIZE, overlap=V.OVERLAP)
    rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
    return report.withColumn("rows", rows.scalar()).select(
        "success", "failed", "total_chunks", "avg_chunks_per_doc", "remaining", F.coalesce(F.col("ms_per_chunk") > 0, F.lit(False)).alias("timed"),
        (F.col("rows") == F.col("total_chunks")).alias("stored"))


@query("a9_first_golden", """select 'pubmedqa_' || pmid as question_id, pmc_id from benchmark b join papers on pmid = 1000000 + item_id
order by question_id limit 25""")
def _(spark, sf):
    """The first questions of the golden file, in order of their ids."""
    path = scratch_path(spark, "golden-first")
    mapping = V.papers(spark, sf).where("pmid > 0").select(F.col("pmid").cast("string").alias("pmid"), "pmc_id")
    W.write_csv(E.golden_dataset(R.read_qa_dataset(spark, _qa_file(spark, sf), whole_file=False), mapping), path)
    return R.read_golden(spark, path, limit=25).select("question_id", "pmc_id")
