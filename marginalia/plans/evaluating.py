"""Scoring of answers, judgements, reports and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import evaluation as E
from marginalia.plans import fixtures as V
from marginalia.plans.registry import query


def _scored(spark, sf):
    return E.score_answers(V.evaluations(spark, sf), V.bare_vec_chunks(spark, sf), V.slim_docs(spark, sf))


def _merged(spark, sf):
    return E.merge_judgements(_scored(spark, sf), V.judgements(spark, sf))


@query("b11_successful_results", "select question_id from evaluations where error is null")
def _(spark, sf):
    return V.evaluations(spark, sf).where("error is null").select("question_id")


@query("c7_d8_answer_scores", """select question_id, correct_article_retrieved, round(citation_validity_rate, 6) as citation_validity_rate
from eval_scored""")
def _(spark, sf):
    return _scored(spark, sf).select("question_id", "correct_article_retrieved",
                                     F.round("citation_validity_rate", 6).alias("citation_validity_rate"))


@query("d14_retrieved_sources", """select question_id, string_agg(source_id, ',' order by source_id) as sources
from eval_sources group by question_id""")
def _(spark, sf):
    s = E.retrieved_sources(V.evaluations(spark, sf), V.bare_vec_chunks(spark, sf), V.slim_docs(spark, sf))
    return s.select("question_id", F.array_join(F.array_sort("sources"), ",").alias("sources"))


_SUMMARY = """select count(*) as total_questions, count(*) filter (where error is null) as successful, count(error) as errors,
  round(coalesce(avg(correct_article_retrieved::int) {w}, 0), 6) as correct_article_retrieval_rate,
  round(coalesce(avg(citation_validity_rate) {w}, 0), 6) as avg_citation_validity_rate,
  round(coalesce(avg(n_cited) {w}, 0), 6) as avg_citations_per_question,
  round(coalesce(avg(response_time_ms) {w}, 0), 6) as avg_response_time_ms from eval_scored"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("d9_summary", _SUMMARY.format(w="filter (where error is null)"))
def _(spark, sf):
    return _rounded(E.summary(_scored(spark, sf)))


@query("d10_summary_with_errors", _SUMMARY.format(w=""))
def _(spark, sf):
    return _rounded(E.summary(_scored(spark, sf), include_errors=True))


@query("d11_metric_means", """select round(avg(correct_article_retrieved::int), 6) as retrieval_accuracy,
  round(avg(citation_validity_rate), 6) as citation_validity, avg(response_time_ms) as avg_response_time_ms from eval_scored""")
def _(spark, sf):
    return _rounded(_scored(spark, sf).agg(
        F.avg(F.col("correct_article_retrieved").cast("double")).alias("retrieval_accuracy"),
        F.avg("citation_validity_rate").alias("citation_validity"), F.avg("response_time_ms").alias("avg_response_time_ms")))


@query("c9_merged_metrics", """select question_id, pmid, correct_article_retrieved, round(citation_validity_rate, 6) as citation_validity_rate,
  response_time_ms, n_cited as num_citations, num_chunks_retrieved, error, conclusion_match, reasoning_match, faithfulness, relevance,
  "precision", recall from merged""")
def _(spark, sf):
    rows = E.metrics_rows(_merged(spark, sf)).drop("pmc_id")
    return rows.withColumns({
        "citation_validity_rate": F.round("citation_validity_rate", 6),
        **{c: F.col(c).cast("long") for c in ("num_citations", "num_chunks_retrieved", "faithfulness", "relevance",
                                              "precision", "recall")}})


@query("c16_answers_with_questions", """select a.doc_id, question_id, e.question, md5(answer) as rag_answer from answers a
join evaluations e using (item_id)""")
def _(spark, sf):
    """Every document as an answer, joined to its question by question id."""
    answers = V.answers(spark, sf).select(
        "doc_id", F.concat(F.lit("q_"), "item_id").alias("question_id"), F.md5("answer").alias("rag_answer"))
    return V.evaluations(spark, sf).select("question_id", "question").join(answers, "question_id")


@query("d12_judge_summary", """select count(*) filter (where conclusion_match = 'CORRECT') as conclusion_match_correct,
  count(*) filter (where reasoning_match = 'CORRECT') as reasoning_match_correct, avg(faithfulness) as avg_faithfulness,
  avg(relevance) as avg_relevance, avg("precision") as avg_precision, avg(recall) as avg_recall from judgements""")
def _(spark, sf):
    return E.judge_summary(V.judgements(spark, sf))


@query("d13_judge_rates", """with t as (select count(*) as n from evaluations),
  j as (select count(*) filter (where conclusion_match = 'CORRECT')::double as c,
    count(*) filter (where reasoning_match = 'CORRECT')::double as r, count(distinct question_id) as k from judgements)
select round(c / n, 6) as conclusion_rate_total, round(r / n, 6) as reasoning_rate_total, round(c / k, 6) as conclusion_rate_judged,
  round(r / k, 6) as reasoning_rate_judged from t, j""")
def _(spark, sf):
    return _rounded(E.judge_rates(_scored(spark, sf), V.judgements(spark, sf)))


@query("d12_invalid_judgements", """select question_id from (select question_id, faithfulness + case when pos % 8 = 0 then 3 else 0 end as f
  from judgements) where f not between 1 and 5""")
def _(spark, sf):
    j = V.judgements(spark, sf).withColumn("faithfulness", F.col("faithfulness") + F.when(F.col("pos") % 8 == 0, 3).otherwise(0))
    return E.invalid_judgements(j).select("question_id")


@query("d16_accuracy_crosstab", """select correct_article_retrieved, count(*) filter (where conclusion_match = 'CORRECT') as correct,
  count(*) filter (where conclusion_match = 'INCORRECT') as incorrect from merged where conclusion_match is not null group by all""")
def _(spark, sf):
    return E.accuracy_crosstab(_merged(spark, sf))


@query("d17_accuracy_by_answer", """select expected_answer, count(*) filter (where conclusion_match = 'CORRECT') as correct, count(*) as n,
  round(avg((conclusion_match = 'CORRECT')::int), 6) as accuracy from merged where conclusion_match is not null group by all""")
def _(spark, sf):
    return _rounded(E.accuracy_by_answer(_merged(spark, sf)))


@query("d18_e10_accuracy_by_time", """select quartile, count(*) as n, round(avg((conclusion_match = 'CORRECT')::int), 6) as accuracy,
  min(response_time_ms) as fastest, max(response_time_ms) as slowest from (select *, ntile(4) over (order by response_time_ms,
    md5(question_id)) as quartile from merged where conclusion_match is not null) group by all""")
def _(spark, sf):
    return _rounded(E.accuracy_by_time(_merged(spark, sf)))


@query("d19_latency_percentiles", """select quantile_cont(response_time_ms, 0.5) as p50, quantile_cont(response_time_ms, 0.95) as p95
from evaluations""")
def _(spark, sf):
    return E.latency_percentiles(V.evaluations(spark, sf))


@query("d20_failure_split", """select case when correct_article_retrieved then 'reasoning' else 'retrieval' end as failure, count(*) as n,
  round(count(*) * 100.0::double / sum(count(*)) over (), 4) as percent from merged where conclusion_match = 'INCORRECT' group by 1""")
def _(spark, sf):
    return E.failure_split(_merged(spark, sf))


@query("d21_compare_runs", """with b as (select *, conclusion_match = 'CORRECT' as ok from merged),
  a as (select 'q_' || (substr(question_id, 3)::bigint + 2) as question_id, ok, citation_validity_rate, response_time_ms from b)
select coalesce(a.question_id, b.question_id) as question_id, case when not coalesce(b.ok, false) and coalesce(a.ok, false) then 'fixed'
  when coalesce(b.ok, false) and not coalesce(a.ok, false) then 'regressed' else 'unchanged' end as change,
  round(a.citation_validity_rate - b.citation_validity_rate, 6) as validity_delta, a.response_time_ms - b.response_time_ms as ms_delta
from b full join a using (question_id)""")
def _(spark, sf):
    before = _merged(spark, sf)
    # the second run: the same outcomes, moved on by two questions
    shifted = F.concat(F.lit("q_"), F.expr("cast(substring(question_id, 3) as bigint) + 2"))
    return _rounded(E.compare_runs(before, before.withColumn("question_id", shifted)))


def _cited(spark, sf):
    """Citations of each question: the first three retrieved chunks, and one unknown chunk."""
    ids = F.concat(F.slice("retrieved_chunk_ids", 1, 3), F.array(F.lit(-5).cast("long")))
    return V.evaluations(spark, sf).select("question_id", F.posexplode(ids).alias("pos", "chunk_id"))


_CITED = """cited as (select question_id, unnest([0, 1, 2, 3]) as pos,
  unnest(list_concat(retrieved_chunk_ids[1:3], [-5])) as chunk_id from evaluations),
  rich as (select c.*, coalesce(content, 'Content not available') as chunk_content,
    case when coalesce(pmid, 0) = 0 then 'Unknown' else pmid::varchar end as pmid
  from cited c left join (vec_chunks join docs using (document_id)) on document_chunk_id = chunk_id left join papers on pmc_id = source_id)"""


@query("c3_c15_enriched_citations", f"with {_CITED} select question_id, pos::bigint as pos, chunk_id, md5(chunk_content) as content, pmid from rich")
def _(spark, sf):
    out = E.enrich_citations(_cited(spark, sf), V.vec_chunks(spark, sf), V.slim_docs(spark, sf), V.papers(spark, sf))
    return out.select("question_id", F.col("pos").cast("long").alias("pos"), "chunk_id", F.md5("chunk_content").alias("content"), "pmid")


_JUDGE_SQL = E.JUDGE_BLOCK.replace("'", "''")


@query("i14_judge_blocks", f"""with {_CITED} select e.question_id, md5(printf('{_JUDGE_SQL}', e.question_id, e.question, e.expected_answer, e.question,
  e.raw_llm_response, 4, (select string_agg('[' || (pos + 1) || '] ' || chunk_content || chr(10) || chr(10), '' order by pos) from rich r
    where r.question_id = e.question_id))) as block from evaluations e""")
def _(spark, sf):
    results = V.evaluations(spark, sf).withColumns({"long_answer": F.col("question"), "rag_answer": F.col("raw_llm_response")})
    rich = E.enrich_citations(_cited(spark, sf), V.vec_chunks(spark, sf), V.slim_docs(spark, sf), V.papers(spark, sf))
    return E.judge_blocks(results, rich).withColumn("block", F.md5("block"))


_SYSTEM = "Answer from the literature only and cite it."


_PROMPTS = r"""prompts as (select query_id, 0 as part, 0 as turn, 'system' as role, 'Answer from the literature only and cite it.' as content
    from questions
  union all select conv_id, 1, turn, role, content from messages where conv_id in (select query_id from questions)
  union all select query_id, 2, 0, 'user', '<Literature>' || chr(10) || 'Below are the top ' || k
    || ' most relevant literature passages to the user''s query. Each passage starts with a unique [source_id].' || chr(10)
    || coalesce(lines, '') || '</Literature>' || chr(10) || 'User Query: ' || qtext
  from (select query_id, qtext, (select count(*) from top10 t where t.query_id = q.query_id and rank <= 5) as k,
    (select string_agg('[PMC' || source_id || '] Title: ' || title || ' | ' || regexp_replace(content, '\[[\d,\s\-]+\]', '', 'g')
      || ' | Journal: ' || case when has_meta then journal else '' end || chr(10), '' order by rank)
      from top10 t join docs using (document_id) where t.query_id = q.query_id and rank <= 5) as lines from questions q))"""


def _prompts(spark, sf):
    from marginalia.operators.retrieval import semantic_search

    q = V.questions(spark, sf)
    hits = semantic_search(q, V.vec_chunks(spark, sf), V.slim_docs(spark, sf))
    lines = hits.select("query_id", "rank", X.passage_line(
        F.col("source_id"), F.col("title"), F.col("content"), F.col("journal")).alias("line"))
    history = V.messages(spark, sf).select(F.col("conv_id").alias("query_id"), "turn", "role", "content")
    return E.prompt_messages(q, lines, history, _SYSTEM)


@query("i12_prompt_messages", f"with {_PROMPTS} select query_id, part::bigint as part, turn::bigint as turn, role, md5(content) as content "
       "from prompts")
def _(spark, sf):
    return _prompts(spark, sf).withColumns({"part": F.col("part").cast("long"), "content": F.md5("content")})


@query("i13_system_message", f"""with {_PROMPTS} select query_id, arg_max(content, part * 1000000 + turn) filter (where role = 'system') as system,
  count(*) filter (where role <> 'system') as others from prompts group by all""")
def _(spark, sf):
    system, rest = E.split_system(_prompts(spark, sf))
    return system.join(rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("others")), "query_id")


@query("j7_retrieval_evaluation", """select round(avg(hit::int), 6) as retrieval_rate, count(*) as questions from (
  select q.query_id, exists (select 1 from top10 t join docs using (document_id) where t.query_id = q.query_id and source_id = cast(q.query_id % 100 as varchar)) as hit
  from questions q)""")
def _(spark, sf):
    """Search over all questions, then scoring of what came back."""
    from marginalia.operators.retrieval import nearest_chunks

    hits = nearest_chunks(V.questions(spark, sf), V.bare_vec_chunks(spark, sf), V.slim_docs(spark, sf), 10)
    got = hits.groupBy(F.concat(F.lit("q_"), "query_id").alias("question_id")).agg(
        F.collect_list("document_chunk_id").alias("retrieved_chunk_ids"))
    results = V.evaluations(spark, sf).drop("retrieved_chunk_ids").join(got, "question_id")
    scored = E.score_answers(results, V.bare_vec_chunks(spark, sf), V.slim_docs(spark, sf))
    return scored.agg(F.round(F.avg(F.col("correct_article_retrieved").cast("double")), 6).alias("retrieval_rate"),
                      F.count(F.lit(1)).alias("questions"))
