"""SQL definitions of the fixture tables, written for the oracle engine; independent of the Spark plans."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["papers"] = """
select cast(p_partkey as varchar) as pmc_id,
  case p_partkey % 20 when 0 then null when 1 then -1 else 1000000 + p_partkey end as pmid,
  case when p_partkey % 7 = 0 then 50.0::double end as nih_percentile,
  case p_size % 4 when 0 then 'pending' when 1 then 'wont_fetch' when 2 then 'fetched' else 'failed' end as fetch_status,
  case p_size % 5 when 0 then 0 when 1 then 10 when 4 then 100 else 50 end as priority,
  p_name || ' ' || lower(p_type) as title,
  case p_size % 4 when 0 then 'Research Support' when 1 then 'Review' when 2 then 'Trial' else 'Letter' end as pub_type,
  p_size % 3 <> 0 as open_access,
  date '2020-01-01' + cast(p_size * 40 as integer) as pub_date
from part"""

VIEWS["metrics"] = """
select 1000000 + l_partkey as pmid, min(year(l_shipdate)) as "year", count(*) as citation_count,
  case when l_partkey % 17 <> 0 then (l_partkey * 7919 % 10000) / 100.0::double end as nih_percentile,
  round(avg(l_quantity) / 25.5::double, 6) as relative_citation_ratio,
  l_partkey % 3 <> 0 as is_research_article, l_partkey % 4 = 0 as is_clinical,
  'Author ' || min(l_suppkey) || ', Author ' || max(l_suppkey) as authors, 'J' || (l_partkey % 7) as journal,
  (1000000 + l_partkey + 1) || ',' || (1000000 + l_partkey + 2) || ', ' || (1000000 + l_partkey * 2) as refs
from lineitem group by l_partkey"""

VIEWS["edges"] = "select distinct l_orderkey as citing, l_partkey as referenced from lineitem"

VIEWS["doclines"] = """
select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as lines from documents"""

VIEWS["docparts0"] = """
select doc_id, unnest(range(1, len(lines) + 1)) as pos, unnest(lines) as text from doclines"""

VIEWS["docparts"] = """
select doc_id, pos, section, text, base_at + length(section) + 1 as char_start,
  base_at + length(section) + 1 + length(text) as char_end
from (select *, coalesce(sum(length(section) + length(text) + 3) over (partition by doc_id order by pos
    rows between unbounded preceding and 1 preceding), 0)::bigint as base_at
  from (select doc_id, pos, text, case pos when 1 then 'title' when 2 then 'abstract' else
      ['introduction', 'methods', 'results', 'discussion', 'conclusion'][(pos - 3) % 5 + 1]
      || case when pos < 8 then '' else '_' || ((pos - 3) // 5) end end as section from docparts0))"""

VIEWS["docs"] = """
select d.doc_id as document_id, 'pmc' as source, cast(d.doc_id as varchar) as source_id, l.lines[1] as title,
  coalesce(l.lines[2], '') as abstract,
  d.doc_id % 11 <> 0 as has_meta, d.lang as author, d.source as journal,
  '2024-01-' || lpad(cast(d.doc_id % 28 + 1 as varchar), 2, '0') as pub_date,
  case when b.toxic = 1 then 0 when b.quality = 1 then 100 when b.quality = 0 then 10 else 50 end as priority,
  case d.doc_id % 3 when 0 then 'fetched' when 1 then 'chunked' else 'embedded' end as ingestion_status
from documents d join doclines l using (doc_id) left join labels b using (doc_id)"""

VIEWS["sectokens"] = """
select doc_id, pos, section, char_start, regexp_extract_all(text, '\\S+\\s*') as toks
from (select doc_id, pos, section, char_start, trim(text) as text from docparts where pos > 1
  union all
  select doc_id, 1, 'N/A', 0, lines[1] from doclines where len(lines) = 1)"""

VIEWS["chunks"] = """
select (document_id << 24) + chunk_index as document_chunk_id, * from (
  select doc_id as document_id, section, row_number() over (partition by doc_id order by pos, s) - 1 as chunk_index,
    array_to_string(toks[s + 1 : s + 64], '') as content,
    char_start + length(array_to_string(toks[1 : s], '')) as char_start,
    char_start + length(array_to_string(toks[1 : s + 64], '')) as char_end,
    least(len(toks) - s, 64) as token_count
  from (select *, unnest(range(0, greatest(len(toks) - 9, 0) + 1, 56)) as s from sectokens where len(toks) > 0))"""

VIEWS["vec_chunks"] = """
select vec_id as document_chunk_id, vec_id // 5 as document_id, vec_id % 5 as chunk_index,
  ['abstract', 'methods', 'results', 'discussion', 'conclusions', 'introduction', 'background', 'limitation notes',
   'ethics', null][label + 1] as section,
  case when vec_id % 50 <> 49 then embedding::double[] end as embedding, d.text as content
from embeddings e join documents d on d.doc_id = e.vec_id // 5"""

VIEWS["questions"] = """
select item_id as query_id, text as qtext, embedding::double[] as qvec
from benchmark join embeddings on vec_id = item_id"""

VIEWS["scored"] = """
select q.query_id, q.qtext, c.document_chunk_id, c.document_id, c.section, c.content,
  list_cosine_similarity(q.qvec, c.embedding) as sim
from questions q, vec_chunks c join docs d using (document_id)
where d.priority > 0 and c.embedding is not null"""

VIEWS["top10"] = """
select *, row_number() over (partition by query_id order by sim desc, document_chunk_id) as rank
from scored qualify row_number() over (partition by query_id order by sim desc, document_chunk_id) <= 10"""

VIEWS["answers"] = """
select d.doc_id, d.text as answer, b.item_id, b.text as reference
from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark)"""

VIEWS["messages"] = """
select conv_id, 'anon_' || (conv_id % 7) as user_id, turn, role,
  case when role = 'assistant' then '## Answer: ' || text || ' [PMC' || a || ', PMC' || ((a + turn % 3) % 100)
    || '] [PMC' || ((a + 50) % 100) || '] [3]' || chr(10) || '## References:' || chr(10) || '[PMC' || a || '] x'
    else text end as content, text,
  1704067200 + conv_id * 3600 + turn * 60 as ts, a
from (select *, (conv_id * 7 + turn * 3) % 100 as a from conversations)"""

VIEWS["turn_chunks"] = """
select conv_id, turn, rank, cast(src as varchar) as source_id, src * 5 + rank // 5 as chunk_id,
  'Title ' || src as title, 'J' || (src % 7) as journal
from (select conv_id, turn, rank, (conv_id * 7 + turn * 3 + rank % 5) % 100 as src
  from conversations, range(6) r(rank) where role = 'assistant')"""

# The valid citations follow from how the answers are built: a and b are always retrieved, a first; c never is.
VIEWS["turn_cites"] = """
select conv_id, turn, 0 as pos, a as src from messages where role = 'assistant'
union all
select conv_id, turn, 1, (a + turn % 3) % 100 from messages where role = 'assistant' and turn % 3 <> 0"""

VIEWS["citations"] = """
select conv_id, row_number() over (partition by conv_id order by turn, pos) as number, cast(src as varchar) as source_id,
  turn, pos, src * 5 + case when pos = 0 then 1 else 0 end as chunk_id, 'Title ' || src as title
from (select conv_id, src, turn, pos from turn_cites
  qualify row_number() over (partition by conv_id, src order by turn, pos) = 1)"""

VIEWS["answer_tokens"] = """
select conv_id, turn, ts, content, regexp_extract_all(content, '\\S+\\s*') as toks,
  40 + (conv_id + turn) % 7 + case when (conv_id + turn) % 10 = 7 then 4000 else 0 end as gap,
  case when (conv_id + turn) % 8 = 3 then 180000 else 0 end as stall,
  case when (conv_id + turn) % 9 = 0 then 'error' else 'complete' end as outcome
from messages where role = 'assistant'"""

VIEWS["token_events"] = """
select conv_id, turn, 0 as seq, 'start' as type, null as content, ts * 1000 as ms from answer_tokens
union all
select conv_id, turn, i + 1, 'token', toks[i + 1],
  ts * 1000 + 500 + gap * i + case when i = len(toks) - 1 then stall else 0 end
from (select *, unnest(range(len(toks))) as i from answer_tokens)
union all
select conv_id, turn, len(toks) + 1, outcome, null, ts * 1000 + 500 + gap * len(toks) + stall from answer_tokens"""

VIEWS["evaluations"] = """
select 'q_' || item_id as question_id, item_id, text as question,
  case item_id % 3 when 0 then 'yes' when 1 then 'no' else 'maybe' end as expected_answer,
  cast(item_id % 100 as varchar) as pmc_id,
  list_transform([0, 1, 2, 3, 4], lambda j: (item_id + j + case when item_id % 5 = 0 then 1 else 0 end) % 100 * 5)
    as retrieved_chunk_ids,
  case when item_id % 9 = 0 then 'no evidence [1]' else 'see [PMC' || (item_id % 100) || '] and [PMC'
    || ((item_id + 1 + 6 * (item_id % 2)) % 100) || '], again [PMC' || (item_id % 100) || ', PMC'
    || ((item_id + 1 + 6 * (item_id % 2)) % 100) || ']' end as raw_llm_response,
  (1000 + (item_id * 37) % 50000)::double as response_time_ms,
  case when item_id % 13 = 0 then 'timeout' end as error, item_id + 1000000 as pmid,
  case when item_id % 9 = 0 then 0 else item_id % 4 + 1 end as n_stored
from benchmark"""

VIEWS["eval_sources"] = """
select distinct e.question_id, d.source_id
from (select question_id, unnest(retrieved_chunk_ids) as cid from evaluations) e
join vec_chunks c on c.document_chunk_id = e.cid join docs d using (document_id)"""

VIEWS["eval_scored"] = """
select e.*, n_stored as n_cited, coalesce((select count(*) from eval_sources s where s.question_id = e.question_id
    and list_contains(e.cited, s.source_id))::double / nullif(len(cited), 0), 0) as citation_validity_rate,
  exists (select 1 from eval_sources s where s.question_id = e.question_id and s.source_id = e.pmc_id)
    as correct_article_retrieved
from (select *, list_distinct(regexp_extract_all(raw_llm_response, '\\[PMC(\\d+)\\]', 1)) as cited from evaluations) e"""

VIEWS["judgements"] = """
select 'q_' || (item_id * 9 // 10 + 3) as question_id, item_id as pos,
  case when item_id % 4 = 0 then 'INCORRECT' else 'CORRECT' end as conclusion_match,
  case when item_id % 5 = 0 then 'INCORRECT' else 'CORRECT' end as reasoning_match,
  1 + item_id % 5 as faithfulness, 1 + item_id * 2 % 5 as relevance, 1 + item_id * 3 % 5 as "precision",
  1 + item_id * 4 % 5 as recall
from benchmark"""

VIEWS["judge_last"] = """
select * from judgements qualify row_number() over (partition by question_id order by pos desc) = 1"""

VIEWS["merged"] = """
select e.question_id, e.pmid, e.expected_answer, e.correct_article_retrieved, e.citation_validity_rate, e.response_time_ms,
  e.n_cited, len(e.retrieved_chunk_ids) as num_chunks_retrieved, e.error, j.conclusion_match, j.reasoning_match,
  j.faithfulness, j.relevance, j."precision", j.recall
from eval_scored e left join judge_last j using (question_id)"""

VIEWS["requests"] = """
select conv_id || '-' || turn as request_id,
  case when conv_id % 4 = 0 then '<b>' || text || '</b> ' when conv_id % 13 = 5 then '  ' else text end as user_message,
  case when conv_id % 23 <> 7 then 'anon' || case when conv_id % 10 = 9 then '!' else '_' end || (conv_id % 7) end as user_id,
  'c' || conv_id || case when conv_id % 17 = 3 then ' x' else '' end as conversation_id,
  case when conv_id % 19 <> 4 then turn * 60 end as top_k, case when conv_id % 29 <> 3 then turn + 1 end as top_n, turn * 11 as additional_chunks_per_doc
from conversations where role = 'user'"""

_NAMES = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def with_views(sql: str) -> str:
    """Puts the definitions ``sql`` needs, directly or through others, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAMES.findall(re.sub(r"'[^']*'", "''", text))):
            if name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    sql = sql.strip()
    if not needed:
        return sql
    defined = ",\n".join(f"{n} as materialized ({VIEWS[n].strip()})" for n in needed)
    own = re.match(r"with\s+(recursive\s+)?", sql, re.IGNORECASE)
    if own is None:
        return f"with {defined}\n{sql}"
    return f"with {own.group(1) or ''}{defined},\n{sql[own.end():]}"
