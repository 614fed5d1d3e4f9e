"""Text functions, parsing, composition and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import articles as A, chunking as K, evaluation as E
from marginalia.operators.sequences import rouge_l
from marginalia.plans import fixtures as V
from marginalia.plans.registry import query
from marginalia.session import spread

_REF = f"(?is){X.REFERENCES_HEADING}.*$"


def _answers(spark, sf):
    return V.messages(spark, sf).where("role = 'assistant'").select("conv_id", "turn", "content")


@query("h1_strip_answer_heading", r"""select conv_id, turn, regexp_replace(regexp_replace(trim(content, E' \t\n\r'),
  '(?im)^##\s*Answer\s*:?\s*\n?', '', 'g'), '^[: \t\n]+', '') as body from messages where role = 'assistant'""")
def _(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", X.strip_answer_heading(F.col("content")).alias("body"))


@query("h2_strip_references", rf"""select conv_id, turn, regexp_replace(regexp_replace(content, '{_REF}', ''), '\s+$', '') as body
from messages where role = 'assistant'""")
def _(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", X.strip_references_section(F.col("content")).alias("body"))


@query("h3_answer_section", rf"""select conv_id, turn, regexp_replace(content, '{_REF}', '') as body from messages
where role = 'assistant'""")
def _(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", X.extract_answer_section(F.col("content")).alias("body"))


@query("h4_g11_cited_sources", r"""select conv_id, turn, array_to_string(list_distinct_ordered, ',') as sources from (
  select conv_id, turn, case when a = (a + turn % 3) % 100 then [a, (a + 50) % 100] else [a, (a + turn % 3) % 100, (a + 50) % 100]
    end as list_distinct_ordered from messages where role = 'assistant')""")
def _(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", F.array_join(X.cited_sources(F.col("content")), ",").alias("sources"))


@query("h5_renumber", r"""select conv_id, turn, regexp_replace(content, 'PMC(\d+)(\s*[,\]])', 'N\1\2', 'g') as body
from messages where role = 'assistant'""")
def _(spark, sf):
    # every id of the text is mapped to "N<id>", which a plain pattern can say as well
    ids = X.renumberable_sources(F.col("content"))
    numbers = F.map_from_arrays(ids, F.transform(ids, lambda i: F.concat(F.lit("N"), i)))
    return _answers(spark, sf).select("conv_id", "turn", X.renumber(F.col("content"), numbers).alias("body"))


@query("h6_drop_leaked_numbers", r"""select conv_id, turn, case when turn >= 3 then content
  else regexp_replace(content, '\[3\]', '', 'g') end as body from messages where role = 'assistant'""")
def _(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", X.drop_leaked_numbers(
        F.col("content"), X.is_number_up_to(F.col("turn"))).alias("body"))


@query("h7_clean_passage", r"""select conv_id, turn, regexp_replace(content, '\[[\d,\s\-]+\]', '', 'g') as body
from messages where role = 'assistant'""")
def _(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", X.clean_passage(F.col("content")).alias("body"))


@query("h8_h15_page_text", r"""select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')))
  as text from pages""")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.md5(X.normalise_space(X.strip_html(F.col("html")))).alias("text"))


@query("h9_case_and_prefix", """select doc_id, upper(replace(lines[1], 'ß', 'ss')) as up, lower(lines[1]) as low,
  substr(lines[1], 1, 100) as head from doclines""")
def _(spark, sf):
    t = F.col("title")
    return V.slim_docs(spark, sf).select(F.col("document_id").alias("doc_id"), F.upper(t).alias("up"), F.lower(t).alias("low"),
                                         F.substring(t, 1, 100).alias("head"))


@query("h10_join_and_size", """select doc_id, array_to_string(lines, '|') as joined, len(lines) as n from doclines""")
def _(spark, sf):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(lines, "|").alias("joined"),
                                                  F.size(lines).cast("long").alias("n"))


@query("h11_i9_section_recovery", """select doc_id as document_id, p - 1 as pos, section, char_start, char_end, trim(text) as text
from (select *, row_number() over (partition by doc_id order by pos) as p from docparts)""")
def _(spark, sf):
    s = K.sections_of(V.docs(spark, sf))
    return s.withColumns({c: F.col(c).cast("long") for c in ("pos", "char_start", "char_end")})


@query("h14_h19_text_lengths", r"""select doc_id, length(text) as chars, len(regexp_extract_all(text, '\S+\s*')) as tokens
from documents""")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("chars"),
                                                  X.token_count(F.col("text")).cast("long").alias("tokens"))


@query("h16_ratios", """select l_orderkey, ceil(count(*) / 2.0)::bigint as batches,
  coalesce(count(*) filter (where l_returnflag = 'R')::double / nullif(count(*) filter (where l_linestatus = 'O'), 0), 0) as ratio
from lineitem group by all""")
def _(spark, sf):
    n, r, o = F.count(F.lit(1)), F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_linestatus") == "O")
    return V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.ceil(n / 2).alias("batches"), X.safe_ratio(r.cast("double"), o).alias("ratio"))


@query("h17_json_values", """select event_id, (props->>'k')::bigint as k, '{"k":' || (props->>'k') || '}' as again from events""")
def _(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return V.table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("again"))


@query("i6_e5_compose_article", """select d.doc_id as document_id, p.full_text, p.offsets from (select doc_id,
  rtrim(string_agg(upper(section) || chr(10) || text, chr(10) || chr(10) order by pos), E' \\t\\n') as full_text,
  string_agg(section || ':' || char_start || '-' || char_end, ';' order by pos) as offsets from docparts group by doc_id) p
join documents d using (doc_id)""")
def _(spark, sf):
    return V.docs(spark, sf).select("document_id", "full_text", F.array_join(F.transform(
        "section_offsets", lambda o: F.concat(o["section"], F.lit(":"), o["char_start"].cast("string"), F.lit("-"),
                                              o["char_end"].cast("string"))), ";").alias("offsets"))


@query("e6_unique_section_names", r"""select doc_id, string_agg(name, ',' order by pos) as names from (
  select doc_id, pos, word || case when n = 1 then '' else '_' || (n - 1) end as name from (
    select *, row_number() over (partition by doc_id, word order by pos) as n from (
      select doc_id, pos, lower(regexp_extract(text, '^ *(\p{L}*)', 1)) as word from docparts0))) group by doc_id""")
def _(spark, sf):
    """The first word of each line stands for its heading."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    words = F.transform(lines, lambda x: F.lower(F.regexp_extract(x, r"^ *(\p{L}*)", 1)))
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(K.unique_section_names(words), ",").alias("names"))


@query("i7_token_windows", r"""select doc_id, s // 462 as n, md5(array_to_string(toks[s + 1 : s + 512], '')) as content,
  length(array_to_string(toks[1 : s], '')) as char_start, length(array_to_string(toks[1 : s + 512], '')) as char_end,
  least(len(toks) - s, 512) as token_count
from (select doc_id, toks, unnest(range(0, greatest(len(toks) - 51, 0) + 1, 462)) as s
  from (select doc_id, regexp_extract_all(text, '\S+\s*') as toks from documents) where len(toks) > 0)""")
def _(spark, sf):
    """Default window, 512 tokens with 50 overlapping, over whole texts."""
    w = K.token_windows(F.col("text"), F.lit("body"), F.lit(0))
    return spread(V.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(w).alias("n", "w")).select(
        "doc_id", F.col("n").cast("long").alias("n"), F.md5("w.content").alias("content"),
        *[F.col(f"w.{c}").cast("long").alias(c) for c in ("char_start", "char_end", "token_count")])


@query("i8_e3_chunk_documents", """select document_chunk_id, document_id, section, chunk_index, content, char_start, char_end,
  token_count from chunks""")
def _(spark, sf):
    c = V.chunks(spark, sf)
    return c.withColumns({k: F.col(k).cast("long") for k in ("chunk_index", "char_start", "char_end", "token_count")})


@query("i9_rechunk_other_size", r"""select document_id, chunk_index, token_count from (
  select doc_id as document_id, row_number() over (partition by doc_id order by pos, s) - 1 as chunk_index,
    least(len(toks) - s, 20) as token_count
  from (select *, unnest(range(0, greatest(len(toks) - 6, 0) + 1, 15)) as s from sectokens where len(toks) > 0))""")
def _(spark, sf):
    c = K.chunk_documents(V.docs(spark, sf), 20, 5)
    return c.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                    F.col("token_count").cast("long").alias("token_count"))


def _escaped(text):
    out = text
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def article_xml(articles):
    """Article XML of the document lines: italic in the title, one nested section, a table."""
    sec = F.array_join(F.transform("sections", lambda s: F.concat(
        F.lit("<sec><title> "), F.upper(s["section"]), F.lit("</title><p>"), _escaped(s["text"]), F.lit("</p></sec>"))), "")
    table = F.concat(
        F.lit("<sec><title>Table</title><table-wrap><caption><p>Facts</p></caption><table><thead><tr><th>lang</th>"
              "<th>id</th></tr></thead><tbody><tr><td>"), F.col("lang"), F.lit("</td><td>"),
        F.col("document_id").cast("string"), F.lit("</td></tr><tr><td>short</td></tr></tbody></table></table-wrap></sec>"))
    return articles.select("document_id", F.col("document_id").cast("string").alias("pmc_id"), F.concat(
        F.lit("<article><front><article-title><italic>"), _escaped(F.col("title")), F.lit("</italic></article-title><abstract><p>"),
        _escaped(F.col("abstract")), F.lit("</p></abstract></front><body>"), sec, table, F.lit("</body></article>")).alias("xml"))


_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_BODY_TABLE = ("'**Facts**' || chr(10) || chr(10) || '| lang | id |' || chr(10) || '|---|---|' || chr(10) || '| ' || lang "
               "|| ' | ' || doc_id || ' |' || chr(10) || '| short |  |'")


@query("i1_i5_parse_articles", f"""select doc_id::varchar as pmc_id, {_SQUEEZE.format('lines[1]')} as title,
  {_SQUEEZE.format("coalesce(lines[2], '')")} as abstract,
  coalesce((select string_agg(section || '=' || {_SQUEEZE.format('text')}, '#' order by pos) || '#' from docparts p
    where p.doc_id = d.doc_id and pos > 2), '') || 'table=' || {_BODY_TABLE} as sections
from doclines d join documents using (doc_id)""")
def _(spark, sf):
    p = A.parse_articles(article_xml(V.articles(spark, sf)))
    return p.select("pmc_id", "title", "abstract", F.array_join(F.transform(
        "sections", lambda s: F.concat(s["section"], F.lit("="), s["text"])), "#").alias("sections"))


@query("i1_malformed_pages", "select count(*) as pages, count(*) as failed from pages")
def _(spark, sf):
    """Web pages are not well-formed articles: each fails and keeps its row."""
    pages = V.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("pmc_id"), F.col("html").alias("xml"))
    return A.parse_articles(pages).agg(F.count(F.lit(1)).alias("pages"), F.count("error").alias("failed"))


def _landed(spark, sf):
    """Landed articles, those of one source cut off, and summaries of the documents that are labelled."""
    articles = V.articles(spark, sf)
    full = article_xml(articles).join(articles.select("document_id", "source"), "document_id")
    cut = full.withColumn("xml", F.when(F.col("source") == "src3", F.expr("left(xml, length(xml) - 9)"))
                          .otherwise(F.col("xml")))
    labelled = V.table(spark, sf, "labels").select("doc_id")
    summaries = V.table(spark, sf, "documents").join(labelled, "doc_id", "left_semi").select(
        F.col("doc_id").cast("string").alias("pmc_id"), F.lit("Summary title").alias("title"),
        F.array("lang").alias("authors"), F.col("source").alias("journal"), F.lit("2024").alias("pub_date"),
        F.lit("").alias("doi"), F.lit(None).cast("string").alias("pmid"))
    return A.fetch_details(cut, summaries)


@query("a5_fetch_details", f"""select doc_id::varchar as source_id, {_SQUEEZE.format('lines[1]')} as title, source as journal,
  md5('TITLE' || chr(10) || {_SQUEEZE.format('lines[1]')} || chr(10) || chr(10)
    || case when len(lines) > 1 then 'ABSTRACT' || chr(10) || {_SQUEEZE.format('lines[2]')} || chr(10) || chr(10) else '' end
    || coalesce((select string_agg(upper(section) || chr(10) || {_SQUEEZE.format('text')}, chr(10) || chr(10) order by pos)
      || chr(10) || chr(10) from docparts p where p.doc_id = d.doc_id and pos > 2), '')
    || 'TABLE' || chr(10) || {_BODY_TABLE}) as full_text
from doclines d join documents using (doc_id) where source <> 'src3' and doc_id in (select doc_id from labels)""")
def _(spark, sf):
    docs, _ = _landed(spark, sf)
    return docs.select("source_id", "title", F.col("doc_metadata.journal").alias("journal"), F.md5("full_text").alias("full_text"))


@query("a6_failed_articles", """select doc_id::varchar as pmc_id, source = 'src3' as malformed from documents
where source = 'src3' or doc_id not in (select doc_id from labels)""")
def _(spark, sf):
    _, failed = _landed(spark, sf)
    return failed.select("pmc_id", (F.col("error") != "no summary").alias("malformed"))


@query("h18_passage_lines", r"""select document_chunk_id, md5('[PMC' || source_id || '] Title: ' || title || ' | '
  || regexp_replace(content, '\[[\d,\s\-]+\]', '', 'g') || ' | Journal: ' || case when has_meta then journal else '' end || chr(10)) as line
from vec_chunks join docs using (document_id)""")
def _(spark, sf):
    d = V.slim_docs(spark, sf).select("document_id", "source_id", "title", F.coalesce("metadata.journal", F.lit("")).alias("journal"))
    return V.vec_chunks(spark, sf).join(d, "document_id").select("document_chunk_id", F.md5(X.passage_line(
        F.col("source_id"), F.col("title"), F.col("content"), F.col("journal"))).alias("line"))


_NGRAM = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"


@query("n6_overlap", f"""select doc_id, item_id, round(common / nullif(na, 0), 6) as p1, round(common / nullif(nb, 0), 6) as r1,
  round(2 * common / (na + nb), 6) as f1 from (select doc_id, item_id, len(a)::double as na, len(b)::double as nb,
    len(list_intersect(a, b))::double as common from (
  select doc_id, item_id, {_NGRAM.format('answer')} as a, {_NGRAM.format('reference')} as b from answers))""")
def _(spark, sf):
    """Every document as an answer, against the text of its question."""
    o = V.answers(spark, sf).select("doc_id", "item_id", E.overlap(F.col("answer"), F.col("reference")).alias("o"))
    return o.select("doc_id", "item_id", F.round("o.precision", 6).alias("p1"), F.round("o.recall", 6).alias("r1"),
                    F.round("o.f1", 6).alias("f1"))


_BIGRAM = ("list_distinct(list_transform(range(1, len(t{0})), lambda i: t{0}[i] || ' ' || t{0}[i + 1]))")


@query("n6_bigram_overlap", f"""select doc_id, item_id, coalesce(round(2 * len(list_intersect(a, b))::double / nullif(len(a) + len(b), 0), 6), 0)
  as f2 from (select doc_id, item_id, {_BIGRAM.format('a')} as a, {_BIGRAM.format('b')} as b from (select doc_id, item_id,
  regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}]+') as ta, regexp_extract_all(lower(reference), '[\\p{{L}}\\p{{N}}]+') as tb
  from answers))""")
def _(spark, sf):
    return V.answers(spark, sf).select(
        "doc_id", "item_id", F.round(E.overlap(F.col("answer"), F.col("reference"), 2)["f1"], 6).alias("f2"))


# Row by row over the terms of the reference; the table's next row is a running maximum over the places of the answer.
_LCS = """with recursive told as (select doc_id, item_id, regexp_extract_all(lower(answer), '[\\p{L}\\p{N}]+') as a,
    regexp_extract_all(lower(reference), '[\\p{L}\\p{N}]+') as b from answers),
  place as (select doc_id, unnest(a) as w, unnest(generate_series(1, len(a))) as j from told),
  cell(i, doc_id, j, w, length) as (
    select 0, doc_id, j, w, 0 from place
    union all
    select i + 1, doc_id, j, w, max(greatest(length, up + (w = t)::int)) over (partition by doc_id order by j) from (
      select c.*, coalesce(lag(length) over (partition by c.doc_id order by j), 0) as up, b[i + 1] as t
      from cell c join told using (doc_id) where i < len(b))),
  met as (select doc_id, max(length) as lcs from cell group by 1),
  sized as (select doc_id, item_id, coalesce(lcs, 0)::bigint as lcs, len(a)::double as n, len(b)::double as m
    from told left join met using (doc_id))
select doc_id, item_id, lcs, round(coalesce(lcs / nullif(n, 0), 0), 6) as p, round(coalesce(lcs / nullif(m, 0), 0), 6) as r,
  round(coalesce(2 * lcs / nullif(n + m, 0), 0), 6) as f from sized"""


@query("n6_lcs", _LCS)
def _(spark, sf):
    """Overlap by order: the longest common subsequence of every document and the text of its question."""
    o = spread(V.answers(spark, sf)).select("doc_id", "item_id", rouge_l(F.col("answer"), F.col("reference")).alias("o"))
    return o.select("doc_id", "item_id", "o.lcs", F.round("o.precision", 6).alias("p"), F.round("o.recall", 6).alias("r"),
                    F.round("o.f", 6).alias("f"))
