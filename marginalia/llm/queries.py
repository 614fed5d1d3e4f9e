"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import (alignment, ann, bpe_counts, divergence, html_blocks, language, licenses, mixing, ngram_join, packing,
                            repetition, toxicity, warc)
from marginalia.session import scratch_path, ship_code, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ship_code(tune(spark)), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
per_source as (select source, sum(size)::bigint as source_size from sized group by source),
named as (
  select *, row_number() over (order by source nulls last) - 1 as place from per_source),
weighed as (
  select *, [5, 2, 1][(place % 3 + 1)::int] as weight, 2 * source_size as "full" from named),
ratios as (select *, "full"::double / weight as ratio from weighed),
levels as (
  select *, (sum(source_size) over () * 3 / 2.0::double
      - coalesce(sum("full") over (order by ratio, place rows between unbounded preceding and 1 preceding), 0)::double)
    / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0))::double
    as level from ratios),
water as (select arg_min(level, ratio) filter (ratio > level) as water from levels),
targets as (
  select source, place, source_size,
    case when coalesce(ratio <= water, true) then "full"::double else water * weight end as target from levels, water),
queued as (
  select d.*, t.place, t.source_size, t.target,
    sum(d.size) over (partition by t.place order by md5('mix-1:' || d.doc_id), d.doc_id, d.size rows unbounded preceding) as queued
  from sized d join targets t on d.source is not distinct from t.source where d.size > 0),
items as (
  select *, (pass * source_size + queued)::double / target as finish from queued, (values (0), (1)) p(pass)),
sorted as (
  select *, sum(size) over (order by finish, place, doc_id, pass, size rows unbounded preceding) as running from items),
taken as (
  select doc_id, place, sum(size)::bigint as taken from sorted
  where running <= (select sum(source_size) * 3 / 2.0::double from targets) group by all)
select d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(k.taken, 0)::bigint as taken
from sized d join targets t on d.source is not distinct from t.source
left join taken k on k.doc_id = d.doc_id and k.place = t.place
"""


@_query("op7_fair_queue_mix", MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document by a mix of 150% of all words, sources weighted 5, 2, 1."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size")))


@_query("op1_line_blocks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


REPETITION_SQL = r"""
with toks as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
word as (
  select doc_id, unnest(ws) as w, unnest(generate_series(1, len(ws))) as i from toks),
sizes as (
  select doc_id, sum(length(w))::bigint as word_chars from word group by 1),
gram as (
  select doc_id, n, i, list_aggregate(list_slice(ws, i, i + n - 1), 'string_agg', ' ') as g
  from toks, (values (5), (6), (7), (8), (9), (10)) k(n), unnest(generate_series(1, len(ws) - n + 1)) u(i)),
twin as (
  select doc_id, n, i, nth > 1 as later from (select *, count(*) over (partition by doc_id, n, g) as found,
    row_number() over (partition by doc_id, n, g order by i) as nth from gram) where found > 1),
inside as (
  select t.doc_id, t.n, t.i + k.j as i, bool_or(later) as later from twin t, (select unnest(range(0, 10)) as j) k
  where k.j < t.n group by 1, 2, 3),
cover as (
  select c.doc_id, c.n, count(*) as words, coalesce(sum(length(w.w)) filter (later), 0) as chars
  from inside c join word w using (doc_id, i) group by 1, 2),
line as (
  select doc_id, l, count(*) - 1 as again from (select doc_id, unnest(string_split(text, chr(10))) as l from toks)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1, 2),
lines as (
  select doc_id, sum(again)::bigint as n_dup_lines,
    sum(again * length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) as chars from line group by 1),
told as (
  select t.doc_id, len(t.ws)::bigint as n_words, coalesce(s.word_chars, 0)::bigint as word_chars,
    length(regexp_replace(t.text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(l.n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce((select words from cover c where c.doc_id = t.doc_id and n = 8), 0)::bigint as n_repeat_words,
    coalesce(l.chars::double / s.word_chars, 0) as dup_line_share,
    coalesce((select chars from cover c where c.doc_id = t.doc_id and n = 5)::double / s.word_chars, 0) as dup_5gram_share,
    coalesce((select chars from cover c where c.doc_id = t.doc_id and n = 6)::double / s.word_chars, 0) as dup_6gram_share,
    coalesce((select chars from cover c where c.doc_id = t.doc_id and n = 7)::double / s.word_chars, 0) as dup_7gram_share,
    coalesce((select chars from cover c where c.doc_id = t.doc_id and n = 8)::double / s.word_chars, 0) as dup_8gram_share,
    coalesce((select chars from cover c where c.doc_id = t.doc_id and n = 9)::double / s.word_chars, 0) as dup_9gram_share,
    coalesce((select chars from cover c where c.doc_id = t.doc_id and n = 10)::double / s.word_chars, 0) as dup_10gram_share
  from toks t left join sizes s on s.doc_id = t.doc_id left join lines l on l.doc_id = t.doc_id),
base as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from told)
select *, not base_failed and dup_line_share <= 0.20 and dup_5gram_share <= 0.15 and dup_6gram_share <= 0.14
  and dup_7gram_share <= 0.13 and dup_8gram_share <= 0.12 and dup_9gram_share <= 0.11 and dup_10gram_share <= 0.10 as kept from base
"""


@_query("op6_repetition_coverage", REPETITION_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    told = repetition.repetition_rules(_table(spark, sf_dir, "documents"))
    shares = [c for c in told.columns if c.endswith("_share")]  # the method's own follow the agreed ones
    return told.select(*[c for c in told.columns if c not in shares], *shares)


WARC_SQL = """
with paid as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages),
told as (
  select page_id, strlen(payload)::bigint as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, 5 * (i // 4)::int + 1, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') as payload_digest,
    max(page_id) over (partition by payload) as largest from paid)
select page_id, payload_bytes, payload_digest, case when page_id = largest then 'response' else 'revisit' end as record_type,
  case when page_id <> largest then largest end as refers_to from told
"""


@_query("op2_warc_normaliser", WARC_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written, normalised to a member per record and read back by offset."""
    return warc.round_trip(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


@_query("op5_shortest_pack_first")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query("op3_subword_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op8_language_mixture")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    return language.identify(_table(spark, sf_dir, "documents"))


@_query("op9_dimension_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every hundredth vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def _license_sql() -> str:
    """Word sets of all lines against all templates, one by one; the fixed lists are those of the operator."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {quoted(licenses._set_of(text))})" for label, text in licenses.TEMPLATES)
    phrases = ", ".join(f"('{label}', {quoted(phrase.split())})" for phrase, label in licenses.PHRASES.items())
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    take = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with docs as (
  select doc_id, {fold.format("coalesce(text, '')")} as text, {take.format(fold.format("coalesce(text, '')"))} as ws from documents),
templates(label, words) as (values {templates}),
phrases(label, words) as (values {phrases}),
places as (
  select d.doc_id, p.label, i - 1 as spot
  from docs d, phrases p, unnest(generate_series(1, len(d.ws))) u(i)
  where d.ws[i] = p.words[1] and list_slice(d.ws, i, i + len(p.words) - 1) = p.words),
base as (
  select doc_id, count(*) as n_base, min(spot) as first_word, max(spot) as last_word, list(distinct label) as labels
  from places group by 1),
lines as (
  select doc_id, list_distinct({take.format("line")}) as held
  from (select doc_id, unnest(string_split(text, chr(10))) as line from docs)),
met as (
  select l.doc_id, t.label, len(list_intersect(l.held, t.words)) as overlap, len(t.words) as size from lines l, templates t
  where len(l.held) > 0),
best as (
  select doc_id, list(distinct label) as labels, max(overlap::double / size) as share from met
  where 100 * overlap >= {licenses.THRESHOLD} * size group by 1)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base, b.first_word::bigint as first_word,
  b.last_word::bigint as last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') as labels,
  case when b.n_base > 0 then 1.0::double else coalesce(m.share, 0.0)::double end as score
from docs d left join base b using (doc_id) left join best m using (doc_id)
"""


@_query("op10_license_join", _license_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


JOIN_SQL = r"""
with recursive toks as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from documents),
shingle as (
  select distinct doc_id, list_aggregate(list_slice(ws, i, i + 2), 'string_agg', ' ') as g
  from toks, unnest(generate_series(1, case when len(ws) = 0 then 0 else greatest(len(ws) - 2, 1) end)) u(i)),
sizes as (select doc_id, count(*) as n from shingle group by 1),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as both from shingle a join shingle b on a.g = b.g and a.doc_id <> b.doc_id
  group by 1, 2),
links as (
  select p.a, p.b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b
  where 100 * p.both >= 90 * (x.n + y.n - p.both)),
reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select r.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(r.other) as component_id
from reach r left join sizes s on s.doc_id = r.doc_id group by 1
"""


@_query("op4_jaccard_join", JOIN_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 3-word shingles are alike to 0.9."""
    return ngram_join.classes(_table(spark, sf_dir, "documents"))


@_query("op11_bpe_merge_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return bpe_counts.token_counts(_table(spark, sf_dir, "documents"))


@_query("op12_diagonal_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers."""
    return alignment.alignment(_table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
groups as (select distinct lang, source from docs),
met as (
  select lang, source, term, count(*)::bigint as n, sum(n) as found from (
    select lang, source, spot, term, count(*)::bigint as n from (
      select lang, source, spot, unnest(ts) as term from (select *, row_number() over () as spot from docs)) group by all)
  group by all),
kept as (select lang, term, sum(found) as lang_n from met group by 1, 2 having sum(n) >= 30),
sizes as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by 1),
cell as (
  select g.lang, g.source, k.term, coalesce(m.found, 0) as found, k.lang_n, s.v, s.lang_total,
    sum(coalesce(m.found, 0)) over (partition by g.lang, g.source) as total
  from groups g join kept k using (lang) join sizes s using (lang) left join met m using (lang, source, term)),
rate as (
  select lang, source, term, found, 1 + (1000000000::hugeint * (found + 5)) // (total + 5 * v) as p,
    1 + (1000000000::hugeint * (lang_n + 5)) // (lang_total + 5 * v) as q from cell),
pair as (
  select a.lang, a.source, b.source as item, coalesce((
    select sum(abs(x.p - y.p)) from rate x join rate y using (lang, term)
    where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source),
listed as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank
  from pair
  union all
  select lang, source, 'term', term, (p - q)::bigint, row_number() over (partition by lang, source order by p - q desc, term)
  from rate where found > 0 and p > q)
select lang, source, part, item, value, rank::int as rank from listed where part = 'pair' or rank <= 50
"""


@_query("op13_source_divergence", DIVERGENCE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each source off."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of all documents that the stages of the pipeline keep."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
