"""Evaluation of retrieval and answers against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.text import safe_ratio, single_bracket_sources, terms
from marginalia.operators.ordinals import exact_percentiles, tile_by_cuts


def retrieved_sources(results: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct sources of each question's retrieved chunks (a question retrieves a bounded list)."""
    ids = results.select("question_id", F.explode("retrieved_chunk_ids").alias("document_chunk_id")).distinct()
    found = ids.join(chunks.select("document_chunk_id", "document_id"), "document_chunk_id") \
        .join(docs.select("document_id", "source_id"), "document_id")
    return found.groupBy("question_id").agg(F.collect_set("source_id").alias("sources"))


def citation_validity(response: Column, sources: Column) -> Column:
    """Share of distinct one-id citations that were retrieved; 0 when nothing is cited."""
    cited = single_bracket_sources(response)
    return safe_ratio(F.size(F.array_intersect(cited, sources)).cast("double"), F.size(cited))


def score_answers(results: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds correct_article_retrieved and citation_validity_rate: two joins for the whole set of questions."""
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    return results.join(retrieved_sources(results, chunks, docs), "question_id", "left").withColumns({
        "correct_article_retrieved": F.array_contains(sources, F.col("pmc_id")),
        "citation_validity_rate": citation_validity(F.col("raw_llm_response"), sources),
    }).drop("sources")


def stored_citations() -> Column:
    """Number of citations stored with an answer, which its text may name in any form; 0 without a list."""
    return F.coalesce(F.size("citations"), F.lit(0))


def summary(scored: DataFrame, include_errors: bool = False) -> DataFrame:
    """Totals and averages; error rows count in the denominators only with ``include_errors``."""
    used = F.lit(True) if include_errors else F.col("error").isNull()
    mean = lambda c: F.coalesce(F.avg(F.when(used, c)), F.lit(0.0))
    return scored.agg(
        F.count(F.lit(1)).alias("total_questions"), F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        mean(F.col("correct_article_retrieved").cast("double")).alias("correct_article_retrieval_rate"),
        mean(F.col("citation_validity_rate")).alias("avg_citation_validity_rate"),
        mean(stored_citations().cast("double")).alias("avg_citations_per_question"),
        mean(F.col("response_time_ms")).alias("avg_response_time_ms"))


def last_judgement(judge: DataFrame) -> DataFrame:
    """One row per question: the one at the highest position."""
    fields = [c for c in judge.columns if c not in ("question_id", "pos")]
    return judge.groupBy("question_id").agg(F.max_by(F.struct(*fields), "pos").alias("j")).select("question_id", "j.*")


def merge_judgements(scored: DataFrame, judge: DataFrame) -> DataFrame:
    """Scored answers with their judgement, NULL where there is none."""
    return scored.join(last_judgement(judge), "question_id", "left")


def metrics_rows(merged: DataFrame) -> DataFrame:
    """The metrics-only table of a run."""
    return merged.select(
        "question_id", "pmid", "pmc_id", "correct_article_retrieved", "citation_validity_rate", "response_time_ms",
        stored_citations().alias("num_citations"),
        F.size("retrieved_chunk_ids").alias("num_chunks_retrieved"), "error", "conclusion_match", "reasoning_match",
        "faithfulness", "relevance", "precision", "recall")


def judge_summary(judge: DataFrame) -> DataFrame:
    """Counts and averages over all judge rows, matched or not; numbers a judge reports itself are ignored."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}")
    return judge.agg(
        F.count_if(F.col("conclusion_match") == "CORRECT").alias("conclusion_match_correct"),
        F.count_if(F.col("reasoning_match") == "CORRECT").alias("reasoning_match_correct"),
        *[mean(c) for c in ("faithfulness", "relevance", "precision", "recall")])


def judge_rates(scored: DataFrame, judge: DataFrame) -> DataFrame:
    """Match rates over all questions and over judged questions."""
    total = scored.agg(F.count(F.lit(1)).alias("n")).scalar()
    return judge.agg(F.count_if(F.col("conclusion_match") == "CORRECT").alias("c"),
                     F.count_if(F.col("reasoning_match") == "CORRECT").alias("r"),
                     F.countDistinct("question_id").alias("judged")).select(
        safe_ratio(F.col("c").cast("double"), total).alias("conclusion_rate_total"),
        safe_ratio(F.col("r").cast("double"), total).alias("reasoning_rate_total"),
        safe_ratio(F.col("c").cast("double"), F.col("judged")).alias("conclusion_rate_judged"),
        safe_ratio(F.col("r").cast("double"), F.col("judged")).alias("reasoning_rate_judged"))


def invalid_judgements(judge: DataFrame) -> DataFrame:
    """Judge rows that break the expected values."""
    verdicts = ("CORRECT", "INCORRECT")
    ok = F.col("conclusion_match").isin(*verdicts) & F.col("reasoning_match").isin(*verdicts)
    for grade in ("faithfulness", "relevance", "precision", "recall"):
        ok = ok & F.col(grade).between(1, 5)
    return judge.where(~F.coalesce(ok, F.lit(False)) | F.col("question_id").isNull())


def _correct() -> Column:
    return F.col("conclusion_match") == "CORRECT"


def accuracy_crosstab(merged: DataFrame) -> DataFrame:
    """Judged questions by retrieval outcome and conclusion."""
    return merged.where(F.col("conclusion_match").isNotNull()).groupBy("correct_article_retrieved") \
        .pivot("conclusion_match", ["CORRECT", "INCORRECT"]).agg(F.count(F.lit(1))).select(
        "correct_article_retrieved", F.coalesce("CORRECT", F.lit(0)).alias("correct"),
        F.coalesce("INCORRECT", F.lit(0)).alias("incorrect"))


def accuracy_by_answer(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("conclusion_match").isNotNull()).groupBy("expected_answer").agg(
        F.count_if(_correct()).alias("correct"), F.count(F.lit(1)).alias("n"),
        F.avg(_correct().cast("double")).alias("accuracy"))


def accuracy_by_time(merged: DataFrame, tiles: int = 4) -> DataFrame:
    """Accuracy per response-time quartile. Equal times are ordered by md5 of the question id.

    Only the rows where quartiles end are looked for, by order statistics; no window runs over the questions.
    """
    rows = merged.where(F.col("conclusion_match").isNotNull())
    tiled = tile_by_cuts(rows, tiles, "response_time_ms", "question_id", "quartile")
    return tiled.groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_correct().cast("double")).alias("accuracy"),
        F.min("response_time_ms").alias("fastest"), F.max("response_time_ms").alias("slowest"))


def latency_percentiles(scored: DataFrame, exact: bool = True) -> DataFrame:
    """Median and 95th percentile; the approximate form keeps a bounded sketch for very large runs."""
    if exact:
        return exact_percentiles(scored, "response_time_ms", (0.5, 0.95)).toDF("p50", "p95")
    p = F.percentile_approx("response_time_ms", F.array(F.lit(0.5), F.lit(0.95)))
    return scored.agg(p.alias("p")).select(F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"))


def failure_split(merged: DataFrame) -> DataFrame:
    """Wrong conclusions after wrong and after right retrieval, with their share of all failures."""
    kind = F.when(F.col("correct_article_retrieved"), "reasoning").otherwise("retrieval")
    counts = merged.where(F.col("conclusion_match") == "INCORRECT").groupBy(kind.alias("failure")).agg(
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 4))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per question: fixed, regressed or unchanged, with the change of its scores."""
    side = lambda df, p: df.select(
        "question_id", _correct().alias(f"{p}_correct"), F.col("citation_validity_rate").alias(f"{p}_validity"),
        F.col("response_time_ms").alias(f"{p}_ms"))
    both = side(before, "before").join(side(after, "after"), "question_id", "full_outer")
    a, b = F.coalesce("before_correct", F.lit(False)), F.coalesce("after_correct", F.lit(False))
    return both.select(
        "question_id", F.when(~a & b, "fixed").when(a & ~b, "regressed").otherwise("unchanged").alias("change"),
        (F.col("after_validity") - F.col("before_validity")).alias("validity_delta"),
        (F.col("after_ms") - F.col("before_ms")).alias("ms_delta"))


def enrich_citations(cited: DataFrame, chunks: DataFrame, docs: DataFrame, papers: DataFrame) -> DataFrame:
    """Citations with chunk text and pmid; unknown chunks and papers get the default texts.

    ``cited``: question_id, pos, chunk_id. A pmid of 0 or NULL is unknown, -1 stays.
    """
    ids = papers.select(F.col("pmc_id").alias("source_id"), F.col("pmid"))
    known = chunks.select(F.col("document_chunk_id").alias("chunk_id"), "document_id", "content") \
        .join(cited.select("chunk_id").distinct(), "chunk_id", "left_semi") \
        .join(docs.select("document_id", "source_id"), "document_id") \
        .join(ids, "source_id", "left").select("chunk_id", "content", "pmid")
    unknown = F.col("pmid").isNull() | (F.col("pmid") == 0)
    return cited.join(known, "chunk_id", "left").select(
        *cited.columns, F.coalesce("content", F.lit("Content not available")).alias("chunk_content"),
        F.when(unknown, "Unknown").otherwise(F.col("pmid").cast("string")).alias("pmid"))


def golden_dataset(questions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Golden rows of the questions whose paper is known. ``questions``: pmid and record fields; ``mapping``: pmid, pmc_id."""
    rows = questions.join(mapping.dropDuplicates(["pmid"]), "pmid")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        F.concat(F.lit("pubmedqa_"), "pmid").alias("question_id"), "pmid", "pmc_id",
        F.col("r.QUESTION").alias("question"), F.col("r.final_decision").alias("expected_answer"),
        blank(F.col("r.LONG_ANSWER")).alias("long_answer"), blank(F.col("r.YEAR")).alias("year"),
        blank(F.array_join("r.MESHES", "|")).alias("meshes"),
        F.coalesce(F.when(F.col("r.CONTEXTS").isNotNull(), F.size("r.CONTEXTS")), F.lit(0)).alias("num_contexts"))


# The judge's block per question.
JUDGE_BLOCK = (
    "## Question %s\n\n**Question**: %s\n\n**Expected Answer**: %s\n\n**Long Answer (Ground Truth)**: %s\n\n---\n\n"
    "**RAG Answer**:\n\n%s\n\n---\n\n**Retrieved Context** (%d chunks):\n\n%s\n\n---\n\n**Evaluation**:\n"
    "- Conclusion Match: [ ] CORRECT / INCORRECT\n- Reasoning Match: [ ] CORRECT / INCORRECT\n- Faithfulness: [ ] / 5\n"
    "- Relevance: [ ] / 5\n- Precision: [ ] / 5\n- Recall: [ ] / 5\n\n---\n")


def judge_blocks(results: DataFrame, enriched: DataFrame) -> DataFrame:
    """One text block per question for the judge; citations are numbered in order (an answer cites a bounded list)."""
    passages = enriched.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "chunk_content"))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] "), p["chunk_content"], F.lit("\n\n"))), "")
    na = lambda c: F.coalesce(F.col(c), F.lit("N/A"))
    joined = results.join(passages, "question_id", "left")
    n = F.when(F.col("ps").isNull(), 0).otherwise(F.size("ps"))
    return joined.select("question_id", F.format_string(
        JUDGE_BLOCK, F.col("question_id"), F.col("question"), na("expected_answer"), na("long_answer"),
        na("rag_answer"), n, F.when(n > 0, text).otherwise(F.lit("No citations"))).alias("block"))


# The text around the passages of a prompt.
PROMPT_FRAME = (
    "<Literature>\nBelow are the top ",
    " most relevant literature passages to the user's query. Each passage starts with a unique [source_id].\n",
    "</Literature>\nUser Query: ",
)


def prompt_messages(queries: DataFrame, passages: DataFrame, history: DataFrame | None, system: str) -> DataFrame:
    """Chat messages per query as rows (query_id, part, turn, role, content), in order of part and turn.

    Part 0 is the system text, part 1 the earlier turns (role and content only), part 2 the passages and the
    question. ``passages``: query_id, rank, line, a top-n list per query. ``history``: query_id, turn, role,
    content; it stays in rows, so a long conversation is never gathered.
    """
    lines = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("ls"))
    asked = queries.select("query_id", "qtext")
    n = F.when(F.col("ls").isNull(), 0).otherwise(F.size("ls"))
    body = F.concat(
        F.lit(PROMPT_FRAME[0]), n.cast("string"), F.lit(PROMPT_FRAME[1]),
        F.coalesce(F.array_join("ls.line", ""), F.lit("")), F.lit(PROMPT_FRAME[2]), F.col("qtext"))

    def row(part: int, turn: Column, role: Column, content: Column) -> list[Column]:
        return [F.col("query_id"), F.lit(part).alias("part"), turn.cast("long").alias("turn"), role.alias("role"),
                content.alias("content")]

    out = asked.select(*row(0, F.lit(0), F.lit("system"), F.lit(system))).unionByName(
        asked.join(lines, "query_id", "left").select(*row(2, F.lit(0), F.lit("user"), body)))
    if history is not None:
        earlier = history.join(asked.select("query_id"), "query_id", "left_semi")
        out = out.unionByName(earlier.select(*row(1, F.col("turn"), F.col("role"), F.col("content"))))
    return out


def split_system(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last system text per query ('' without one), and the other messages."""
    is_system = F.col("role") == "system"
    last = F.max_by(F.when(is_system, F.col("content")), F.when(is_system, F.struct("part", "turn")))
    return (messages.groupBy("query_id").agg(F.coalesce(last, F.lit("")).alias("system")),
            messages.where(~is_system))


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens

    def grams(own: Column) -> Column:
        starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, F.lit(n)), " "))

    # bound to a variable, or every n-gram would make the tokens again
    return F.transform(F.array(tokens), grams)[0]


def overlap(candidate: Column, reference: Column, n: int = 1) -> Column:
    """struct<precision, recall, f1> of distinct n-grams against a reference text."""
    a, b = F.array_distinct(ngrams(terms(candidate), n)), F.array_distinct(ngrams(terms(reference), n))
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.struct(safe_ratio(common, F.size(a)).alias("precision"), safe_ratio(common, F.size(b)).alias("recall"),
                    safe_ratio(2 * common, F.size(a) + F.size(b)).alias("f1"))
