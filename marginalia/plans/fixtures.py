"""The engine's tables derived from the given parquet tables; whole tables, row by row or by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.functions.text import word_runs
from marginalia.operators.chunking import chunk_documents, compose_article, unique_section_names
from marginalia.session import spread

# Chunk window used on the fixtures, so that short texts give several windows.
SIZE, OVERLAP = 64, 8

BODY_NAMES = ("introduction", "methods", "results", "discussion", "conclusion")
LABEL_SECTIONS = ("abstract", "methods", "results", "discussion", "conclusions", "introduction", "background",
                  "limitation notes", "ethics")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def papers(spark: SparkSession, sf: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        key.cast("string").alias("pmc_id"),
        F.when(key % 20 == 0, F.lit(None)).when(key % 20 == 1, F.lit(-1)).otherwise(1000000 + key)
        .cast("long").alias("pmid"),
        F.lit(None).cast("string").alias("doi"),
        F.when(key % 7 == 0, F.lit(50.0)).alias("nih_percentile"),
        F.lit(None).cast("int").alias("publication_year"),
        F.lit(None).cast("int").alias("citation_count"),
        F.lit(None).cast("double").alias("relative_citation_ratio"),
        F.lit(None).cast("boolean").alias("is_clinical"),
        F.lit(None).cast("boolean").alias("is_research_article"),
        pick(("pending", "wont_fetch", "fetched", "failed"), size % 4).alias("fetch_status"),
        pick((0, 10, 50, 50, 100), size % 5).alias("priority"),
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("title"),
        F.array(F.lit("Journal Article"), pick(("Research Support", "Review", "Trial", "Letter"), size % 4))
        .alias("pub_types"),
        (size % 3 != 0).alias("open_access"),
        F.date_add(F.lit("2020-01-01").cast("date"), (size * 40).cast("int")).alias("pub_date"),
    )


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_partkey")
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).cast("int").alias("citation_count"),
        F.min(F.year("l_shipdate")).alias("year"),
        F.avg("l_quantity").alias("q"), F.min("l_suppkey").alias("s1"), F.max("l_suppkey").alias("s2"),
    ).select(
        (1000000 + key).alias("pmid"), "year", "citation_count",
        F.when(key % 17 != 0, (key * 7919 % 10000) / 100).alias("nih_percentile"),
        F.round(F.col("q") / 25.5, 6).alias("relative_citation_ratio"),
        (key % 3 != 0).alias("is_research_article"), (key % 4 == 0).alias("is_clinical"),
        F.concat(F.lit("Author "), F.col("s1"), F.lit(", Author "), F.col("s2")).alias("authors"),
        F.concat(F.lit("J"), key % 7).alias("journal"),
        F.concat((1000000 + key + 1), F.lit(","), (1000000 + key + 2), F.lit(", "), (1000000 + key * 2))
        .alias("references"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("referenced")).distinct()


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Title, abstract and named sections of each document: its non-blank lines."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    base = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text")) \
        .withColumn("lines", lines)
    body = F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0)))
    raw = F.transform(body, lambda x, i: pick(BODY_NAMES, i % 5))
    return base.select(
        F.col("doc_id").alias("document_id"), "lang", "source", "text",
        F.get("lines", F.lit(0)).alias("title"), F.coalesce(F.get("lines", F.lit(1)), F.lit("")).alias("abstract"),
        F.zip_with(unique_section_names(raw), body, lambda n, t: F.struct(n.alias("section"), t.alias("text")))
        .alias("sections"),
    )


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with full text, offsets, metadata, priority and status."""
    key = F.col("document_id")
    full = articles(spark, sf).withColumn("c", compose_article(F.col("title"), F.col("abstract"), F.col("sections")))
    return _with_state(full.withColumn("full_text", F.col("c.full_text"))
                       .withColumn("section_offsets", F.col("c.section_offsets")), spark, sf, key) \
        .select("document_id", "source", "source_id", "title", "abstract", "full_text", "section_offsets",
                "metadata", "priority", "ingestion_status")


def slim_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The document columns retrieval needs, without texts."""
    base = table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), "lang", "source",
        F.regexp_extract("text", r"([^\n]*[^ \n][^\n]*)", 1).alias("title"))
    return _with_state(base, spark, sf, F.col("document_id")) \
        .select("document_id", "source", "source_id", "title", "metadata", "priority", "ingestion_status")


def _with_state(base: DataFrame, spark: SparkSession, sf: str, key: Column) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), "quality", "toxic")
    day = F.lpad((key % 28 + 1).cast("string"), 2, "0")
    meta = F.struct(
        F.array("lang").alias("authors"), F.col("source").alias("journal"),
        F.concat(F.lit("2024-01-"), day).alias("pub_date"), F.lit("").alias("doi"))
    return base.join(labels, "document_id", "left").withColumns({
        "metadata": F.when(key % 11 != 0, meta),
        "source_id": key.cast("string"),
        "priority": F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 100)
        .when(F.col("quality") == 0, 10).otherwise(50),
        "ingestion_status": pick(("fetched", "chunked", "embedded"), key % 3),
    }).withColumn("source", F.lit("pmc"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    full = articles(spark, sf).withColumn("c", compose_article(F.col("title"), F.col("abstract"), F.col("sections")))
    return chunk_documents(full.select("document_id", "title", "c.full_text", "c.section_offsets"), SIZE, OVERLAP)


def vec_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with vectors; five per document, one vector in fifty missing."""
    vec = F.col("vec_id")
    rows = table(spark, sf, "embeddings").select(
        vec.alias("document_chunk_id"), F.expr("vec_id div 5").alias("document_id"),
        (vec % 5).cast("int").alias("chunk_index"), pick(LABEL_SECTIONS, F.col("label")).alias("section"),
        F.when(vec % 50 != 49, F.col("embedding")).alias("embedding"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return rows.join(texts, "document_id")


def bare_vec_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``vec_chunks`` without texts."""
    vec = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        vec.alias("document_chunk_id"), F.expr("vec_id div 5").alias("document_id"),
        (vec % 5).cast("int").alias("chunk_index"), pick(LABEL_SECTIONS, F.col("label")).alias("section"),
        F.when(vec % 50 != 49, F.col("embedding")).alias("embedding"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text, with the vector of the same id."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("qtext")).join(
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")),
        "query_id")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as an answer to one of the questions, which follow one another by document id."""
    asked = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("reference"))
    number = asked.count()
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("answer"), (F.col("doc_id") % number).alias("item_id")) \
        .join(asked, "item_id")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    a = (conv * 7 + turn * 3) % 100
    b, c = (a + turn % 3) % 100, (a + 50) % 100
    answer = F.concat(F.lit("## Answer: "), F.col("text"), F.lit(" [PMC"), a, F.lit(", PMC"), b, F.lit("] [PMC"), c,
                      F.lit("] [3]\n## References:\n[PMC"), a, F.lit("] x"))
    return table(spark, sf, "conversations").select(
        "conv_id", F.concat(F.lit("anon_"), conv % 7).alias("user_id"), "turn", "role",
        F.when(F.col("role") == "assistant", answer).otherwise(F.col("text")).alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + conv * 3600 + turn * 60).alias("ts"))


def turn_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieved chunks of each assistant turn, in rank order; the first source is retrieved twice."""
    conv, turn, rank = F.col("conv_id"), F.col("turn"), F.col("rank")
    source = (conv * 7 + turn * 3 + rank % 5) % 100
    return table(spark, sf, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("rank")).select(
        "conv_id", "turn", "rank", source.cast("string").alias("source_id"),
        (source * 5 + F.expr("rank div 5")).alias("chunk_id"), F.concat(F.lit("Title "), source).alias("title"),
        F.concat(F.lit("J"), source % 7).alias("journal"))


def token_events(spark: SparkSession, sf: str) -> DataFrame:
    """start, token..., complete or error for each assistant answer; one in eight stalls before its last token."""
    conv, turn = F.col("conv_id"), F.col("turn")
    answers = messages(spark, sf).where("role = 'assistant'").withColumn("toks", word_runs(F.col("content")))
    n = F.size("toks")
    gap = 40 + (conv + turn) % 7 + F.when((conv + turn) % 10 == 7, 4000).otherwise(0)
    stall = F.when((conv + turn) % 8 == 3, 180000).otherwise(0)
    begin = F.unix_millis("ts")
    end_type = F.when((conv + turn) % 9 == 0, "error").otherwise("complete")
    event = lambda seq, typ, content, at: F.struct(
        seq.cast("int").alias("seq"), typ.alias("type"), content.cast("string").alias("content"), at.alias("ms"))
    tokens = F.transform("toks", lambda t, i: event(
        i + 1, F.lit("token"), t, begin + 500 + gap * i + F.when(i == n - 1, stall).otherwise(0)))
    all_events = F.concat(
        F.array(event(F.lit(0), F.lit("start"), F.lit(None), begin)), tokens,
        F.array(event(n + 1, end_type, F.lit(None), begin + 500 + gap * n + stall)))
    return answers.select("conv_id", "turn", F.explode(all_events).alias("e")).select(
        "conv_id", "turn", "e.seq", "e.type", "e.content", F.timestamp_millis("e.ms").alias("ts"))


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """One answered question per benchmark text."""
    i = F.col("item_id")
    own, other = i % 100, (i + 1 + 6 * (i % 2)) % 100
    shift = F.when(i % 5 == 0, 1).otherwise(0)
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("q_"), i).alias("question_id"), i.alias("item_id"), F.col("text").alias("question"),
        pick(("yes", "no", "maybe"), i % 3).alias("expected_answer"), own.cast("string").alias("pmc_id"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: ((i + j + shift) % 100) * 5).alias("retrieved_chunk_ids"),
        F.when(i % 9 == 0, F.lit("no evidence [1]"))
        .otherwise(F.concat(F.lit("see [PMC"), own, F.lit("] and [PMC"), other, F.lit("], again [PMC"), own,
                            F.lit(", PMC"), other, F.lit("]"))).alias("raw_llm_response"),
        (1000 + (i * 37) % 50000).cast("double").alias("response_time_ms"),
        F.when(i % 13 == 0, F.lit("timeout")).alias("error"), (i + 1000000).alias("pmid"),
        # stored apart from the text, which may name several ids in one bracket or none
        F.transform(F.when(i % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), i % 4)),
                    lambda j: F.struct(((i + j) % 100).cast("string").alias("source_id"))).alias("citations"))


def judgements(spark: SparkSession, sf: str) -> DataFrame:
    """Judge rows; one id in ten comes twice (the later position counts), some questions have none."""
    i = F.col("item_id")
    grade = lambda p: (1 + (i * p) % 5).cast("int")
    verdict = lambda m: F.when(i % m == 0, "INCORRECT").otherwise("CORRECT")
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("q_"), F.expr("item_id * 9 div 10 + 3")).alias("question_id"), i.alias("pos"),
        verdict(4).alias("conclusion_match"), verdict(5).alias("reasoning_match"), grade(1).alias("faithfulness"),
        grade(2).alias("relevance"), grade(3).alias("precision"), grade(4).alias("recall"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    message = F.when(conv % 4 == 0, F.concat(F.lit("<b>"), F.col("text"), F.lit("</b> "))) \
        .when(conv % 13 == 5, F.lit("  ")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").where("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), message.alias("user_message"),
        F.when(conv % 23 != 7, F.concat(F.lit("anon"), F.when(conv % 10 == 9, "!").otherwise("_"), conv % 7)).alias("user_id"),
        F.concat(F.lit("c"), conv, F.when(conv % 17 == 3, " x").otherwise("")).alias("conversation_id"),
        F.when(conv % 19 != 4, turn * 60).cast("int").alias("top_k"), F.when(conv % 29 != 3, turn + 1).cast("int").alias("top_n"),
        (turn * 11).cast("int").alias("additional_chunks_per_doc"))
