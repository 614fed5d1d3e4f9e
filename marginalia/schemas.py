"""Row types of the tables and records."""

from pyspark.sql import SparkSession, types as T

SECTION_OFFSET = T.StructType([
    T.StructField("section", T.StringType()),
    T.StructField("char_start", T.IntegerType()),
    T.StructField("char_end", T.IntegerType()),
])

DOC_METADATA = T.StructType([
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("journal", T.StringType()),
    T.StructField("pub_date", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("pmid", T.StringType()),
    T.StructField("pmc_id", T.StringType()),
    T.StructField("section_offsets", T.ArrayType(SECTION_OFFSET)),
])

PAPERS = T.StructType([
    T.StructField("pmc_id", T.StringType(), False),
    T.StructField("pmid", T.LongType()),
    T.StructField("doi", T.StringType()),
    T.StructField("nih_percentile", T.DoubleType()),
    T.StructField("publication_year", T.IntegerType()),
    T.StructField("citation_count", T.IntegerType()),
    T.StructField("relative_citation_ratio", T.DoubleType()),
    T.StructField("is_clinical", T.BooleanType()),
    T.StructField("is_research_article", T.BooleanType()),
    T.StructField("discovered_at", T.TimestampType()),
    T.StructField("fetch_status", T.StringType()),
    T.StructField("priority", T.IntegerType()),
])

DOCS = T.StructType([
    T.StructField("document_id", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("abstract", T.StringType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("doc_metadata", DOC_METADATA),
    T.StructField("priority", T.IntegerType()),
    T.StructField("ingestion_status", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

CHUNKS = T.StructType([
    T.StructField("document_chunk_id", T.LongType(), False),
    T.StructField("document_id", T.LongType(), False),
    T.StructField("section", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("char_start", T.IntegerType()),
    T.StructField("char_end", T.IntegerType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
])

# Column order of the citation-metrics snapshot file.
METRICS = T.StructType([
    T.StructField("pmid", T.LongType(), False),
    T.StructField("doi", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.StringType()),
    T.StructField("journal", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("citation_count", T.IntegerType()),
    T.StructField("nih_percentile", T.DoubleType()),
    T.StructField("relative_citation_ratio", T.DoubleType()),
    T.StructField("is_research_article", T.BooleanType()),
    T.StructField("is_clinical", T.BooleanType()),
    T.StructField("cited_by", T.StringType()),
    T.StructField("references", T.StringType()),
])

ID_CONVERSION = T.StructType([
    T.StructField("records", T.ArrayType(T.StructType([
        T.StructField("pmcid", T.StringType()),
        T.StructField("pmid", T.StringType()),
        T.StructField("doi", T.StringType()),
    ]))),
])

QA_RECORD = T.StructType([
    T.StructField("QUESTION", T.StringType()),
    T.StructField("CONTEXTS", T.ArrayType(T.StringType())),
    T.StructField("MESHES", T.ArrayType(T.StringType())),
    T.StructField("YEAR", T.StringType()),
    T.StructField("LONG_ANSWER", T.StringType()),
    T.StructField("final_decision", T.StringType()),
])

GOLDEN = T.StructType([
    T.StructField("question_id", T.StringType()),
    T.StructField("pmid", T.StringType()),
    T.StructField("pmc_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected_answer", T.StringType()),
    T.StructField("long_answer", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("meshes", T.StringType()),
    T.StructField("num_contexts", T.IntegerType()),
])

CITATION = T.StructType([
    T.StructField("number", T.IntegerType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("chunk_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("journal", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("publication_date", T.StringType()),
])

EVAL_RESULT = T.StructType([
    T.StructField("question_id", T.StringType()),
    T.StructField("pmid", T.StringType()),
    T.StructField("pmc_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected_answer", T.StringType()),
    T.StructField("long_answer", T.StringType()),
    T.StructField("rag_answer", T.StringType()),
    T.StructField("raw_llm_response", T.StringType()),
    T.StructField("citations", T.ArrayType(CITATION)),
    T.StructField("retrieved_chunk_ids", T.ArrayType(T.LongType())),
    T.StructField("correct_article_retrieved", T.BooleanType()),
    T.StructField("citation_validity_rate", T.DoubleType()),
    T.StructField("response_time_ms", T.DoubleType()),
    T.StructField("error", T.StringType()),
])

AUTO_FILE = T.StructType([T.StructField("results", T.ArrayType(EVAL_RESULT))])

JUDGE_ITEM = T.StructType([
    T.StructField("question_id", T.StringType()),
    T.StructField("conclusion_match", T.StringType()),
    T.StructField("reasoning_match", T.StringType()),
    T.StructField("faithfulness", T.IntegerType()),
    T.StructField("relevance", T.IntegerType()),
    T.StructField("precision", T.IntegerType()),
    T.StructField("recall", T.IntegerType()),
    T.StructField("notes", T.StringType()),
])

JUDGE_FILE = T.StructType([T.StructField("evaluations", T.ArrayType(JUDGE_ITEM))])

STREAM_METRICS = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("time_to_first_token", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("avg_time_per_token", T.DoubleType()),
    T.StructField("total_stream_time", T.LongType()),
    T.StructField("tokens_per_second", T.DoubleType()),
])

PACKED_BATCH = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("doc_count", T.LongType()),
    T.StructField("chunk_count", T.LongType()),
    T.StructField("token_count", T.LongType()),
])

TOKEN_EVENT = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

TABLES = {"papers": PAPERS, "docs": DOCS, "chunks": CHUNKS, "metrics": METRICS}


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty tables below ``root``; those that exist are left alone."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")
