"""Data-quality audit of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 768
SHORT, LONG = 50, 5000


def orphan_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select("document_id"), "document_id", "left_anti")


def embedded_without_vectors(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    done = chunks.where(F.col("embedding").isNotNull()).select("document_id")
    return docs.where("ingestion_status = 'embedded'").join(done, "document_id", "left_anti")


def fetched_without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.where("ingestion_status = 'fetched'").join(chunks.select("document_id"), "document_id", "left_anti")


def status_conflicts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose status is behind their chunks."""
    fetched = docs.where("ingestion_status = 'fetched'").join(chunks.select("document_id"), "document_id", "left_semi")
    vectors = chunks.where(F.col("embedding").isNotNull()).select("document_id")
    chunked = docs.where("ingestion_status = 'chunked'").join(vectors, "document_id", "left_semi")
    return fetched.select("document_id", F.lit("fetched_with_chunks").alias("conflict")).unionByName(
        chunked.select("document_id", F.lit("chunked_with_embeddings").alias("conflict")))


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id", "chunk_index").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def offender_sample(offenders: DataFrame, key: str = "document_id", size: int = 10) -> DataFrame:
    """The first offenders by key, for a report."""
    return offenders.orderBy(key).limit(size)


def dimension_counts(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("dimension")).agg(
        F.count(F.lit(1)).alias("n"))


def null_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    d = docs.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("title", "source", "source_id")])
    c = chunks.agg(
        F.count_if(F.col("content").isNull() | (F.col("content") == "")).alias("null_content"),
        F.count_if(F.col("section").isNull()).alias("null_section"))
    rows = lambda df: df.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("field"), F.col(x).alias("n")) for x in df.columns])).alias("r")).select("r.*")
    return rows(d).unionByName(rows(c))


def length_stats(chunks: DataFrame) -> DataFrame:
    n = F.length("content")
    return chunks.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(n < SHORT).alias("very_short"), F.count_if(n > LONG).alias("very_long"),
        F.round(F.avg(n)).cast("long").alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length")) \
        .withColumn("short_warning", F.col("very_short") > 0.05 * F.col("total")) \
        .withColumn("long_warning", F.col("very_long") > 0.01 * F.col("total"))


def corpus_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    d = docs.agg(F.count(F.lit(1)).alias("documents"), *[
        F.count_if(F.col("ingestion_status") == s).alias(s) for s in ("fetched", "chunked", "embedded")])
    with_vec = chunks.agg(F.count("embedding").alias("n")).scalar()
    total = chunks.agg(F.count(F.lit(1)).alias("n")).scalar()
    return d.withColumn("chunks", total).withColumn("with_embedding", with_vec) \
        .withColumn("without_embedding", F.col("chunks") - F.col("with_embedding")) \
        .withColumn("avg_chunks_per_doc", F.coalesce(
            F.round(F.try_divide(F.col("chunks").cast("double"), F.col("documents")), 4), F.lit(0.0)))


def audit(docs: DataFrame, chunks: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """All checks in one pass over the chunks and one over the documents.

    One row per check: check, severity, n_bad, n_total, passed. Chunks are aggregated to (document, index),
    then to documents, with map-side combine, so a document with a third of all chunks is no hot spot.
    """
    one = F.lit(1)
    by_index = chunks.groupBy("document_id", "chunk_index").agg(
        F.count(one).alias("n"), F.count("embedding").alias("vec"),
        F.count_if(F.size("embedding") != dimensions).alias("bad_dim"),
        F.count_if(F.col("content").isNull() | (F.col("content") == "")).alias("no_text"),
        F.count_if(F.col("section").isNull()).alias("no_section"),
        F.count_if(F.length("content") < SHORT).alias("short"), F.count_if(F.length("content") > LONG).alias("long"))
    sums = ("n", "vec", "bad_dim", "no_text", "no_section", "short", "long")
    by_doc = by_index.groupBy("document_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.count_if(F.col("n") > 1).alias("dup"), F.count(one).alias("keys"))
    known = docs.select("document_id", "title", "source", "source_id", "ingestion_status").withColumn("d", F.lit(1))
    rows = known.join(by_doc, "document_id", "full_outer")
    status = F.col("ingestion_status")
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    total = rows.agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("docs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*sums, "dup", "keys")],
        F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
        F.count_if(status == "embedded").alias("embedded"),
        F.count_if((status == "embedded") & ~has("vec")).alias("embedded_bare"),
        F.count_if((status == "fetched") & has("n")).alias("fetched_with"),
        F.count_if((status == "chunked") & has("vec")).alias("chunked_with"),
        F.count_if(F.col("d").isNotNull() & (F.col("title").isNull() | F.col("source").isNull()
                                             | F.col("source_id").isNull())).alias("null_fields"))

    def check(name: str, severity: str, bad: Column, of: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), bad.alias("n_bad"),
                        of.alias("n_total"))

    c = F.col
    checks = F.array(
        check("orphan_chunks", "error", c("orphans"), c("n")),
        check("embedded_without_vectors", "error", c("embedded_bare"), c("embedded")),
        check("duplicate_chunks", "error", c("dup"), c("keys")),
        check("embedding_dimension", "error", c("bad_dim"), c("vec")),
        check("status_conflicts", "warning", c("fetched_with") + c("chunked_with"), c("docs")),
        check("null_document_fields", "error", c("null_fields"), c("docs")),
        check("empty_content", "error", c("no_text"), c("n")),
        check("null_section", "warning", c("no_section"), c("n")),
        check("very_short_chunks", "info", c("short"), c("n")),
        check("very_long_chunks", "info", c("long"), c("n")))
    return total.select(F.explode(checks).alias("k")).select("k.*") \
        .withColumn("passed", (F.col("n_bad") == 0) | (F.col("severity") != "error"))


def ingestion_report(docs_before: DataFrame, chunks_made: DataFrame) -> DataFrame:
    """Outcome of a chunking run: documents that gave chunks, those that gave none, and totals (``sources.runs`` counts while it writes)."""
    work = docs_before.where("ingestion_status = 'fetched'").select("document_id")
    made = chunks_made.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return work.join(made, "document_id", "left").agg(
        F.count("n").alias("success"), F.count_if(F.col("n").isNull()).alias("failed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"),
        F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 4).alias("avg_chunks_per_doc"))
