"""Citation graph reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.functions.text import id_list
from marginalia.operators.curation import has_pmid


def citation_edges(metrics: DataFrame) -> DataFrame:
    """(citing, referenced) pairs from the comma-separated reference lists."""
    return metrics.select(F.col("pmid").alias("citing"), F.explode(id_list(F.col("references"))).alias("referenced")) \
        .distinct()


def cocited_with(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Papers cited together with the seeds, and in how many citing papers: (seed, other, n).

    Two hops from the seeds, never all pairs of a reference list. The join by citing paper is left to adaptive
    execution: a broadcast where the seed hits turn out small, else a sort-merge join whose hot partitions are
    split. Counts combine before the shuffle.
    """
    hits = edges.join(seeds.select(F.col("seed").alias("referenced")).distinct(), "referenced", "left_semi") \
        .select("citing", F.col("referenced").alias("seed"))
    return edges.select("citing", F.col("referenced").alias("other")).join(hits, "citing") \
        .where(F.col("other") != F.col("seed")).groupBy("seed", "other").agg(F.count(F.lit(1)).alias("n"))


def key_authors(metrics: DataFrame, top: int = 20) -> DataFrame:
    """Authors by citations of their papers (a top-k report); ties by name."""
    names = metrics.select("citation_count", F.explode(F.array_distinct(F.transform(
        F.split("authors", ","), lambda a: F.trim(a)))).alias("author")).where("author <> ''")
    return names.groupBy("author").agg(F.sum("citation_count").alias("citations"), F.count(F.lit(1)).alias("papers")) \
        .orderBy(F.desc("citations"), "author").limit(top)


def enrich_results(results: DataFrame, papers: DataFrame, metrics: DataFrame) -> DataFrame:
    """Search results with their paper's citation metrics; NULL where unknown."""
    fields = metrics.select("pmid", "citation_count", "nih_percentile", "relative_citation_ratio")
    ids = papers.where(has_pmid()).select(F.col("pmc_id").alias("source_id"), "pmid")
    return results.join(ids, "source_id", "left").join(fields, "pmid", "left")
