"""Plan shapes that must hold at any size. That no query pairs all rows is checked beside its oracle."""

from pyspark.sql import functions as F

from marginalia.operators import curation, retrieval as R, vectors as E
from marginalia.plans import fixtures as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(V.table(spark, sf, "labels").where("quality = 1").select("doc_id"))
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)]" in text
    hits = R.live_chunks(V.bare_vec_chunks(spark, sf), V.slim_docs(spark, sf)).select("document_chunk_id")
    assert "ReadSchema: struct<vec_id:bigint>" in plan(hits)


def test_rank_limits_run_before_the_shuffle(spark, sf):
    hits = spark.createDataFrame([(1, 1, 1)], "query_id long, document_id long, document_chunk_id long")
    text = plan(R.expand_documents(hits, V.bare_vec_chunks(spark, sf), hits, 3, 10))
    assert text.count("WindowGroupLimit") >= 4 and "Partial" in text


def test_global_numbering_has_no_single_task_over_rows(spark, sf):
    text = plan(curation.conversion_requests(V.papers(spark, sf)))
    lines = text.splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    # only the sums of the coarsest level meet in one task
    assert len(single) == 1 and "HashAggregate" in lines[single[0] + 1]


def test_large_hit_sets_are_not_broadcast(spark):
    df = spark.range(10)
    assert "hint" not in R.small(df, R.BROADCAST_HITS + 1)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in R.small(df, None)._jdf.queryExecution().logical().toString().lower()
    assert "hint" in R.small(df, 10)._jdf.queryExecution().logical().toString().lower()


def test_vectors_are_not_shuffled_for_the_document_filter(spark, sf):
    text = plan(R.live_chunks(V.bare_vec_chunks(spark, sf), V.slim_docs(spark, sf)))
    above = text[:text.index("BroadcastHashJoin")]
    scan = next(line for line in text.splitlines() if "embedding" in line and "FileScan" in line)
    assert "Exchange" not in above and scan
    assert text[text.index("BroadcastHashJoin"):text.index("FileScan")].count("Exchange") == 0


def test_an_embedding_function_runs_once_per_text(spark, sf):
    embed = E.hashing_embedder(64)
    q = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), embed(F.col("text")).alias("qvec"))
    c = R.live_chunks(V.chunks(spark, sf), V.slim_docs(spark, sf)).select(
        "document_chunk_id", "document_id", embed(F.col("content")).alias("embedding"))
    assert plan(E.vector_topk(q, c, 5)).count("ArrowEvalPython") == 1
