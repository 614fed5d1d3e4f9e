"""Runs that store their result and report on it: the counters ride on the write, the tables are not read again."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, functions as F

from marginalia.operators.chunking import CHUNK_SIZE, OVERLAP, chunk_documents

REPORT = ("success bigint, failed bigint, total_chunks bigint, avg_chunks_per_doc double, remaining bigint, "
          "ms_per_chunk double")


def chunk_run(docs: DataFrame, path: str, batch: Column | None = None, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Stores the chunks of fetched documents at ``path`` and gives one row about the run.

    ``batch`` chooses the documents of this run among those that wait. A document fails that gives no chunk; ``remaining``
    counts all that wait still, failed ones included. ``ms_per_chunk`` is the time of the write by chunk, null without chunks.
    Chunking stays inside the row, so input, counters and write are one stage, whose tasks count once however often they run.
    """
    waiting, taken, made = Observation(), Observation(), Observation()
    count = F.count(F.lit(1)).alias("n")
    work = docs.where("ingestion_status = 'fetched'").observe(waiting, count)
    if batch is not None:
        work = work.where(batch)
    chunks = chunk_documents(work.observe(taken, count), size, overlap).observe(
        made, count, F.count_if(F.col("chunk_index") == 0).alias("docs"))
    begun = time.monotonic()
    chunks.write.parquet(path)
    spent = 1000 * (time.monotonic() - begun)
    n, success = made.get["n"], made.get["docs"]
    return docs.sparkSession.createDataFrame([(
        success, taken.get["n"] - success, n, round(n / success, 4) if success else 0.0, waiting.get["n"] - success,
        spent / n if n else None)], REPORT)
