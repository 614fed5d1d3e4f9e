"""Citations of answers, numbered across each conversation, and the display text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.functions import text as X
from marginalia.operators.ordinals import ordinal

# Turns per finest group of the numbering; each answer has few citations, so such a group is small.
TURN_BITS = (20, 10)


def answer_citations(messages: DataFrame) -> DataFrame:
    """Distinct sources of each assistant answer in order: (conv_id, turn, pos, source_id)."""
    return messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode(X.cited_sources(F.col("content"))).alias("pos", "source_id"))


def last_chunk_per_source(turn_chunks: DataFrame) -> DataFrame:
    """Of several retrieved chunks of a source the last in rank order describes it."""
    fields = [c for c in turn_chunks.columns if c not in ("conv_id", "turn", "rank", "source_id")]
    return turn_chunks.groupBy("conv_id", "turn", "source_id").agg(
        F.max_by(F.struct(*fields), "rank").alias("c")).select("conv_id", "turn", "source_id", "c.*")


def valid_citations(messages: DataFrame, turn_chunks: DataFrame) -> DataFrame:
    """Citations of sources that were retrieved for the turn, with their chunk; others vanish."""
    return answer_citations(messages).join(last_chunk_per_source(turn_chunks), ["conv_id", "turn", "source_id"])


def conversation_citations(cited: DataFrame) -> DataFrame:
    """One row per conversation and source, numbered by first valid citation, with the chunk of that citation.

    First occurrences are an aggregate with map-side combine; numbers come from levelled running counts by
    turn, so a conversation holding a third of all rows is spread over many groups.
    """
    fields = [c for c in cited.columns if c not in ("conv_id", "turn", "pos", "source_id")]
    first = cited.groupBy("conv_id", "source_id").agg(
        F.min_by(F.struct("turn", "pos", *fields), F.struct("turn", "pos")).alias("f")).select(
        "conv_id", "source_id", "f.*")
    levels = [F.shiftright(F.col("turn").cast("long"), b) for b in TURN_BITS]
    return ordinal(first, ["conv_id"], levels, [F.col("turn"), F.col("pos")], "number", 1)


def turn_citations(cited: DataFrame, citations: DataFrame) -> DataFrame:
    """Numbered citations of each answer, with the stored citation's chunk."""
    stored = citations.drop("turn", "pos")
    return cited.select("conv_id", "turn", "pos", "source_id").join(stored, ["conv_id", "source_id"])


def store_citations(messages: DataFrame, cited: DataFrame, citations: DataFrame) -> DataFrame:
    """Messages with the cited source and chunk ids of each answer; other messages have NULL there."""
    per_turn = turn_citations(cited, citations).groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct("pos", "source_id", "chunk_id"))).alias("c")).select(
        "conv_id", "turn", F.col("c.source_id").alias("cited_source_ids"), F.col("c.chunk_id").alias("cited_chunk_ids"))
    none = F.col("role") != "assistant"
    return messages.join(per_turn, ["conv_id", "turn"], "left").withColumns({
        "cited_source_ids": F.when(none, None).otherwise(
            F.coalesce("cited_source_ids", F.array().cast("array<string>"))),
        "cited_chunk_ids": F.when(none, None).otherwise(F.coalesce("cited_chunk_ids", F.array().cast("array<long>"))),
    })


def display_messages(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """Messages as shown: headings and references cut, sources renumbered, leaked numbers dropped.

    Only the numbers an answer asks for travel to it, never the conversation's whole map. Numbers are dense, so
    the conversation's count alone decides whether a bare number is valid, and it goes only to answers that have
    one. Texts are shuffled once.
    """
    keys = ["conv_id", "turn"]
    answers = messages.where(F.col("role") == "assistant").withColumn(
        "body", X.strip_references_section(X.strip_answer_heading(F.col("content"))))
    asked = answers.select(*keys, F.explode(X.renumberable_sources(F.col("body"))).alias("source_id"))
    numbers = asked.join(citations.select("conv_id", "source_id", "number"), ["conv_id", "source_id"]) \
        .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("source_id", "number"))).alias("map"))
    counts = citations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("count"))
    bare = answers.where(F.col("body").rlike(X.NUMBER_BRACKET)).select(*keys).join(counts, "conv_id")
    facts = numbers.join(bare, keys, "full_outer")
    empty = F.map_from_entries(F.array().cast("array<struct<source_id:string,number:bigint>>"))
    own = F.coalesce("map", empty)
    highest = F.greatest(F.coalesce("count", F.lit(0)), F.coalesce(F.array_max(F.map_values(own)), F.lit(0)))
    shown = answers.join(facts, keys, "left").withColumn("display", X.drop_leaked_numbers(
        X.renumber(F.col("body"), own), X.is_number_up_to(highest)))
    return shown.select("conv_id", "turn", "role", "display").unionByName(
        messages.where(F.col("role") != "assistant").select("conv_id", "turn", "role", F.col("content").alias("display")))
