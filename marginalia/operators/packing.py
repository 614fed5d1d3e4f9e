"""Exact greedy batches of documents by id, without a pass over all of them in one place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from marginalia.operators.ordinals import radix_levels, running_totals
from marginalia.session import settle, stored

# Chunks of a block, in multiples of a batch's limit: a block looks one limit ahead into the next.
BLOCK_LIMITS = 4


def _jumps(rows: pd.DataFrame, max_chunks: int, max_tokens: int) -> np.ndarray:
    """For each row, how many rows further on the batch that begins with it has ended. Rows are in order of ``place``."""
    chunks, tokens = rows["chunks_before"].to_numpy(), rows["tokens_before"].to_numpy()
    ends = [np.searchsorted(before + rows[size].to_numpy(), before + limit, side="right")
            for before, size, limit in ((chunks, "chunk_count", max_chunks), (tokens, "token_count", max_tokens))]
    return np.maximum(np.arange(len(rows)) + 1, np.minimum(*ends))


def _exits(jumps: np.ndarray, own: int) -> np.ndarray:
    """For each of the first ``own`` rows, the first place outside of them that its batches lead to."""
    out, steps = [0] * own, jumps.tolist()
    for i in range(own - 1, -1, -1):
        out[i] = steps[i] if steps[i] >= own else out[steps[i]]
    return np.array(out, np.int64)


def greedy_batches(sizes: DataFrame, max_chunks: int = 50_000, max_tokens: int = 3_000_000,
                   block_limits: int = BLOCK_LIMITS) -> DataFrame:
    """(document_id, batch, chunk_count, token_count): documents by id, each batch as full as both limits allow.

    ``sizes``: document_id, chunk_count, token_count; documents without chunks are left out, one above a limit is a batch of
    its own, and a batch is named by its first document. The result is that of one pass over the documents in order.

    Running totals tell for every document where a batch that begins with it would end: a jump pointer. Documents are cut
    into blocks by their running total of chunks; a block also sees the documents one limit further on, so all its pointers
    are known there. Inside a block pointers are followed from right to left, which gives for each document the place where
    its batches leave the block. Of these, only places that some block leads to matter; the way through them is found by
    pointers of doubled length. Each block then follows its own pointers once more, from where the way enters it. Groups
    hold one block, which is bounded by the limit on chunks, and no document is compared with another.
    """
    key, levels = F.col("document_id"), radix_levels(F.col("document_id"))
    # the totals read the sizes several times, which may be counted from whole texts
    out = stored(sizes.where("chunk_count > 0").select("document_id", "chunk_count", "token_count"), "batch-sizes")
    out = running_totals(out, [], levels, [key], {
        "chunks_before": F.col("chunk_count"), "tokens_before": F.col("token_count"), "place": F.lit(1)})
    width = block_limits * max_chunks
    out = stored(out.withColumn("block", F.expr(f"chunks_before div {width}")), "batch-places")

    # the documents that a block looks ahead to stand in it a second time
    ahead = out.where(f"chunks_before - block * {width} <= {max_chunks}") \
        .select("document_id", "chunk_count", "token_count", "chunks_before", "tokens_before", "place",
                (F.col("block") - 1).alias("block"), F.lit(False).alias("own"))
    seen = out.withColumn("own", F.lit(True)).unionByName(ahead)

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        own = int(rows["own"].sum())
        if not own:
            return pd.DataFrame({"place": [], "until": []}, dtype="int64")
        place = rows["place"].to_numpy()
        # only its first document, and those that the block before looks ahead to, can be entered from outside
        start = rows["chunks_before"].to_numpy()[:own]
        entry = np.flatnonzero((start - int(rows["block"].iloc[0]) * width <= max_chunks) | (np.arange(own) == 0))
        return pd.DataFrame({"place": place[entry], "until": place[0] + _exits(_jumps(rows, max_chunks, max_tokens), own)[entry]})

    ways = settle(seen.groupBy("block").applyInPandas(exits, "place long, until long"))
    jump = ways.join(ways.select(F.col("until").alias("place")).distinct().unionByName(_first(ways)).distinct(), "place", "left_semi")
    jump = settle(jump)
    entered = settle(_first(ways))
    while True:
        further = entered.join(jump, "place").select(F.col("until").alias("place"))
        more = settle(entered.unionByName(further).distinct())
        if more.count() == entered.count():
            break
        entered = more
        jump = settle(jump.alias("a").join(jump.alias("b"), F.col("a.until") == F.col("b.place")).select("a.place", "b.until"))

    entries = out.select("block", "place").join(entered, "place").groupBy("block").agg(F.min("place").alias("entry"))

    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        own = int(rows["own"].sum())
        ids, place = rows["document_id"].to_numpy(), rows["place"].to_numpy()
        batch: list = [None] * own
        if own and not pd.isna(entry := rows["entry"].iloc[0]):
            steps, at = _jumps(rows, max_chunks, max_tokens).tolist(), int(entry - place[0])
            while at < own:
                batch[at:steps[at]] = [ids[at]] * (min(steps[at], own) - at)
                at = steps[at]
        return pd.DataFrame({"document_id": ids[:own], "batch": pd.array(batch, "Int64"), "chunk_count": rows["chunk_count"].to_numpy()[:own],
                             "token_count": rows["token_count"].to_numpy()[:own], "block": rows["block"].to_numpy()[:own]})

    told = seen.join(entries, "block", "left").groupBy("block").applyInPandas(
        starts, "document_id long, batch long, chunk_count long, token_count long, block long")
    told = stored(told, "batches")
    # one row per block: what stands before a block's entry belongs to the last batch before the block
    last = told.groupBy("block").agg(F.max("batch").alias("last"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("block", F.max("last").over(before).alias("carried"))
    return told.join(carried, "block").select("document_id", F.coalesce("batch", "carried").alias("batch"), "chunk_count", "token_count")


def _first(ways: DataFrame) -> DataFrame:
    """The place of the first document, if there is one."""
    return ways.where("place = 0").select("place")
