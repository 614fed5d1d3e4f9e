"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marginalia.session import settle

#: Links that one task of a round takes on; fewer tasks than shuffle partitions serve a short table.
LINKS_PER_TASK = 200_000


def _settled(links: DataFrame, expected: int | None) -> tuple[DataFrame, int, tuple]:
    """The links, written, with their number and a sum over them that tells two states apart."""
    seen = Observation()
    if expected is not None:
        links = links.coalesce(max(1, -(-expected // LINKS_PER_TASK)))
    mark = F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))
    written = settle(links.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(mark, F.lit(0)).alias("mark")))
    told = seen.get
    return written.coalesce(max(1, -(-told["n"] // LINKS_PER_TASK))), told["n"], (told["n"], told["mark"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its smallest node.

    Each round hangs neighbours on the smallest one around (first those above a node, then those below), until nothing
    moves: about log2 of the longest chain rounds. Every round is checkpointed; hot nodes only meet minima, which combine
    before the shuffle, and joins that adaptive execution can split.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, n, before = _settled(links, None)
    while n:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, n, after = _settled(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), n)
        if after == before:
            break
        before = after
    tops = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(tops.select("node", F.col("node").alias("component")))
