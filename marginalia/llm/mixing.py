"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Sizes are words. Each source has a weight; targets share ``budget`` of all words by weight, and a target stops at
``repeats`` times its source's size, its excess going to the others by weight (water filling, exact in whole numbers up to
one division). The documents of a source queue in a shuffled order, pass after pass. A document's virtual finish time is
the words its source has queued up to it, divided by the source's target. All queued documents are range-sorted by that
time and the mix ends where the running total would exceed the budget.

No window meets a source or the whole table: running totals are sums per bucket, then inside the bucket. Only sources
(one row each) and buckets (a fixed number) meet in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 and those
past the budget have ``taken`` 0; equal rows count as one document each and share the takings in whole passes; an empty
table gives no rows. Columns of the input other than the four used ones never meet the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import settle

#: Words are runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the shuffle: its seed and the number of buckets of a source's queue and of virtual time.
SEED, QUEUE_DIGITS, COARSE, FINE = "mix-1", 3, 64, 64
#: Sources up to this number are broadcast, one row of a name and four numbers each.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget: tuple[int, int] = (3, 2), repeats: int = 2,
                   weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, place, source_size, target) of a table (source, size), one row per source.

    Weights repeat over the sources by code point, null last. Sources are sorted by the level at which they are full; the
    level of the water is the budget left by the full ones divided by the weight of the others.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "full": F.lit(repeats) * F.col("source_size")})
    ranked = ranked.withColumn("ratio", F.col("full") / F.col("weight"))
    # sources of one ratio are full together, so their order does not matter
    by_level = Window.partitionBy(F.lit(0)).orderBy("ratio", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything) * F.lit(budget[0]) / F.lit(budget[1])
    left = total - F.coalesce(F.sum("full").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.withColumn("level", left / weight_left)
    still_open = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))
    water = F.min(still_open).over(everything)["level"]
    levels = levels.withColumn("water", water)
    # without an open source all are full
    target = F.when(F.coalesce(F.col("ratio") <= F.col("water"), F.lit(True)), F.col("full").cast("double")) \
        .otherwise(F.col("water") * F.col("weight"))
    return levels.select("source", "place", "source_size", target.alias("target"))


def _with_targets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Joins each document to its source's row; broadcast up to a counted number of sources, shuffled beyond it."""
    named = targets.withColumnRenamed("source", "_source")
    if targets.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    return docs.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _running(df: DataFrame, group: str, bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``value`` summed up to and including each row, by ``bucket`` and then ``order`` inside each ``group``."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.join(offsets, [group, bucket]).withColumn(name, F.col("_ahead") + F.sum(value).over(inside)).drop("_ahead"))


def fair_queue(docs: DataFrame, repeats: int = 2) -> DataFrame:
    """Adds ``pass`` and ``finish`` to documents with their source's row: a row for every pass of every document with words."""
    spot = F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string")))
    queued = docs.where("size > 0").withColumn("spot", spot)
    queued = queued.withColumn("bucket", F.substring("spot", 1, QUEUE_DIGITS))
    queued = _running(queued, "place", "bucket", [F.col("spot"), F.col("doc_id"), F.col("size")], "size", "queued")
    queued = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (F.col("pass") * F.col("source_size") + F.col("queued")) / F.col("target")
    return queued.withColumn("finish", finish).drop("spot", "bucket", "queued")


def truncate(queue: DataFrame, total: Column) -> DataFrame:
    """The queue's leading part, in order of virtual finish time, whose sizes fit in ``total`` words.

    The range sort has explicit bounds: ``COARSE`` times ``FINE`` equal ranges for each unit of virtual time, all later
    times in one last range, which starts at time 2 and so is never reached.
    """
    unit = F.least(F.col("finish"), F.lit(2.0)) * F.lit(COARSE * FINE)
    ranged = queue.withColumn("range", F.floor(unit).cast("long"))
    ranged = ranged.where(F.col("range") < 2 * COARSE * FINE).withColumn("span", F.floor(F.col("range") / FINE).cast("long"))
    order = [F.col("finish"), F.col("place"), F.col("doc_id"), F.col("pass"), F.col("size")]
    spans = ranged.groupBy("span").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before_span"))
    ordered = _running(ranged, "span", "range", order, "size", "inside")
    ordered = ordered.join(F.broadcast(spans), "span")  # 2 * COARSE rows at most
    return ordered.where(F.col("before_span") + F.col("inside") <= total).drop("span", "range", "before_span", "inside")


def mix(docs: DataFrame, budget: tuple[int, int] = (3, 2), repeats: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of a table (doc_id, source, size)."""
    docs = settle(docs.select("doc_id", "source", "size"))
    targets = settle(source_targets(docs, budget, repeats, weights))
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(budget[0]) / F.lit(budget[1])).first()[0]
    named = _with_targets(docs, targets)
    chosen = truncate(fair_queue(named, repeats), F.lit(total))
    # equal rows are interchangeable: their passes are dealt over them in turn
    keys = ["doc_id", "place", "size"]
    taken = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    rows = named.groupBy(*keys, "source", "source_size", "target").agg(F.count(F.lit(1)).alias("copies"))
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.place") == F.col("t.place")) \
        & (F.col("r.size") == F.col("t.size"))
    told = rows.alias("r").join(taken.alias("t"), same, "left")
    told = told.select("r.*", F.coalesce("times", F.lit(0)).alias("times"))
    told = told.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    times = F.floor((F.col("times") + F.col("copies") - 1 - F.col("k")) / F.col("copies"))
    return told.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), "source")


def mixed_rows(docs: DataFrame, budget: tuple[int, int] = (3, 2), repeats: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The rows of (doc_id, source, text, ...) that a mix takes, all columns, each as often as it is taken.

    Rows of one id, source and text are one document with several copies.
    """
    name = "mix_key"
    while name in docs.columns:
        name += "_"
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"), F.md5("source"))
    keyed = docs.withColumn(name, key)
    sizes = keyed.select(F.col(name).alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    taken = mix(sizes, budget, repeats, weights).where("taken > 0")
    times = taken.groupBy("doc_id").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("times"))
    once = keyed.dropDuplicates([name]).join(times.withColumnRenamed("doc_id", "_key"), F.col(name) == F.col("_key"))
    return once.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_pass")).select(*docs.columns)
