"""Ordinals and running sums that hold for hot and for global groups.

A window without partition columns, or one over a group that holds a third of all rows, runs in one
task. Here the order key is cut into levels, coarse to fine. Sums per level are small aggregates with
map-side combine; only the finest level runs a window over rows, and its groups are bounded by the
level width. The result is the same as that of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def radix_levels(key: Column, bits: Sequence[int] = (40, 20)) -> list[Column]:
    """Levels for a unique integer key: at most 2^20 keys share a finest group."""
    return [F.shiftright(key.cast("long"), b) for b in bits]


def hash_levels(key: Column, digits: Sequence[int] = (5,)) -> list[Column]:
    """Levels for a unique string ordered by its md5: about a million even groups."""
    return [F.substring(F.md5(key), 1, d) for d in digits]


def running_total(
    df: DataFrame,
    by: Sequence[str],
    levels: Sequence[Column],
    order: Sequence[Column],
    value: Column,
    name: str = "before",
) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the group (0 for the first).

    ``order`` must be total within a group and agree with ``levels`` (coarse to fine).
    """
    return running_totals(df, by, levels, order, {name: value})


def running_totals(df: DataFrame, by: Sequence[str], levels: Sequence[Column], order: Sequence[Column],
                   values: Mapping[str, Column]) -> DataFrame:
    """``running_total`` of several values (name -> value) in one go: ``df`` is read twice, however many they are."""
    by = list(by)
    marks = [f"__lvl{i}" for i in range(len(levels))]
    cells = {name: f"__value{i}" for i, name in enumerate(values)}
    base = df.withColumns({m: c for m, c in zip(marks, levels)}).withColumns({cells[n]: v.cast("long") for n, v in values.items()})

    # sums per level, from the finest to the coarsest
    total = [F.sum(c).alias(c) for c in cells.values()]
    sums = [base.groupBy(*by, *marks).agg(*total)]
    for depth in range(len(marks) - 1, 0, -1):
        sums.append(sums[-1].groupBy(*by, *marks[:depth]).agg(*total))
    sums.reverse()

    # offset of each group of a level = offset of its parent + earlier siblings
    offset = {c: f"__offset{c}" for c in cells.values()}
    offsets = None
    for depth, level in enumerate(sums, start=1):
        parent, own = marks[:depth - 1], marks[depth - 1]
        keys = by + parent
        window = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(own) \
            .rowsBetween(W.unboundedPreceding, -1)
        level = level.withColumns({c: F.coalesce(F.sum(c).over(window), F.lit(0)) for c in offset})
        if offsets is None:
            offsets = level.withColumnsRenamed(offset)
        else:
            joined = level.join(offsets, keys) if keys else level
            offsets = joined.select(*by, *marks[:depth], *[(F.col(o) + F.col(c)).alias(o) for c, o in offset.items()])

    leaf = W.partitionBy(*by, *marks).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = base.withColumns({c: F.coalesce(F.sum(c).over(leaf), F.lit(0)) for c in offset})
    out = local.join(offsets, by + marks)
    return out.select(*df.columns, *[(F.col(c) + F.col(offset[c])).alias(n) for n, c in cells.items()])


def ordinal(
    df: DataFrame,
    by: Sequence[str],
    levels: Sequence[Column],
    order: Sequence[Column],
    name: str = "n",
    start: int = 1,
) -> DataFrame:
    """Dense row numbers in ``order`` within each group."""
    out = running_total(df, by, levels, order, F.lit(1), name)
    return out.withColumn(name, F.col(name) + F.lit(start))


def number_ids(df: DataFrame, id_col: str, name: str = "n", start: int = 0) -> DataFrame:
    """Global row numbers by a unique integer id."""
    return ordinal(df, [], radix_levels(F.col(id_col)), [F.col(id_col)], name, start)


def fixed_batches(df: DataFrame, id_col: str, size: int, name: str = "batch_id") -> DataFrame:
    """Batch number of each row when rows are taken ``size`` at a time by id."""
    numbered = number_ids(df, id_col, "__n", 0)
    return numbered.withColumn(name, F.expr(f"__n div {int(size)}")).drop("__n")


# Rows that come back to the driver as (value, count) once a range of values holds no more.
FEW = 20_000


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int], few: int = FEW) -> dict[int, tuple]:
    """rank (from 0, NULLs left out) -> (value, rows below it), exactly; ranks must be below the number of rows.

    A sketch gives splitters around the wanted rank; one aggregate counts the rows below and up to each. The rank is one of
    them, or lies in the range between two, which holds about a thousandth of the rows before. Only rows of that range are
    looked at further, and its values are counted one by one when it holds few rows. No task sees all distinct values.
    """
    rows = df.select(F.col(value).alias("v")).where("v is not null")
    found: dict[int, tuple] = {}
    for rank in sorted(set(ranks)):
        inside, before, size = rows, 0, None
        while rank not in found:
            size = inside.count() if size is None else size
            if size <= few:
                at = before
                for r in sorted(inside.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()):
                    if at <= rank < at + r["n"]:
                        found[rank] = (r["v"], at)
                    at += r["n"]
                break
            share = (rank - before + 0.5) / size
            near = [min(1.0, max(0.0, share + d)) for d in (-5e-4, 0.0, 5e-4)]
            marks = sorted(set(inside.agg(F.percentile_approx("v", near, 10_000)).first()[0]))
            told = inside.agg(*[c for m in marks for c in (F.count_if(F.col("v") < F.lit(m)), F.count_if(F.col("v") <= F.lit(m)))]).first()
            low, high = None, None
            for m, under, upto in zip(marks, told[::2], told[1::2]):
                if before + under <= rank < before + upto:
                    found[rank] = (m, before + under)
                elif before + upto <= rank:
                    low = (m, before + upto)
                elif high is None:
                    high = (m, before + under)
            end = high[1] if high else before + size
            if low:
                inside, before = inside.where(F.col("v") > F.lit(low[0])), low[1]
            if high:
                inside = inside.where(F.col("v") < F.lit(high[0]))
            size = end - before
    return found


def exact_percentiles(df: DataFrame, value: str, shares: Sequence[float], few: int = FEW) -> DataFrame:
    """Interpolated percentiles (one column p0, p1, ... per share); NULL without values."""
    spark = df.sparkSession
    total = df.where(F.col(value).isNotNull()).count()
    names = [f"p{i}" for i in range(len(shares))]
    if not total:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])
    targets = [share * (total - 1) for share in shares]
    at = order_statistics(df, value, [int(f(t)) for t in targets for f in (math.floor, math.ceil)], few)
    low, high = [float(at[math.floor(t)][0]) for t in targets], [float(at[math.ceil(t)][0]) for t in targets]
    return spark.range(1).select(*[F.lit(a + (t - math.floor(t)) * (b - a)).alias(n) for a, b, t, n in zip(low, high, targets, names)])


def tile_by_cuts(df: DataFrame, tiles: int, value: str, key: str, name: str = "tile", few: int = FEW) -> DataFrame:
    """``ntile`` over the whole table by (value, md5 of the key, key), from the exact rows where tiles end.

    The cut's value is an order statistic; among rows of that value, so is its md5, taken as a number. Rows without a value
    come first; ``key`` must not be NULL.
    """
    rows = df.withColumns({"__h": F.md5(F.col(key).cast("string")),
                           "__v": F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")))})
    total = rows.count()
    small, extra = divmod(total, tiles)
    ends = [k * small + min(k, extra) - 1 for k in range(1, tiles)]
    cuts = []
    for end in ends:
        if end < 0:
            cuts.append(None)
            continue
        (at, below), = order_statistics(rows, "__v", [end], few).values()
        same = rows.where(F.col("__v") == F.lit(at)).withColumn("__head", F.conv(F.substring("__h", 1, 15), 16, 10).cast("long"))
        (head, under), = order_statistics(same, "__head", [end - below], few).values()
        last = same.where(F.col("__head") == F.lit(head)).select("__h", key).orderBy("__h", key).limit(end - below - under + 1).collect()[-1]
        cuts.append((at, last["__h"], last[key]))
    order = F.struct(F.col("__v"), F.col("__h"), F.col(key))
    tile = F.lit(1)
    for cut in cuts:
        passed = F.lit(True) if cut is None else order > F.struct(*[F.lit(c) for c in cut])
        tile = tile + passed.cast("int")
    return rows.withColumn(name, tile.cast("long")).drop("__h", "__v")


def even_tiles(df: DataFrame, tiles: int, levels: Sequence[Column], order: Sequence[Column],
               name: str = "tile") -> DataFrame:
    """``ntile`` over the whole table; the first ``rows mod tiles`` tiles hold one row more."""
    numbered = ordinal(df, [], levels, order, "__n", 0)
    total = df.agg(F.count(F.lit(1)).alias("__total")).select("__total").scalar()
    small = F.floor(total / tiles)
    extra = total % tiles
    cut = extra * (small + 1)
    tile = F.when(F.col("__n") < cut, F.floor(F.col("__n") / (small + 1))) \
        .otherwise(extra + F.floor((F.col("__n") - cut) / F.greatest(small, F.lit(1))))
    return numbered.withColumn(name, (tile + 1).cast("long")).drop("__n")
