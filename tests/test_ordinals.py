"""Levelled numbering against plain windows, with one group holding most rows."""

import pytest
from pyspark.sql import Window as W, functions as F

from marginalia.operators import ordinals as O


@pytest.fixture(scope="module")
def skewed(spark):
    i = F.col("id")
    return spark.range(0, 6000).select(
        F.when(i % 3 == 0, 7).otherwise(i % 50).alias("g"), (i * 7919 % 6007).alias("turn"), i,
        F.md5(i.cast("string")).alias("h"))


def test_running_total_of_hot_groups(skewed):
    levels = [F.shiftright("turn", 8), F.shiftright("turn", 4)]
    got = O.running_total(skewed, ["g"], levels, [F.col("turn")], F.col("id"))
    w = W.partitionBy("g").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    want = skewed.withColumn("before", F.coalesce(F.sum("id").over(w), F.lit(0)))
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 6000


def test_global_numbers_and_batches(skewed):
    sparse = skewed.select((F.col("id") * 123_456_789).alias("k"))
    rows = O.number_ids(sparse, "k").orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(6000))
    sizes = O.fixed_batches(sparse, "k", 50).groupBy("batch_id").count().collect()
    assert len(sizes) == 120 and {r["count"] for r in sizes} == {50}


def test_hash_order(skewed):
    rows = O.ordinal(skewed.select("h"), [], O.hash_levels(F.col("h")), [F.md5("h")]).collect()
    ordered = sorted(rows, key=lambda r: r["n"])
    import hashlib
    keys = [hashlib.md5(r["h"].encode()).hexdigest() for r in ordered]
    assert keys == sorted(keys) and [r["n"] for r in ordered] == list(range(1, 6001))


@pytest.mark.parametrize("n, tiles", [(10, 4), (3, 4), (8, 4), (1, 1), (101, 7)])
def test_even_tiles(spark, n, tiles):
    df = spark.range(n)
    got = {r["id"]: r["tile"] for r in O.even_tiles(df, tiles, O.radix_levels(F.col("id")), [F.col("id")]).collect()}
    want = {r["id"]: r["t"] for r in df.withColumn("t", F.ntile(tiles).over(W.partitionBy(F.lit(0)).orderBy("id"))).collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 10, 101])
def test_exact_percentiles(spark, n):
    df = spark.range(n).select(((F.col("id") * 37 % 11) * 0.25).alias("v"))
    want = df.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95)))).collect()[0][0]
    assert list(O.exact_percentiles(df, "v", (0.5, 0.95)).collect()[0]) == pytest.approx(want)


def test_order_statistics(spark):
    import random

    rng = random.Random(3)
    for values, few in (([rng.random() * 1e6 for _ in range(4_000)], 400), ([float(rng.randrange(7)) for _ in range(3_000)], 50),
                        ([5.0] * 2_000 + [rng.random() * 10 for _ in range(1_500)], 400), ([2.5], 20_000)):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").coalesce(1).cache()
        ranks, ordered = sorted({0, len(values) // 2, len(values) - 1}), sorted(values)
        assert O.order_statistics(df, "v", ranks, few) == {r: (ordered[r], sum(v < ordered[r] for v in values)) for r in ranks}


def test_percentiles_from_ranges(spark):
    import numpy as np

    values = [float(i * i % 1_009) for i in range(2_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").coalesce(1)
    got = O.exact_percentiles(df, "v", (0.0, 0.25, 0.5, 0.95, 1.0), 100).first()
    assert list(got) == pytest.approx(list(np.percentile(values, [0, 25, 50, 95, 100])))
    assert list(O.exact_percentiles(df.limit(0), "v", (0.5,)).first()) == [None]


@pytest.mark.parametrize("n, few", [(0, 10), (3, 20_000), (401, 100)])
def test_tiles_by_cuts(spark, n, few):
    import hashlib

    rows = [(f"q{i}", None if i % 17 == 5 else float(i * 7 % 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v double").coalesce(1)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, hashlib.md5(r[0].encode()).hexdigest(), r[0]))
    small, extra = divmod(n, 4)
    want = {r[0]: (i // (small + 1) if i < extra * (small + 1) else extra + (i - extra * (small + 1)) // small) + 1 for i, r in enumerate(order)}
    assert {r.k: r.tile for r in O.tile_by_cuts(df, 4, "v", "k", few=few).collect()} == want
