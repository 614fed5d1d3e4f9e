import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators.sequences import lcs_length, longest_common, rouge_l


def table(a, b):
    """The whole table of lengths, cell by cell."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_against_the_whole_table(block):
    rng = random.Random(block)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice((2, 5, 40))) for _ in range(rng.randint(0, 60))] for _ in range(2))
        assert lcs_length(a, b, block) == table(a, b) == lcs_length(b, a, block)


def test_long_sequences_over_many_blocks():
    rng = random.Random(1)
    a = [rng.randrange(500) for _ in range(20_000)]
    dropped = [x for x in a if rng.random() < 0.9]
    assert lcs_length(a, dropped) == len(dropped)
    assert lcs_length(a, a[::-1][:3_000], 512) == lcs_length(a, a[::-1][:3_000], 100_000)


def test_columns(spark):
    rows = [(1, ["a", "b", "c", "d"], ["b", "x", "d"]), (2, [], ["a"]), (3, None, ["a"]), (4, ["é", "é"], ["é"]), (5, ["a"], ["a"])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>").repartition(2)
    got = {r.id: r.n for r in df.select("id", longest_common(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 1, 5: 1}


def test_measures(spark):
    rows = [("police killed the gunman", "police kill the gunman"), ("the gunman kill police", "police kill the gunman"),
            (None, "x"), ("x", None), ("", ""), ("Same, WORDS", "same words")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, c string, r string")
    got = {x.id: (x.o.lcs, x.o.precision, x.o.recall, x.o.f) for x in df.select("id", rouge_l(F.col("c"), F.col("r")).alias("o")).collect()}
    assert got == {0: (3, 0.75, 0.75, 0.75), 1: (2, 0.5, 0.5, 0.5), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (2, 1, 1, 1)}
    weighed = df.where("id = 0").select(rouge_l(F.lit("a b"), F.lit("a b c d"), 2.0)["f"].alias("f")).first().f
    assert weighed == pytest.approx(5 * 2 / (2 + 4 * 4))
