import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import mixing


def level_by_turns(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]} if total else set()
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, rng.randint(1, 50), rng.randint(1, 5000)]) for s in [None, "", "é", *map(str, range(rng.randint(0, 9)))]}
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(level_by_turns(sizes))


def test_takings(make_docs):
    rng = random.Random(1)
    docs = make_docs([(i, " ".join(["w"] * rng.randint(0, 40)), None, rng.choice(["a", "a", "a", "b", "c", None, "e"])) for i in range(2000)])
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.mix(sized).collect()
    again = mixing.mix(sized.repartition(7)).collect()
    assert len(rows) == 2000 and sorted(map(str, rows)) == sorted(map(str, again))
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    sums, targets = {}, {}
    for r in rows:
        sums[r.source] = sums.get(r.source, 0) + r.taken
        targets[r.source] = r.target
    assert all(abs(sums[s] - targets[s]) <= 80 for s in sums)
    assert sum(sums.values()) <= 1.5 * sum(r.size for r in rows)


def test_edges(edge_docs, no_docs):
    sized = lambda d: d.select("doc_id", "source", mixing.word_count(d["text"]).alias("size"))
    rows = mixing.mix(sized(edge_docs)).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(sized(no_docs)).collect() == []
    out = mixing.mixed_rows(edge_docs)
    assert out.columns == edge_docs.columns and mixing.mixed_rows(no_docs).collect() == []
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in rows if r.taken}


def test_only_empty_texts(make_docs):
    docs = make_docs([(1, None, None, "a"), (2, "", None, "b")])
    rows = mixing.mix(docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"))).collect()
    assert [(r.target, r.taken) for r in rows] == [(0.0, 0)] * 2
