import numpy as np
import pytest

from marginalia.llm import ann

TABLE = "vec_id long, embedding array<float>, label int, q string, v string, width string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], None, "a", "b", "c")
                                  for i, v in rows], TABLE)


def brute(rows, wanted=10):
    out = {}
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    for i, v in rows:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = near[:wanted]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("settings", [ann.Settings(), ann.Settings(lists=40, block_rows=100, chunk_queries=3)])
def test_recall(spark, settings):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64)) for i in range(2500)]
    want, got = brute(rows), answers(ann.nearest(table(spark, rows), settings=settings))
    assert want.keys() == got.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    true = {(q, j): s for q in want for s, j in want[q]}
    assert all(s == pytest.approx(true[q, j], rel=1e-12) for q in got for s, j in got[q] if (q, j) in true)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=8)
    rows = [(i, same if i % 3 == 0 else rng.normal(size=8)) for i in range(600)]
    got = answers(ann.nearest(table(spark, rows), settings=ann.Settings(lists=16, block_rows=50)))
    assert got[300] == brute(rows)[300] and got[0] == brute(rows)[0]


def test_query_id_repeated_many_times(spark):
    rng = np.random.default_rng(3)
    same = rng.normal(size=8)
    rows = [(i, rng.normal(size=8)) for i in range(1, 600)] + [(0, same)] * 15
    exact = ann.Settings(lists=8, share=1.0, strictness=100.0, block_rows=1000)
    got, want = answers(ann.nearest(table(spark, rows), settings=exact)), brute(rows)
    assert [j for _, j in got[0]] == [j for _, j in want[0]] and got[0] == [(pytest.approx(s), j) for s, j in want[0]]
    few = [(0, same)] * 15 + [(i, -same * i) for i in range(1, 6)]  # the copies alone reach the share of all vectors
    assert [j for _, j in answers(ann.nearest(table(spark, few)))[0]] == [1, 2, 3, 4, 5]


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0, 0]), (1, [0, 1, 0]), (2, None), (3, [0, 0, 0]), (4, [nan, 1, 1]), (5, [None, 1, 1]), (6, [inf, 0, 0]),
            (7, [1, 1]), (None, [1, 0, 0]), (8, []), (100, [0, 0, 2]), (100, [0, 0, 2]), (200, [2, 1]), (300, [0, 0, 0])]
    got = answers(ann.nearest(table(spark, rows)))
    near = lambda a, b: pytest.approx(np.sqrt(((np.array(a) - b) ** 2).sum()))
    assert got == {0: [(near([1, 0, 0], [0, 1, 0]), 1), (near([1, 0, 0], [0, 0, 2]), 100), (near([1, 0, 0], [0, 0, 2]), 100)],
                   100: [(near([1, 0, 0], [0, 0, 2]), 0), (near([0, 1, 0], [0, 0, 2]), 1)], 200: [(1.0, 7)]}
    assert ann.nearest(table(spark, [])).collect() == []
