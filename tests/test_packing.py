import random

import pytest

from marginalia.operators.packing import greedy_batches


def one_pass(rows, max_chunks, max_tokens):
    out, batch, chunks, tokens = {}, None, 0, 0
    for doc, c, t in sorted(rows):
        if c <= 0:
            continue
        if batch is None or chunks + c > max_chunks or tokens + t > max_tokens:
            batch, chunks, tokens = doc, 0, 0
        out[doc] = batch
        chunks, tokens = chunks + c, tokens + t
    return out


SHAPES = {
    "small batches": (300, 9, (1, 4), (1, 30), 60),
    "chunks decide": (400, 25, (1, 6), (0, 1), 10 ** 9),
    "tokens decide": (400, 10 ** 4, (1, 2), (1, 50), 200),
    "documents above the limits": (200, 10, (1, 60), (1, 300), 200),
    "every document alone": (60, 1, (1, 5), (1, 3), 10),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_against_one_pass(spark, shape):
    n, max_chunks, chunks, tokens, max_tokens = SHAPES[shape]
    rng = random.Random(n)
    rows = [(i * 3 + rng.randrange(3), rng.randint(*chunks) if rng.random() < 0.95 else 0, rng.randint(*tokens)) for i in range(n)]
    df = spark.createDataFrame(rows, "document_id long, chunk_count long, token_count long").repartition(3)
    got = {r.document_id: r.batch for r in greedy_batches(df, max_chunks, max_tokens, 2).collect()}
    assert got == one_pass(rows, max_chunks, max_tokens)


def test_no_documents(spark):
    schema = "document_id long, chunk_count long, token_count long"
    assert greedy_batches(spark.createDataFrame([], schema), 5, 5).collect() == []
    assert greedy_batches(spark.createDataFrame([(1, 0, 4)], schema), 5, 5).collect() == []
    assert [tuple(r) for r in greedy_batches(spark.createDataFrame([(1, 9, 4)], schema), 5, 5).collect()] == [(1, 1, 9, 4)]
