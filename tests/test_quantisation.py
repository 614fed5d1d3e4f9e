import os

import numpy as np
import pytest

from marginalia.operators import quantisation as Q, vectors as E


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, i // 3, (centres[i % 12] + rng.normal(size=16)).tolist(), "ab"[i % 40 == 0]) for i in range(900)]
    chunks = spark.createDataFrame(rows + [(900, 300, None, "a"), (901, 300, [0.0] * 16, "a")],
                                   "document_chunk_id long, document_id long, embedding array<double>, section string")
    queries = spark.createDataFrame([(i, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(15)] + [(99, None)],
                                    "query_id long, qvec array<double>")
    return chunks, queries


def test_codes_and_tables():
    rng = np.random.default_rng(1)
    books = Q.Codebooks(rng.normal(size=(4, 9, 2)))
    unit = rng.normal(size=(30, 8))
    codes, tables = books.codes(unit), books.tables(unit)
    for r, row in enumerate(unit):
        for s in range(4):
            part = row[2 * s:2 * s + 2]
            assert codes[r, s] == min(range(9), key=lambda w: ((books.words[s, w] - part) ** 2).sum())
            assert tables[r, s] == pytest.approx(books.words[s] @ part)


def test_search_and_filter(spark, tables, tmp_path):
    chunks, queries = tables
    centroids, books = E.fit_centroids(chunks, 6), Q.fit_codebooks(chunks, 8, 32)
    path = str(tmp_path / "index")
    Q.encode(chunks, centroids, books).write.partitionBy("list_id").parquet(path)
    index = spark.read.parquet(path)
    assert "embedding" not in index.columns and {len(r.codes) for r in index.select("codes").collect()} == {8}
    exact = {(r.query_id, r.document_chunk_id) for r in E.vector_topk(queries, chunks, 10).collect()}
    got = Q.compressed_topk(queries, index, chunks, centroids, books, 10, 3).collect()
    assert len(got) == 150 and len(exact & {(r.query_id, r.document_chunk_id) for r in got}) >= 0.9 * len(exact)
    # every list and a shortlist of everything: the exact answer
    whole = Q.compressed_topk(queries, index, chunks, centroids, books, 10, 6, 100).collect()
    assert {(r.query_id, r.document_chunk_id) for r in whole} == exact
    # few rows fit: each query finds ten of them, or all, although its nearest lists hold fewer
    some = Q.compressed_topk(queries, index.where("section = 'b'"), chunks, centroids, books, 10, 1).collect()
    assert {q: sum(r.query_id == q for r in some) for q in range(15)} == {q: 10 for q in range(15)}
    assert all(r.document_chunk_id % 40 == 0 for r in some)
    assert Q.compressed_topk(queries, index.where("section = 'none'"), chunks, centroids, books, 10, 1).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_recall_on_given_vectors(spark):
    from marginalia.plans import fixtures as V

    sf = "/root/testdata/sf0.1"
    chunks, queries = V.bare_vec_chunks(spark, sf).where("embedding is not null"), V.questions(spark, sf)
    centroids, books = E.fit_centroids(chunks, 8), Q.fit_codebooks(chunks, 16, 256)
    near = Q.compressed_topk(queries, Q.encode(chunks, centroids, books), chunks, centroids, books, 10, 6, 10)
    recall = E.recall_at_k(near, E.vector_topk(queries, chunks, 10)).agg({"recall": "avg"}).first()[0]
    assert recall >= 0.9
