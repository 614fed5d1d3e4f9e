import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import retrieval as R, vectors as E

CHUNKS = "document_chunk_id long, document_id long, chunk_index int, section string, content string, embedding array<float>"
DOCS = "document_id long, source_id string, title string, priority int, metadata struct<authors:array<string>,journal:string,pub_date:string,doi:string>"


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame([
        (1, 1, 0, "a", "x y", [1.0, 0.0]), (2, 1, 1, "a", "x", [0.0, 1.0]), (3, 2, 0, "a", "y", [1.0, 0.0]),
        (4, 3, 0, "a", "z", [1.0, 0.0]), (5, 1, 2, "a", "n", None), (6, 1, 3, "a", "n", [0.0, 0.0]),
        (7, 2, 1, "a", "n", [1.0, 0.0, 0.0]), (8, 2, 2, "a", "x", [1.0, 1.0])], CHUNKS)
    docs = spark.createDataFrame([(1, "11", "T1", 50, None), (2, "12", "T2", 10, (["A"], None, "2024", None)),
                                  (3, "13", "T3", 0, None)], DOCS)
    queries = spark.createDataFrame([(100, "x y z", [2.0, 0.0]), (101, "n", [0.0, 1.0])],
                                    "query_id long, qtext string, qvec array<float>")
    return queries, chunks, docs


def ids(df):
    return [(r["query_id"], r["document_chunk_id"]) for r in df.orderBy("query_id", "rank").collect()]


def test_topk_cases(corpus):
    """Ties by id; excluded document, NULL, zero and wrongly sized vectors take no part; k beyond the corpus."""
    q, c, d = corpus
    assert ids(R.nearest_chunks(q, c, d, 10)) == [(100, 1), (100, 3), (100, 8), (100, 2), (101, 2), (101, 8), (101, 1), (101, 3)]
    assert ids(R.nearest_chunks(q, c, d, 2)) == [(100, 1), (100, 3), (101, 2), (101, 8)]


def test_widths_do_not_depend_on_row_order(spark, corpus):
    """Queries and chunks of several widths: each meets its own width, in the scan and in the grid."""
    _, c, d = corpus
    for order in ([1.0, 0.0], [1.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [1.0, 0.0]):
        q = spark.createDataFrame([(100 + len(v), "x", v) for v in order], "query_id long, qtext string, qvec array<float>")
        want = [(102, 1), (102, 3), (102, 8), (102, 2), (103, 7)]
        assert ids(R.nearest_chunks(q, c, d, 10)) == want
        live = R.live_chunks(c, d)
        assert ids(E.vector_topk(q, live, 10, broadcast_queries=1, grid_chunks=2)) == want


def test_no_queries(corpus):
    q, c, d = corpus
    assert R.nearest_chunks(q.where("query_id < 0"), c, d).count() == 0


def test_metadata_defaults(corpus):
    q, c, d = corpus
    rows = R.semantic_search(q, c, d, 4, 4).where("query_id = 100").orderBy("rank").collect()
    assert [(r["source_id"], r["authors"], r["journal"], r["publication_date"], r["doi"]) for r in rows][:2] == [
        ("11", [], "", "", ""), ("12", ["A"], "", "2024", "")]


def test_rerank_is_stable(corpus):
    q, c, d = corpus
    rows = R.semantic_search(q, c, d, 4, 3, use_reranker=True).where("query_id = 100").orderBy("rank").collect()
    assert [r["document_chunk_id"] for r in rows] == [1, 3, 8]
    assert rows[0]["rerank_score"] == pytest.approx(2 / 3)


def test_grid_equals_scan(spark):
    rng = random.Random(3)
    vec = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]  # many ties
    c = spark.createDataFrame([(i, i % 9, vec()) for i in range(400)], "document_chunk_id long, document_id long, embedding array<float>")
    q = spark.createDataFrame([(i, vec()) for i in range(37)], "query_id long, qvec array<float>").where(
        "exists(qvec, x -> x <> 0)")
    a = E.vector_topk(q, c, 6)
    b = E.vector_topk(q, c, 6, broadcast_queries=10, grid_chunks=64)
    key = lambda df: {(r["query_id"], r["rank"], r["document_chunk_id"]) for r in df.collect()}
    assert key(a) == key(b) and a.count() == 6 * q.count()


def brute_expand(chunks, wanted, exclude, n):
    good = ("abstract", "conclusion", "discussion", "result", "introduction", "background", "limitation")
    out = set()
    for q, d in wanted:
        mine = sorted((r for r in chunks if r[1] == d and (q, r[0]) not in exclude), key=lambda r: (r[2], r[0]))
        rank, rows = {}, []
        for r in mine:
            rank[r[3]] = rank.get(r[3], 0) + 1
            low = r[3] is None or not any(g in r[3].lower() for g in good)
            rows.append((rank[r[3]], 1 + low, r[3] is None, r[3] or "", r[0]))
        out |= {(q, d, r[4], i + 1) for i, r in enumerate(sorted(rows)[:n])}
    return out


@pytest.mark.parametrize("n, skip", [(1, 0), (3, 4), (5, 12)])
def test_expansion_with_a_hot_document(spark, n, skip):
    rng = random.Random(n)
    names = ["abstract", "Results 1", "methods", None, "ethics", "Conclusions"] + [f"s{i}" for i in range(30)]
    rows = [(i, 0 if i % 3 == 0 else i % 20, i // 7, rng.choice(names), None, None) for i in range(900)]
    wanted = [(q, d) for q in range(6) for d in {0, q, q + 7}]
    exclude = {(q, r[0]) for q in range(6) for r in rng.sample([r for r in rows if r[1] in (0, q)], skip)}
    got = R.expand_documents(
        spark.createDataFrame(wanted, "query_id long, document_id long"), spark.createDataFrame(rows, CHUNKS),
        spark.createDataFrame(list(exclude), "query_id long, document_chunk_id long") if exclude else None, n, skip)
    assert {tuple(r) for r in got.collect()} == brute_expand(rows, wanted, exclude, n)


def test_history_newest_first_and_capped(spark):
    fresh = spark.createDataFrame([(1, 10)], "query_id long, document_chunk_id long")
    history = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 1, 10), (1, 3, 0, 6), (1, 3, 1, 5), (1, 5, 0, 7), (2, 1, 0, 9)],
                                    "query_id long, turn long, pos int, document_chunk_id long")
    got = R.historical_chunks(fresh, history, 2).orderBy("query_id", "position").collect()
    assert [(r["query_id"], r["document_chunk_id"]) for r in got] == [(1, 7), (1, 6), (2, 9)]


def test_probing_all_lists_is_exact(corpus):
    q, c, d = corpus
    live = R.live_chunks(c, d).where("size(embedding) = 2 and exists(embedding, x -> x <> 0)")
    centroids = E.fit_centroids(live, 2)
    near = E.probe_topk(q, E.assign_lists(live, centroids), centroids, 3, 2)
    grid = E.probe_topk(q, E.assign_lists(live, centroids), centroids, 3, 2, broadcast_queries=1, grid_chunks=2)
    assert ids(grid) == ids(near)
    assert ids(near) == ids(R.nearest_chunks(q, c, d, 3))
    assert {r["recall"] for r in E.recall_at_k(near, near).collect()} == {1.0}


def test_embedding_of_blank_texts(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,), ("  ",)], "t string")
    rows = [r[0] for r in df.select(E.hashing_embedder(8)(F.col("t"))).collect()]
    assert rows[1:] == [None, None, None]
    assert sum(x * x for x in rows[0]) == pytest.approx(1, abs=1e-6)


def test_diversify_prefers_unlike_chunks(spark):
    hits = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.01]), (1, 3, 0.5, [0.0, 1.0])],
                                 "query_id long, document_chunk_id long, similarity_score double, embedding array<float>")
    got = R.diversify(hits, 2, 0.5).orderBy("mmr_rank").collect()
    assert [r["document_chunk_id"] for r in got] == [1, 3]


def test_variant_metadata_of_mixed_sources(spark):
    from marginalia.operators.retrieval import parse_metadata, variant_fields

    rows = [(1, '{"authors": ["a", "b"], "pub_date": "2020", "journal": "j", "doi": "d", "more": {"x": 1}}'),
            (2, '{"authors": "a", "pub_date": 2021, "journal": {"name": "j"}}'), (3, '{"authors": null, "doi": true, "journal": ["j"]}'),
            (4, "{}"), (5, ""), (6, None), (7, "{ no json"), (8, "[1]"), (9, '"text"')]
    found = spark.createDataFrame(rows, "id int, metadata string").withColumn("metadata", parse_metadata(F.col("metadata"))) \
        .select("id", *[c.alias(n) for n, c in variant_fields().items()]).collect()
    got = {r.id: tuple(r)[1:] for r in found}
    assert got[1] == (["a", "b"], "2020", "j", "d") and got[2] == ([], "2021", "", "") and got[3] == ([], "", "", "true")
    assert all(got[i] == ([], "", "", "") for i in range(4, 10))
