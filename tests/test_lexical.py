import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.operators import lexical as L


def brute(queries, passages, corpus, k1=1.2, b=0.75):
    words = lambda text: re.findall(r"\w+", (text or "").lower())
    df = Counter(t for text in corpus for t in set(words(text)))
    n, mean = len(corpus), sum(len(words(t)) for t in corpus) / len(corpus)
    out = {}
    for q, asked in queries.items():
        for c, content in passages.items():
            own, length, score = Counter(words(content)), len(words(content)), 0.0
            for t in set(words(asked)):
                if own[t] and df[t]:
                    score += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * own[t] * (k1 + 1) / (own[t] + k1 * (1 - b + b * length / mean))
            out[q, c] = score
    return out


@pytest.fixture
def told(spark, tmp_path):
    rng = random.Random(5)
    corpus = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, ""]
    L.write_statistics(spark.createDataFrame([(t, "x") for t in corpus], "content string, df string"), str(tmp_path / "s"))
    return corpus, L.read_statistics(spark, str(tmp_path / "s"))


def test_scores_against_brute_force(spark, told):
    corpus, statistics = told
    queries = {1: "Alpha BETA beta", 2: "delta unknown words", 3: "nothing of it", 4: "", 5: None}
    passages = {i: t for i, t in enumerate(corpus)} | {900: "newcomer alpha newcomer"}
    rows = [(q, c, a, t) for q, a in queries.items() for c, t in passages.items()]
    candidates = spark.createDataFrame(rows, "query_id long, document_chunk_id long, qtext string, content string")
    got = {(r.query_id, r.document_chunk_id): r.bm25_score for r in L.bm25(candidates, statistics).collect()}
    want = brute(queries, passages, corpus)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert got[3, 0] == got[4, 0] == got[5, 0] == 0
    top = L.rerank_bm25(candidates, statistics, 3).collect()
    for q in queries:
        order = sorted(passages, key=lambda c: (-round(want[q, c], 9), c))[:3]
        assert [r.document_chunk_id for r in sorted((r for r in top if r.query_id == q), key=lambda r: r.rank)] == order


def test_statistics(spark, told, tmp_path):
    corpus, statistics = told
    assert statistics.texts == 82 and statistics.mean_terms == sum(len((t or "").split()) for t in corpus) / 82
    other = corpus[:-1] + ["alpha"]
    L.write_statistics(spark.createDataFrame([(t,) for t in reversed(corpus)], "content string").repartition(5), str(tmp_path / "same"))
    L.write_statistics(spark.createDataFrame([(t,) for t in other], "content string"), str(tmp_path / "other"))
    assert L.read_statistics(spark, str(tmp_path / "same")).version == statistics.version
    assert L.read_statistics(spark, str(tmp_path / "other")).version != statistics.version
    empty = spark.createDataFrame([], "content string")
    L.write_statistics(empty, str(tmp_path / "none"))
    nothing = L.read_statistics(spark, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, 2, "a", "a b")], "query_id long, document_chunk_id long, qtext string, content string")
    assert nothing.texts == 0 and L.bm25(asked, nothing).first().bm25_score == 0
    with pytest.raises(Exception, match="already exists"):
        L.write_statistics(empty, str(tmp_path / "none"))


def test_weights_are_stored_and_shared(spark, tmp_path):
    texts = spark.createDataFrame([(i, i, t) for i, t in enumerate(["the cat", "the dog", "the the bird", "", None, "the mouse"])],
                                  "document_chunk_id long, document_id long, content string")
    fitted = L.fit_weights(texts, dims=64)
    L.write_weights(spark, fitted, str(tmp_path / "w"))
    read = L.read_weights(spark, str(tmp_path / "w"))
    assert read.version == fitted.version and (read.weights == fitted.weights).all()
    the = texts.select(L.hashed_buckets(F.lit("the"), 64)[0]).first()[0]
    assert fitted.weights[the] == pytest.approx(math.log(7 / 5) + 1) == fitted.weights.min()
    chunks = L.embed_weighted(texts, F.col("content"), read)
    vectors = {r.document_chunk_id: r.embedding for r in chunks.collect()}
    assert vectors[3] is None and vectors[4] is None and sum(x * x for x in vectors[0]) == pytest.approx(1)
    queries = L.embed_weighted(spark.createDataFrame([(7, "the bird"), (8, None)], "query_id long, t string"), F.col("t"), read, "qvec")
    hits = L.text_topk(queries, chunks, 2).collect()
    assert [(r.query_id, r.document_chunk_id) for r in hits if r.similarity_score > 0.9] == [(7, 2)]
    other = L.fit_weights(texts.where("document_id < 3"), dims=64)
    assert other.version != read.version
    with pytest.raises(ValueError, match="different weights"):
        L.text_topk(queries, L.embed_weighted(texts, F.col("content"), other), 2)
    with pytest.raises(ValueError, match="different weights"):
        L.text_topk(queries.withColumn("qvec_version", F.lit(None).cast("string")), chunks, 2)
