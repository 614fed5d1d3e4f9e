import pytest

from marginalia.llm import language


@pytest.fixture(scope="module")
def told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()


def test_held_out_accuracy(told):
    rows = [r for r in told[1] if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.97


def test_mixtures(told):
    docs, rows = told
    model = language.train(docs)
    whole = {r.lang: r.text for r in rows if r.held_out and 2000 < len(r.text) < 4000}
    for a, b in (("en", "fr"), ("de", "es")):
        name, share, names, shares = language.infer(model, whole[a][:2000] + "\n" + whole[b][:1000])
        assert name == a and set(names) >= {a, b} and 0.5 < share < 0.85 and sum(shares) == pytest.approx(1)
    assert language.infer(model, whole["de"])[2] == ["de"]


def test_edges(edge_docs, no_docs):
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(edge_docs).collect()}
    assert {(i, "und", 0.0) for i in (1, 2, 3, 4)} <= rows and all(0 <= r[2] <= 1 for r in rows)
    assert language.identify(no_docs).collect() == []
    assert {r.lang_pred for r in language.identify(edge_docs.where("lang is null")).collect()} == {"und"}
    kept = language.keep_reliable(edge_docs)
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.collect()} == {None, 5, 6, 7, 8, 9, 10}
    assert language.keep_reliable(no_docs).collect() == []


def test_labels_of_held_out_rows_are_not_read(make_docs):
    rows = [(i, "abc def ghi" if i % 2 else "xyz uvw rst", "one" if i % 2 else "two", None) for i in range(200)]
    docs = make_docs(rows)
    held = {r.doc_id for r in docs.select("doc_id", language.held_out(docs["doc_id"]).alias("h")).where("h").collect()}
    wrong = make_docs([(i, t, "wrong" if i in held else lang, None) for i, t, lang, _ in rows])
    same = lambda d: sorted(map(str, language.identify(d).collect()))
    assert held and same(docs) == same(wrong)
