import inspect

import corpus_pipeline as P
import pytest

from marginalia.llm import language, ngram_join, toxicity


def test_stages_on_edges(spark, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge_docs, no_docs):
        for name, stage in P.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
            stage(spark, docs, str(tmp_path)).collect()
        P.packed(spark, docs, str(tmp_path)).collect()


def test_whole_run(spark, sf):
    """Each stage's rows are those that its operator's own answers leave."""
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in P.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, docs, sf).persist()
        left[name] = (docs, out)
        docs = out
    ids = lambda df, col="doc_id": sorted(r[0] for r in df.select(col).collect())
    before, after = left["language"]
    assert ids(after) == sorted(r.doc_id for r in language.identify(before).collect() if language.reliable(r.lang_pred, r.score))
    before, after = left["toxicity"]
    told = toxicity.toxicity(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert ids(after) == sorted(r.doc_id for r in told if not r.predicted)
    before, after = left["near duplicates"]
    assert ids(after) == sorted(r.doc_id for r in ngram_join.classes(before, P.NEAR).collect() if r.doc_id == r.component_id)
    before, after = left["mixing"]
    assert set(ids(after)) < set(ids(before)) and max(map(ids(after).count, set(ids(after)))) == 2
    before, after = left["packing"]
    assert set(ids(after)) == set(ids(before))
    whole = P.run(spark, sf)
    assert sorted(map(str, whole.drop("sequence_id", "offset").collect())) == sorted(map(str, after.drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("name", ["language", "toxicity", "near duplicates", "mixing", "packing"])
def test_order(name):
    assert [n for n, _ in P.STAGES].index(name) == ["language", "toxicity", "near duplicates", "mixing", "packing"].index(name)
    assert P.ORACLE_SQL is None
