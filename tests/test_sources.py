import pytest
import json

from pyspark.sql import functions as F

from marginalia import schemas as S
from marginalia.sources import readers as R, writers as W


def test_files_as_they_land(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("6432163\n\n  6432164 \n6432165\n")
    assert [r["id"] for r in R.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["6432163", "6432164", "6432165"]
    (tmp_path / "conv.json").write_text(json.dumps({"status": "ok", "records": [{"pmcid": "PMC1", "pmid": "9", "doi": "d"}, {"pmcid": "PMC2"}]}, indent=1))
    assert [tuple(r) for r in R.read_id_conversion(spark, str(tmp_path / "conv.json")).collect()] == [("1", "9", "d"), ("2", None, None)]
    (tmp_path / "qa.json").write_text(json.dumps({"7": {"QUESTION": "q?", "CONTEXTS": ["a", "b"], "MESHES": ["m"], "final_decision": "yes"}}, indent=1))
    row = R.read_qa_dataset(spark, str(tmp_path / "qa.json")).collect()[0]
    assert (row["pmid"], row["r"]["QUESTION"], row["r"]["YEAR"]) == ("7", "q?", None)
    judge = {"evaluations": [{"question_id": "q", "faithfulness": 1}, {"question_id": "q", "faithfulness": 5}], "summary": {}}
    (tmp_path / "judge.json").write_text(json.dumps(judge, indent=1))
    assert [(r["pos"], r["faithfulness"]) for r in R.read_judge_results(spark, str(tmp_path / "judge.json"), True).collect()] == [(0, 1), (1, 5)]
    page = lambda start, ids: json.dumps({"esearchresult": {"count": "5", "retstart": str(start), "idlist": ids}})
    (tmp_path / "pages.json").write_text(page(0, ["3", "1"]) + "\n" + page(2, ["1", "4"]) + "\n")
    assert sorted(r[0] for r in R.read_search_pages(spark, str(tmp_path / "pages.json")).collect()) == ["1", "3", "4"]
    assert sorted(r[0] for r in R.read_search_pages(spark, str(tmp_path / "pages.json"), 2).collect()) == ["1", "3"]
    assert R.search_count(spark, str(tmp_path / "pages.json")).collect()[0][0] == 5


def test_article_files(spark, tmp_path):
    (tmp_path / "PMC12.xml").write_bytes(b"<a/>")
    (tmp_path / "13.xml").write_bytes(b"<b>")
    (tmp_path / "x.txt").write_bytes(b"")
    assert {(r["pmc_id"], bytes(r["xml"])) for r in R.read_articles(spark, str(tmp_path)).collect()} == {("12", b"<a/>"), ("13", b"<b>")}


def test_golden_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q1", "1", "2", 'say "hi",\nthen go', "yes", "", "2020", "a|b", 3)], S.GOLDEN)
    W.write_csv(df, str(tmp_path / "g"))
    row = R.read_golden(spark, str(tmp_path / "g")).collect()[0]
    assert (row["question"], row["meshes"], row["num_contexts"]) == ('say "hi",\nthen go', "a|b", 3)


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        W.read_table(spark, path)
    old = W.replace_table(spark.range(3).toDF("x"), path)
    # the new content may come from the table itself
    W.replace_table(W.read_table(spark, path).withColumn("x", F.col("x") + 10), path)
    seen = lambda: sorted(r["x"] for r in W.read_table(spark, path).collect())
    assert seen() == [10, 11, 12] and spark.read.parquet(old).count() == 3
    # a failed replacement leaves the table as it was
    with pytest.raises(Exception):
        W.replace_table(W.read_table(spark, path).withColumn("x", F.raise_error(F.lit("no"))), path)
    assert seen() == [10, 11, 12]


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    spark.sql(f"create database if not exists m_test location '{tmp_path}/db'")
    a = spark.range(1000).select((F.col("id") % 100).alias("document_id"), F.col("id").alias("c"))
    b = spark.range(100).select(F.col("id").alias("document_id"), F.lit(50).alias("priority"))
    W.write_bucketed(a, "m_test.chunks_b", "document_id", 4)
    W.write_bucketed(b, "m_test.docs_b", "document_id", 4)
    from marginalia.operators.retrieval import live_chunks

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = live_chunks(spark.table("m_test.chunks_b"), spark.table("m_test.docs_b"), broadcast_ids=10)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and out.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_create_tables(spark, tmp_path):
    S.create_tables(spark, str(tmp_path))
    spark.createDataFrame([("7",)], "pmc_id string").write.mode("append").parquet(str(tmp_path / "papers"))
    S.create_tables(spark, str(tmp_path))
    assert spark.read.schema(S.PAPERS).parquet(str(tmp_path / "papers")).count() == 1
    assert spark.read.parquet(str(tmp_path / "chunks")).schema["embedding"].dataType.elementType.typeName() == "float"


def test_landed_articles_newest_file_and_increment(spark, tmp_path):
    import os

    path, rows = str(tmp_path / "files"), "pmc_id string, xml string"
    W.write_articles(spark.createDataFrame([("1", "<a>\n</a>"), ("2", "<b>")], rows), path)
    for root, _, names in os.walk(path):
        for name in names:
            os.utime(os.path.join(root, name), (1000, 1000))
    seen = R.read_landed_articles(spark, path).agg({"landed_at": "max"}).first()[0]
    assert R.read_landed_articles(spark, path, after=seen).count() == 0
    W.write_articles(spark.createDataFrame([("2", "<b/>"), ("3", "")], rows), path)
    read = lambda after: {r.pmc_id: bytes(r.xml).strip() for r in R.read_landed_articles(spark, path, after).collect()}
    assert read(None) == {"1": b"<a>\n</a>", "2": b"<b/>", "3": b""} and read(seen) == {"2": b"<b/>", "3": b""}


def test_article_summaries(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"Id": "PMC7", "Title": "t", "AuthorList": ["a"], "Other": 1}\n{"Title": "no id"}\n')
    rows = R.read_article_summaries(spark, str(tmp_path)).collect()
    assert [(r.pmc_id, r.title, r.authors, r.journal) for r in rows] == [("7", "t", ["a"], None)]


def test_chunk_run_reports_from_its_own_write(spark, tmp_path):
    from marginalia.sources.runs import chunk_run

    rows = [(i, "t", None, " ".join(["word"] * 30) if i % 3 else "", "fetched" if i < 9 else "chunked") for i in range(12)]
    docs = spark.createDataFrame(rows, "document_id long, title string, abstract string, full_text string, ingestion_status string") \
        .withColumn("section_offsets", F.expr("array(named_struct('section', 'body', 'char_start', 0, 'char_end', length(full_text)))"))
    for batch, name in ((None, "all"), (F.col("document_id") < 4, "some"), (F.col("document_id") < 0, "none")):
        r = chunk_run(docs, str(tmp_path / name), batch, 20, 5).first()
        stored = spark.read.parquet(str(tmp_path / name))
        success = stored.select("document_id").distinct().count()
        taken = docs.where("ingestion_status = 'fetched'").where(batch if batch is not None else F.lit(True)).count()
        assert (r.success, r.failed, r.total_chunks, r.remaining) == (success, taken - success, stored.count(), 9 - success)
        assert (r.ms_per_chunk is None) == (success == 0) and r.avg_chunks_per_doc == (round(r.total_chunks / success, 4) if success else 0)
