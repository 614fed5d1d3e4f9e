"""Work that must be done once, and files that must not grow with the number of rows."""

import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators import curation
from marginalia.operators.articles import fetch_details
from marginalia.operators.packing import greedy_batches
from marginalia.plans import conversing
from marginalia.session import scratch_path
from marginalia.sources import readers as R, writers as W
from marginalia.streaming import ingest, tokens as T


@pytest.fixture
def counted(spark):
    """Passes a column through and counts how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def through(x):
        seen.add(1)
        return x
    return through.asNondeterministic(), seen


def test_articles_land_in_few_files(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = spark.range(60).repartition(2).select(F.col("id").cast("string").alias("pmc_id"), F.concat(F.lit("<a>"), "id", F.lit("</a>")).alias("xml"))
    W.write_articles(rows, path)
    names = [n for _, _, files in os.walk(path) for n in files if not n.startswith((".", "_"))]
    assert len(names) <= 2
    assert {r.pmc_id: bytes(r.xml) for r in R.read_landed_articles(spark, path).collect()} == {str(i): f"<a>{i}</a>".encode() for i in range(60)}


def test_articles_in_packages_beside_their_own_files(spark, tmp_path):
    path = str(tmp_path / "files")
    W.write_articles(spark.createDataFrame([("1", "<a/>"), ("1", "<b/>"), ("2", None), (None, "<c/>"), ("x", "<d/>")], "pmc_id string, xml string").coalesce(1), path)
    for root, _, names in os.walk(path):
        for name in names:
            os.utime(os.path.join(root, name), (1000, 1000))
    os.mkdir(f"{path}/article=PMC7")
    for name in ("1.xml", "2.xml"):
        with open(f"{path}/article=PMC7/{name}", "w") as f:
            f.write(name)
        os.utime(f"{path}/article=PMC7/{name}", (2000, 2000))
    read = lambda after: {r.pmc_id: bytes(r.xml) for r in R.read_landed_articles(spark, path, after).collect()}
    assert read(None) == {"1": b"<b/>", "2": b"", "7": b"2.xml"}
    seen = R.read_landed_articles(spark, path).where("pmc_id <> '7'").agg(F.max("landed_at")).first()[0]
    assert read(seen) == {"7": b"2.xml"}


def test_articles_are_parsed_once(spark, counted):
    through, seen = counted
    xml = F.when(through("id") % 2 == 0, "<article><body/></article>").otherwise("<article>")
    articles = spark.range(20).select(F.col("id").cast("string").alias("pmc_id"), xml.alias("xml"))
    summaries = spark.createDataFrame([("0", "t", ["a"], "j", "2024", "", None)], "pmc_id string, title string, authors array<string>, "
                                      "journal string, pub_date string, doi string, pmid string")
    docs, failed = fetch_details(articles, summaries)
    assert (docs.count(), failed.count(), seen.value) == (1, 19, 20)


@pytest.mark.parametrize("pack", [greedy_batches, curation.pack_batches])
def test_sizes_are_counted_once(spark, counted, pack):
    through, seen = counted
    sizes = spark.range(50).select(F.col("id").alias("document_id"), (through("id") * 0 + 2).alias("chunk_count"), F.lit(10).cast("long").alias("token_count"))
    out = pack(sizes, 20, 1000)
    assert out.count() == 50 and seen.value == 50


def _landed(spark, ids, at, text="word"):
    return spark.range(*ids).select(
        F.col("id").cast("string").alias("source_id"), F.lit("t").alias("title"), F.lit("").alias("abstract"), F.lit(f"{text} here").alias("full_text"),
        F.expr("array(named_struct('section', 'body', 'char_start', 0, 'char_end', 9))").alias("section_offsets"),
        F.timestamp_seconds(F.lit(at)).alias("landed_at"))


def test_ingest_computes_a_batch_once(spark, counted):
    through, seen = counted
    out = scratch_path(spark, "once")
    ingest.write_version(_landed(spark, (30,), 1).withColumn("source_id", through(F.col("source_id").cast("long")).cast("string")), out, "s", 0, 8, 2)
    assert seen.value == 30
    assert ingest.current_documents(spark, out).count() == 30 == ingest.current_chunks(spark, out).count()


def test_compact_of_whole_mixed_and_dead_versions(spark):
    out, small = scratch_path(spark, "versions"), scratch_path(spark, "small")
    twice = _landed(spark, (40, 45), 1, "late").unionByName(_landed(spark, (40, 45), 2, "news"))
    for k, (batch, name) in enumerate(((_landed(spark, (40,), 5), "a"), (_landed(spark, (10, 20), 9, "news"), "b"), (_landed(spark, (40,), 3, "dead"), "c"),
                                       (twice, "d"))):
        ingest.write_version(batch, out, name, k, 8, 2)
    ingest.compact(spark, out, small)
    for where in (out, small):
        assert {r.document_id: r.content for r in ingest.current_chunks(spark, where).collect()} == {
            i: "news here" if 10 <= i < 20 or i >= 40 else "word here" for i in range(45)}
        assert ingest.current_documents(spark, where).count() == 45


@pytest.mark.parametrize("maps", [ingest.MAPS, 1])
def test_listed(spark, monkeypatch, maps):
    monkeypatch.setattr(ingest, "MAPS", maps)
    numbers = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, -1, -32768, 10 ** 15, 2 ** 62]
    rows = spark.createDataFrame([(g, n, f"{g}{n}") for g in "ab" for n in [*numbers, None]], "g string, n long, x string")
    wanted = spark.createDataFrame([("a", n) for n in numbers[::2]] + [("b", n) for n in numbers[1::2]] + [("a", None), ("c", 1), ("a", 0)], "g string, n long")
    got = sorted(r.x for r in ingest.listed(rows, wanted, "g", "n").collect())
    assert got == sorted([f"a{n}" for n in numbers[::2]] + [f"b{n}" for n in numbers[1::2]])


def test_first_arrivals_by_place(spark):
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "arrived", "state"))
    for at, text in ((3600, "word"), (7200, "again")):
        _landed(spark, (6,), at, text).write.mode("append").parquet(landing)
        arrivals = ingest.first_arrivals(ingest.places(spark.readStream.schema(ingest.LANDED).parquet(landing)))
        assert "full_text" not in arrivals.columns
        ingest.start_ingest(arrivals, out, state, 8, 2).awaitTermination()
    assert sorted((r.document_id, r.full_text) for r in ingest.current_documents(spark, out).collect()) == [(i, "word here") for i in range(6)]


def test_answers_are_filtered_once(spark, counted):
    through, seen = counted
    words = ["## Answer: abc", " d", " e", "\n", "## References", " x"]
    rows = [(c, t, i, "token", w) for c in range(5) for t in range(2) for i, w in enumerate(words, 1)]
    rows += [(c, t, 0, "start", None) for c in range(5) for t in range(2)] + [(c, t, 7, "complete" if c else "error", None) for c in range(5) for t in range(2)]
    events = spark.createDataFrame(rows, "conv_id long, turn long, seq int, type string, content string").repartition(3).withColumn("conv_id", through("conv_id"))
    parts = T.filter_answers(events)
    assert "Pandas" not in parts._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.conv_id, r.turn, r.kind, r.content) for r in conversing._shown(parts).collect())
    full = "".join(words[:-1]).strip()  # nothing is kept after the references heading
    assert got == sorted([(c, t, "shown", "abc d e") for c in range(5) for t in range(2)] + [(c, t, "complete", full) for c in range(1, 5) for t in range(2)])
    assert seen.value == len(rows)


def test_buckets_are_made_once(spark, counted):
    """Weights and vectors from stored buckets are those from the texts."""
    from marginalia.operators import lexical as L
    from marginalia.operators.vectors import hashed_buckets

    texts = spark.createDataFrame([(1, "a cat and a dog"), (2, "a bird"), (3, ""), (4, None)], "document_chunk_id long, content string")
    made = texts.withColumn("buckets", hashed_buckets(F.col("content"), 64))
    plain, ready = L.fit_weights(texts, dims=64), L.fit_weights(made.drop("content"), dims=64, buckets="buckets")
    assert plain.version == ready.version and (plain.weights == ready.weights).all()
    a, b = L.embed_weighted(texts, F.col("content"), plain), L.embed_weighted(made, None, ready, buckets="buckets")
    assert {r.document_chunk_id: r.embedding for r in a.collect()} == {r.document_chunk_id: r.embedding for r in b.collect()}
    assert "md5" not in L.embed_weighted(made.localCheckpoint(), None, ready, buckets="buckets")._jdf.queryExecution().executedPlan().toString()


def test_texts_of_hits_are_not_shuffled(spark, tmp_path):
    """A bounded list of hits meets the chunks where they are; texts of other chunks never leave their task."""
    from marginalia.operators import retrieval

    spark.range(100).select(F.col("id").alias("document_chunk_id"), F.lit("s").alias("section"), F.lit("text").alias("content")).write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([(i, 2 * i) for i in range(3)], "query_id long, document_chunk_id long").write.parquet(str(tmp_path / "h"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qvec array<double>")
    chunks = spark.createDataFrame([(5, 1, [1.0, 0.0])], "document_chunk_id long, document_id long, embedding array<double>")
    hits, bound = retrieval.counted_nearest(queries, chunks, spark.createDataFrame([(1, 50)], "document_id long, priority int"), 3)
    assert bound == 1 and hits.count() == 1
    out = retrieval.with_chunks(spark.read.parquet(str(tmp_path / "h")), spark.read.parquet(str(tmp_path / "c")), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 3 and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
