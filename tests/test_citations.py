import pytest
from pyspark.sql import functions as F

from marginalia.operators import citations as C, conversations as K, curation, keyed

M = "conv_id long, turn long, role string, content string"
R = "conv_id long, turn long, rank int, source_id string, chunk_id long, title string, journal string"


@pytest.fixture(scope="module")
def talk(spark):
    messages = spark.createDataFrame([
        (1, 0, "user", "q?"), (1, 1, "assistant", "## Answer\nx [PMC5] y [PMC6, PMC99] [7]\n## References\n[PMC5] t"),
        (1, 2, "user", "more [3]"), (1, 3, "assistant", "z [PMC5] w [PMC8] [1]"), (2, 0, "user", "hi"),
        (2, 1, "assistant", "none [1] [PMC5]")], M)
    retrieved = spark.createDataFrame([
        (1, 1, 0, "5", 50, "T5", "J"), (1, 1, 1, "6", 60, "T6", "J"), (1, 1, 2, "5", 51, "T5", "J"),
        (1, 3, 0, "8", 80, "T8", "J"), (1, 3, 1, "5", 59, "T5", "J"), (2, 1, 0, "4", 40, "T4", "J")], R)
    return messages, retrieved


def test_numbers_are_reused_and_invalid_sources_take_none(talk):
    cited = C.valid_citations(*talk)
    cites = C.conversation_citations(cited)
    assert [(r["number"], r["source_id"], r["chunk_id"]) for r in cites.orderBy("number").collect()] == [
        (1, "5", 51), (2, "6", 60), (3, "8", 80)]
    numbered = C.turn_citations(cited, cites).orderBy("turn", "pos").collect()
    assert [(r["turn"], r["number"]) for r in numbered] == [(1, 1), (1, 2), (3, 1), (3, 3)]


def test_display(talk):
    messages, retrieved = talk
    cites = C.conversation_citations(C.valid_citations(messages, retrieved))
    shown = {(r["conv_id"], r["turn"]): r["display"] for r in C.display_messages(messages, cites).collect()}
    assert shown[1, 1] == "x [1] y [2, PMC99] "
    assert shown[1, 2] == "more [3]"
    assert shown[1, 3] == "z [1] w [3] [1]"
    assert shown[2, 1] == "none  [PMC5]"


def test_stored_ids(talk):
    messages, retrieved = talk
    cited = C.valid_citations(messages, retrieved)
    rows = {(r["conv_id"], r["turn"]): r for r in C.store_citations(messages, cited, C.conversation_citations(cited)).collect()}
    assert rows[1, 0]["cited_source_ids"] is None
    assert rows[1, 3]["cited_source_ids"] == ["5", "8"] and rows[1, 3]["cited_chunk_ids"] == [51, 80]
    assert rows[2, 1]["cited_chunk_ids"] == []


def test_hot_conversation(spark):
    cited = spark.range(0, 5000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), (F.col("id") % 3).cast("int").alias("pos"),
        (F.col("id") * 37 % 4001).cast("string").alias("source_id"), F.col("id").alias("chunk_id"))
    rows = C.conversation_citations(cited).orderBy("turn", "pos").collect()
    assert [r["number"] for r in rows] == list(range(1, 4002))


def test_rollback_and_access(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")], M)
    out = spark.createDataFrame([(1, 1, True), (1, 3, False)], "conv_id long, turn long, ok boolean")
    assert sorted(r["turn"] for r in K.rollback_failed(m, out).collect()) == [0, 1]
    conv = spark.createDataFrame([(1, "u")], "conv_id long, user_id string")
    a = spark.createDataFrame([(1, "u"), (1, "v"), (1, None), (2, "u")], "conv_id long, user_id string")
    assert sorted(r["status"] for r in K.access_check(a, conv).collect()) == [200, 200, 403, 404]


def test_validation(spark):
    rows = [("<b></b>", "u_1", "c-1", 10, 5, 0), (" ", "u", "", 10, 5, 0), ("x" * 10001, "u", None, 10, 5, 0), ("m", "a b", "c", 10, 5, 0),
            ("m", "u", "c!", 10, 5, 0), ("m", "u", "c", 201, 5, 0), ("m", "u", "c", 10, 0, 0), ("m", "u", "c", 10, 5, 51), ("m", "u" * 101, "c", 10, 5, 0)]
    df = spark.createDataFrame(rows, "user_message string, user_id string, conversation_id string, top_k int, top_n int, additional_chunks_per_doc int")
    got = [(r["clean_message"], r["reason"]) for r in K.validate_requests(df).collect()]
    assert got[0] == ("", None) and all(g[0] is None for g in got[1:])
    assert [g[1] for g in got[1:]] == ["message empty", "message too long", "user_id characters", "conversation_id characters",
                                       "top_k range", "top_n range", "additional_chunks_per_doc range", "user_id too long"]


def test_idempotent_changes(spark):
    papers = spark.createDataFrame([("1", "pending", 50), ("2", "fetched", 10)], "pmc_id string, fetch_status string, priority int")
    new = spark.createDataFrame([("2",), ("3",), ("3",)], "pmc_id string")
    once = curation.collect_ids(papers, new)
    assert once.exceptAll(curation.collect_ids(once, new)).count() == 0 and once.count() == 3
    docs = spark.createDataFrame([(7, "pmc", "2", "old", 10, "embedded")], "document_id long, source string, source_id string, title string, priority int, ingestion_status string")
    incoming = spark.createDataFrame([("pmc", "2", "new"), ("pmc", "9", "x")], "source string, source_id string, title string")
    first = keyed.upsert_documents(docs, incoming)
    rows = sorted(tuple(r) for r in first.select("document_id", "source_id", "title", "priority", "ingestion_status").collect())
    assert rows == [(7, "2", "new", 10, "fetched"), (8, "9", "x", 50, "fetched")]
    again = keyed.upsert_documents(first, incoming)
    assert sorted(tuple(r) for r in again.select("document_id", "source_id", "title", "priority", "ingestion_status").collect()) == rows
    with pytest.raises(ValueError):
        curation.set_fetch_status(papers, papers, "fetched", "pending")


def test_packing_leaves_no_document_out(spark):
    sizes = spark.createDataFrame([(i, [3, 9, 50, 0][i % 4], 10) for i in range(40)], "document_id long, chunk_count long, token_count long")
    packed = curation.pack_batches(sizes, 20, 1000)
    assert sorted(r["document_id"] for r in packed.collect()) == [i for i in range(40) if i % 4 != 3]
    for r in curation.batch_totals(packed).collect():
        assert r["chunk_count"] <= 20 or r["doc_count"] == 1


def test_questions_across_gaps(spark):
    """The question of an answer is the last user message since the answer before, however far back."""
    rows = [(1, 0, "user"), (1, 1, "system"), (1, 2, "assistant"), (1, 3, "assistant"), (1, 4, "user"), (1, 5, "user"),
            (1, 9000, "system"), (1, 9001, "assistant"), (2, 0, "assistant"), (2, 7, "user")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string")
    for block in (1, 4, 4096):
        got = {(r["conv_id"], r["turn"]): r["asked"] for r in K.question_turns(m, block).collect()}
        assert got == {(1, 2): 0, (1, 3): None, (1, 9001): 5, (2, 0): None}
    failed = spark.createDataFrame([(1, 9001, False), (1, 2, True)], "conv_id long, turn long, ok boolean")
    left = {(r["conv_id"], r["turn"]) for r in K.rollback_failed(m, failed).collect()}
    assert left == {(c, t) for c, t, _ in rows} - {(1, 9001), (1, 5)}


def test_required_fields(spark):
    ok = ("hi", "u1", None, 0, 10, 5)
    rows = [ok, (None, *ok[1:]), ("hi", None, *ok[2:]), (*ok[:3], None, 10, 5), (*ok[:4], None, 5), (*ok[:5], None), (*ok[:4], 201, 5)]
    df = spark.createDataFrame(rows, "user_message string, user_id string, conversation_id string, additional_chunks_per_doc int, top_k int, top_n int")
    out = K.validate_requests(df).collect()
    assert [r["reason"] for r in out] == [None, "message empty", "user_id missing", "additional_chunks_per_doc range", "top_k range",
                                          "top_n range", "top_k range"]
    assert [r["clean_message"] for r in out] == ["hi"] + [None] * 6


def test_gaps_across_missing_tokens(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, 0, "start", 0), (1, 0, 1, "token", 1), (1, 0, 4, "token", 201), (1, 0, 5, "complete", 202)]
    e = spark.createDataFrame(rows, "conv_id long, turn long, seq int, type string, at int").withColumn("ts", F.timestamp_seconds("at"))
    assert [r["gap_ms"] for r in K.token_gaps(e).orderBy("seq").collect()] == [None, 200_000]
    assert [r["failure"] for r in K.stream_failures(e).collect()] == ["stall"]


def test_one_row_per_key_is_repeatable(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 0), (2, None, 0)], "k long, v string, at int")
    last = lambda o: {r["k"]: r["v"] for r in keyed.one_per_key(df, ["k"], o).collect()}
    assert last(df["at"]) == {1: "a", 2: None} and last(None) == {1: "c", 2: None}


def test_batches_keep_their_limits(spark):
    rows = [(i, 1 + i % 5, 10 * (i % 7)) for i in range(1, 400)] + [(400, 900, 5)]
    df = spark.createDataFrame(rows, "document_id long, chunk_count long, token_count long")
    got = curation.pack_batches(df, 50, 500).collect()
    assert sorted(r["document_id"] for r in got) == list(range(1, 401))
    for r in curation.batch_totals(curation.pack_batches(df, 50, 500)).collect():
        assert r["doc_count"] == 1 or (r["chunk_count"] <= 50 and r["token_count"] <= 500)
    again = curation.pack_batches(df.repartition(5).where("document_id <= 200"), 50, 500).collect()
    whole = {r["document_id"]: r["batch"] for r in got}
    cut = max(whole[r["document_id"]] for r in again)
    assert all(whole[r["document_id"]] == r["batch"] for r in again if r["batch"] < cut)
