"""Streams cut into micro-batches against their batch forms."""

import pytest
from pyspark.sql import functions as F

from marginalia import schemas as S
from marginalia.operators import conversations as K
from marginalia.plans import fixtures as V
from marginalia.session import scratch_path
from marginalia.streaming import activity, ingest, tokens as T

ANSWERS = {
    "split heading": (["Hm\n", "#", "# Ans", "wer", ":", "\n", "one ", "two ", "three"], "one two three"),
    "references over tokens": (["## Answer\n", "body ", "text", "\n", "##", " Refer", "ences", "\n[PMC1]", " x"], "body text"),
    "no heading": (["w "] * 120, "w " * 120),
    "ends before the trigger": (["too ", "short"], ""),
    "bold references": (["## Answer: abc", "\n**References", "** [PMC1]"], "abc"),
}


@pytest.mark.parametrize("case", ANSWERS)
def test_answer_filter(case):
    tokens, want = ANSWERS[case]
    f, out = T.AnswerFilter(), []
    for t in tokens:
        out += f.feed(t)
        f = T.AnswerFilter(f.save())
    rest, full = f.finish()
    assert "".join(out + rest) == want
    assert "".join(tokens).strip().startswith(full)


def drain(spark, stream):
    out = scratch_path(spark, "out")
    q = stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "ck")) \
        .trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def land(spark, parts, schema):
    path = scratch_path(spark, "in")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def events(spark, sf):
    path = scratch_path(spark, "events")
    V.token_events(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def test_filter_stream_equals_batch(spark, events):
    stream = land(spark, [events.where("seq < 40"), events.where("seq >= 40")], S.TOKEN_EVENT)
    a, b = drain(spark, T.filter_answer_stream(stream)), T.filter_answers(events)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_filter_stream_in_any_order(spark, events):
    """Tokens dealt over micro-batches at random give the text of the batch form; a lost one closes its answer late."""
    some = events.where("conv_id <= 6").cache()
    parts = [some.where(F.pmod(F.xxhash64("conv_id", "turn", "seq"), F.lit(4)) == k) for k in (2, 0, 3, 1)]
    got = drain(spark, T.filter_answer_stream(land(spark, parts, S.TOKEN_EVENT), "30 days"))
    want = T.filter_answers(some)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_monitor_over_time_ordered_batches(spark, events):
    """One conversation at a time, cut by event time, so that time-outs fire from timers too."""
    one = events.where("conv_id <= 12")
    middle = one.agg(F.expr("timestamp_micros(cast(percentile(unix_micros(ts), 0.5) as bigint))")).collect()[0][0]
    stream = land(spark, [one.where(F.col("ts") <= F.lit(middle)), one.where(F.col("ts") > F.lit(middle))], S.TOKEN_EVENT)
    got = {(r["conv_id"], r["turn"]): r for r in drain(spark, T.monitor_streams(stream)).collect()}
    failed = {(r["conv_id"], r["turn"]): r["failure"] for r in K.stream_failures(one).collect()}
    timed = {(r["conv_id"], r["turn"]): r for r in K.stream_metrics(one).collect()}
    assert {k: r["outcome"] for k, r in got.items() if r["outcome"] != "complete"} == failed
    done = {k for k, r in got.items() if r["outcome"] == "complete"}
    assert done == set(timed) - set(failed)
    for k in done:
        for c in ("time_to_first_token", "total_tokens", "total_stream_time"):
            assert got[k][c] == timed[k][c]


def test_silent_stream_is_reported_by_the_timer(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [(1, 1, 0, "start", None, at(0)), (1, 1, 1, "token", "a", at(1)), (2, 1, 0, "start", None, "2024-01-01 01:00:00"),
            (2, 1, 1, "token", "a", "2024-01-01 01:00:01"), (2, 1, 2, "token", "b", "2024-01-01 01:00:03"),
            (2, 1, 3, "complete", None, "2024-01-01 01:00:03")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, seq int, type string, content string, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    stream = land(spark, [df.where("conv_id = 1"), df.where("conv_id = 2")], S.TOKEN_EVENT)
    got = {r["conv_id"]: r for r in drain(spark, T.monitor_streams(stream)).collect()}
    assert got[1]["outcome"] == "stall"
    assert (got[2]["outcome"], got[2]["total_tokens"], got[2]["avg_time_per_token"], got[2]["tokens_per_second"]) == ("complete", 1, 2000.0, 0.5)


def _timed(spark, rows):
    df = spark.createDataFrame([(c, 1, seq, kind, "x", ms) for c, seq, kind, ms in rows],
                               "conv_id long, turn long, seq int, type string, content string, ms long")
    return df.withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def test_monitor_gives_one_row_whatever_the_order(spark):
    """The end in the first micro-batch, a token before it in the second, and both once more in the third."""
    day = 86_400_000
    first = [(1, 0, "start", day), (1, 1, "token", day + 100), (1, 3, "token", day + 300), (1, 4, "complete", day + 400),
             (2, 1, "token", day + 50), (2, 0, "start", day)]
    second = [(1, 2, "token", day + 200), (2, 3, "error", day + 90)]
    third = [(1, 2, "token", day + 200), (1, 4, "complete", day + 400), (2, 2, "token", day + 70)]
    later = [(9, 0, "start", 3 * day)]
    stream = land(spark, [_timed(spark, rows) for rows in (first, second, third, later)], S.TOKEN_EVENT)
    got = [r for r in drain(spark, T.monitor_streams(stream, "10 minutes")).collect() if r["conv_id"] != 9]
    assert sorted((r["conv_id"], r["outcome"], r["time_to_first_token"], r["total_tokens"], r["total_stream_time"]) for r in got) == \
        [(1, "complete", 100, 2, 300), (2, "error", None, None, None)]


def test_monitor_passes_over_what_never_comes(spark):
    day = 86_400_000
    lost = [(1, 0, "start", day), (1, 1, "token", day + 100), (1, 3, "token", day + 300), (1, 4, "complete", day + 400),
            (2, 1, "token", day), (2, 2, "token", day + 10)]
    stream = land(spark, [_timed(spark, rows) for rows in (lost, [(9, 0, "start", 2 * day)], [(9, 1, "token", 2 * day + 1)])], S.TOKEN_EVENT)
    got = [r for r in drain(spark, T.monitor_streams(stream)).collect() if r["conv_id"] != 9]
    assert sorted((r["conv_id"], r["outcome"], r["total_tokens"]) for r in got) == [(1, "complete", 1), (2, "stall", None)]


def test_idle_conversations_expire(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (2, "2024-01-01 03:00:00"), (3, "2024-01-01 06:00:00")]
    df = spark.createDataFrame(rows, "conv_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [df.where("conv_id = 1"), df.where("conv_id = 2"), df.where("conv_id = 3")]
    got = {r["conv_id"]: r["last_accessed_ms"] for r in drain(spark, activity.expire_idle(land(spark, parts, df.schema))).collect()}
    assert got == {1: 1704069000000, 2: 1704078000000}


def test_ingest_keeps_the_newest_version(spark):
    landing, out, ck = scratch_path(spark, "land"), scratch_path(spark, "tables"), scratch_path(spark, "ck")
    row = lambda i, text, at: (str(i), "T", "", text, [("body", 0, len(text))], at)
    schema = "source_id string, title string, abstract string, full_text string, section_offsets array<struct<section:string,char_start:int,char_end:int>>, landed_at int"

    def put(rows):
        spark.createDataFrame(rows, schema).withColumn("landed_at", F.timestamp_seconds("landed_at")).coalesce(1) \
            .write.mode("append").parquet(landing)

    def run():
        ingest.start_ingest(spark.readStream.schema(ingest.LANDED).parquet(landing), out, ck, 4, 1).awaitTermination()

    put([row(1, "a b c d e f", 1), row(2, "x", 1), row(2, "y", 2)])
    run()
    put([row(1, "new", 3)])
    run()
    run()
    chunks = {(r["document_id"], r["content"]) for r in ingest.current_chunks(spark, out).collect()}
    assert chunks == {(1, "new"), (2, "y")}
    assert ingest.current_documents(spark, out).count() == 2
    # a repeated micro-batch replaces its own folder
    again = spark.createDataFrame([row(1, "new", 3)], schema).withColumn("landed_at", F.timestamp_seconds("landed_at"))
    ingest.write_version(again, out, ingest.stream_id(spark, ck), 1, 4, 1)
    assert {(r["document_id"], r["content"]) for r in ingest.current_chunks(spark, out).collect()} == chunks


def test_ingest_by_two_streams(spark):
    out, schema = scratch_path(spark, "tables"), ingest.LANDED.replace("landed_at timestamp", "landed_at int")

    def run(rows):
        landing = scratch_path(spark, "land")
        row = lambda i, text, at: (str(i), "T", "", text, [("body", 0, len(text))], at)
        spark.createDataFrame([row(*r) for r in rows], schema).withColumn("landed_at", F.timestamp_seconds("landed_at")).write.parquet(landing)
        ingest.start_ingest(spark.readStream.schema(ingest.LANDED).parquet(landing), out, scratch_path(spark, "ck"), 4, 1).awaitTermination()

    run([(1, "a", 5), (2, "b", 5)])
    run([(3, "c", 1), (1, "older", 4), (2, "newer", 6)])
    want = {(1, "a"), (2, "newer"), (3, "c")}
    seen = lambda where: {(r["document_id"], r["content"]) for r in ingest.current_chunks(spark, where).collect()}
    assert seen(out) == want
    small = scratch_path(spark, "compacted")
    ingest.compact(spark, out, small)
    assert seen(small) == want and ingest.current_documents(spark, small).count() == 3


def test_first_arrivals(spark):
    rows = [("1", 10), ("2", 20), ("1", 30)]
    df = spark.createDataFrame(rows, "source_id string, at int").select("source_id", F.timestamp_seconds("at").alias("landed_at"))
    stream = land(spark, [df.where("source_id = '1'"), df], df.schema)
    assert sorted(r["source_id"] for r in drain(spark, ingest.first_arrivals(stream)).collect()) == ["1", "2"]
