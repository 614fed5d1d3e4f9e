"""Batch view of conversation state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions.text import IDENTIFIER, strip, strip_html


def create_conversations(requests: DataFrame) -> DataFrame:
    """First creation of each id wins; later ones are counted as rejected. ``requests``: conv_id, user_id, ts."""
    return requests.groupBy("conv_id").agg(
        F.min_by("user_id", "ts").alias("user_id"), F.min("ts").alias("created_at"),
        (F.count(F.lit(1)) - 1).alias("rejected"))


def last_accessed(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.max("ts").alias("last_accessed"))


def access_check(accesses: DataFrame, conversations: DataFrame) -> DataFrame:
    """200 for the owner or an anonymous look-up, 403 for someone else's, 404 for an unknown conversation."""
    owner = conversations.select("conv_id", F.col("user_id").alias("owner"))
    joined = accesses.join(owner, "conv_id", "left")
    return joined.withColumn("status", F.when(F.col("owner").isNull(), 404)
                             .when(F.col("user_id").isNotNull() & (F.col("user_id") != F.col("owner")), 403)
                             .otherwise(200)).drop("owner")


def question_turns(messages: DataFrame, block: int = 4096) -> DataFrame:
    """(conv_id, turn, asked): for each answer, the turn of the last user message since the answer before it.

    Turns are cut into blocks; what a block hands on is its newest user and assistant turn. So a conversation of any
    length meets a task only in blocks, plus one row per block.
    """
    newest = lambda role: F.max(F.when(F.col("role") == role, F.col("turn")))
    rows = messages.select("conv_id", "turn", "role").withColumn("__block", F.expr(f"turn div {int(block)}"))
    carry = rows.groupBy("conv_id", "__block").agg(newest("user").alias("u"), newest("assistant").alias("a"))
    earlier = W.partitionBy("conv_id").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carry = carry.select("conv_id", "__block", F.max("u").over(earlier).alias("__u"), F.max("a").over(earlier).alias("__a"))
    before = W.partitionBy("conv_id", "__block").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    seen = rows.join(carry, ["conv_id", "__block"])
    last = {r: F.coalesce(newest(r).over(before), F.col(c)) for r, c in (("user", "__u"), ("assistant", "__a"))}
    seen = seen.withColumns({"asked": last["user"], "__answered": last["assistant"]}).where("role = 'assistant'")
    return seen.select("conv_id", "turn", F.when(F.col("asked") > F.coalesce("__answered", F.lit(-1)), F.col("asked")).alias("asked"))


def rollback_failed(messages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Without the user messages whose answer failed, and without those answers.

    ``outcomes``: (conv_id, turn, ok) of answer turns. The question is the last user message before the answer,
    whatever stands between them.
    """
    failed = outcomes.where(~F.col("ok")).select("conv_id", "turn")
    asked = question_turns(messages).join(failed, ["conv_id", "turn"]).where("asked is not null")
    gone = failed.unionByName(asked.select("conv_id", F.col("asked").alias("turn")))
    return messages.join(gone, ["conv_id", "turn"], "left_anti")


def summaries(messages: DataFrame) -> DataFrame:
    """First user message (100 characters), message count and last update, newest first."""
    is_user = F.col("role") == "user"
    head = F.when(is_user, F.substring("content", 1, 100))
    return messages.groupBy("user_id", "conv_id").agg(
        F.coalesce(F.min_by(head, F.when(is_user, F.col("turn"))), F.lit("")).alias("first_message"),
        F.count(F.lit(1)).alias("message_count"), F.max("ts").alias("last_updated")) \
        .orderBy(F.desc("last_updated"), "conv_id")


def idle_conversations(messages: DataFrame, now: Column, max_age_seconds: int = 3600,
                       keep_below: int = 0) -> DataFrame:
    """Conversations to evict: idle longer than the age, and only when more than ``keep_below`` exist.

    By default no number keeps them, as in the stream form.
    """
    last = last_accessed(messages)
    idle = last.where(F.unix_micros(now) - F.unix_micros("last_accessed") > max_age_seconds * 1_000_000)
    if not keep_below:
        return idle
    return idle.where(last.agg(F.count(F.lit(1)).alias("n")).scalar() > keep_below)


def chat_turns(messages: DataFrame, display: DataFrame, numbered: DataFrame, turn_chunks: DataFrame) -> DataFrame:
    """Result record per answer: question, shown and raw text, citations of the answer, retrieved chunk ids."""
    keys = ["conv_id", "turn"]
    answers = messages.where("role = 'assistant'").select(*keys, F.col("content").alias("raw_response"))
    texts = messages.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"), F.col("content").alias("user_message"))
    asked = question_turns(messages).join(texts, ["conv_id", "asked"]).drop("asked")
    cites = numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "number", "source_id"))).alias("c"))
    got = turn_chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("g"))
    return answers.join(asked, keys, "left").join(
        display.where("role = 'assistant'").select(*keys, F.col("display").alias("generated_response")), keys).join(
        cites, keys, "left").join(got, keys, "left").select(
        *keys, "user_message", "generated_response", "raw_response",
        F.coalesce(F.col("c.number"), F.array().cast("array<bigint>")).alias("citation_numbers"),
        F.coalesce(F.col("g.chunk_id"), F.array().cast("array<bigint>")).alias("retrieved_chunk_ids"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds the cleaned message (of valid requests) and the first broken rule (NULL when valid).

    The blank test precedes tag removal, so a message of tags only passes and becomes empty. Everything but the
    conversation id is required: NULL breaks its rule.
    """
    within = lambda c, low, high: F.coalesce(F.col(c).between(low, high), F.lit(False))
    reason = F.when(F.length("user_message") > 10000, "message too long") \
        .when(strip(F.coalesce("user_message", F.lit(""))) == "", "message empty") \
        .when(F.col("user_id").isNull(), "user_id missing") \
        .when(F.length("user_id") > 100, "user_id too long") \
        .when((F.col("user_id") != "") & ~F.col("user_id").rlike(IDENTIFIER), "user_id characters") \
        .when((F.col("conversation_id") != "") & ~F.col("conversation_id").rlike(IDENTIFIER),
              "conversation_id characters") \
        .when(~within("additional_chunks_per_doc", 0, 50), "additional_chunks_per_doc range") \
        .when(~within("top_k", 1, 200), "top_k range") \
        .when(~within("top_n", 1, 20), "top_n range")
    clean = F.when(F.col("reason").isNull(), strip(strip_html(F.col("user_message"))))
    return requests.withColumn("reason", reason).withColumn("clean_message", clean)


def stream_metrics(events: DataFrame) -> DataFrame:
    """Timing of each completed answer stream.

    Gaps between tokens add up to last minus first token, so one aggregate with map-side combine does; the
    first token is not counted, and a stream needs at least one gap.
    """
    ms = F.unix_millis("ts")
    of = lambda t: F.when(F.col("type") == t, ms)
    agg = events.groupBy("conv_id", "turn").agg(
        F.min(of("start")).alias("t0"), F.min(of("token")).alias("t1"), F.max(of("token")).alias("t2"),
        F.count(of("token")).alias("n"), F.max(of("complete")).alias("t3"))
    total = F.col("t3") - F.col("t1")
    return agg.where("t3 is not null and n > 1").select(
        "conv_id", "turn", (F.col("t1") - F.col("t0")).alias("time_to_first_token"), (F.col("n") - 1).alias("total_tokens"),
        ((F.col("t2") - F.col("t1")) / (F.col("n") - 1)).alias("avg_time_per_token"), total.alias("total_stream_time"),
        F.try_divide((F.col("n") - 1).cast("double"), total / 1000).alias("tokens_per_second"))


def token_gaps(events: DataFrame) -> DataFrame:
    """Time since the previous token of the stream, also where sequence numbers are missing (one answer per window)."""
    ms = F.unix_millis("ts")
    before = F.lag(ms).over(W.partitionBy("conv_id", "turn").orderBy("seq"))
    return events.where("type = 'token'").select("conv_id", "turn", "seq", (ms - before).alias("gap_ms"))


def stream_failures(events: DataFrame, stall_ms: int = 120_000, timeout_ms: int = 300_000) -> DataFrame:
    """Streams that failed, by what happened first: a silence above the stall limit, a total above the time
    limit, or an error event."""
    at = F.unix_millis("ts")
    before = F.lag(at).over(W.partitionBy("conv_id", "turn").orderBy("seq"))  # one answer per window
    rows = events.select("conv_id", "turn", "type", at.alias("ms"), before.alias("prev"))
    silent = F.when(F.col("ms") - F.col("prev") > stall_ms, F.col("prev") + stall_ms)
    per = rows.groupBy("conv_id", "turn").agg(
        F.min("ms").alias("t0"), F.max("ms").alias("t1"), F.min(silent).alias("stall_at"),
        F.min(F.when(F.col("type") == "error", F.col("ms"))).alias("error_at"))
    never = F.lit(2 ** 62)
    stall, error = F.coalesce("stall_at", never), F.coalesce("error_at", never)
    late = F.when(F.col("t1") - F.col("t0") > timeout_ms, F.col("t0") + timeout_ms).otherwise(never)
    first = F.least(stall, late, error)
    return per.withColumn("failure", F.when(first == never, None).when(stall == first, "stall")
                          .when(late == first, "timeout").otherwise("error")) \
        .where("failure is not null").select("conv_id", "turn", "failure")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "1 hour") -> DataFrame:
    """Activity periods separated by idle times of at least ``gap``."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")
