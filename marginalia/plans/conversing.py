"""Conversations, citations and token streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import schemas as S
from marginalia.operators import citations as C, conversations as K
from marginalia.plans import fixtures as V
from marginalia.plans.registry import query
from marginalia.session import scratch_path
from marginalia.streaming import activity, tokens as T


def _cited(spark, sf):
    return C.valid_citations(V.messages(spark, sf), V.turn_chunks(spark, sf))


def _citations(spark, sf):
    return C.conversation_citations(_cited(spark, sf))


@query("c10_last_chunk_per_source", """select conv_id, turn, source_id, arg_max(chunk_id, rank) as chunk_id from turn_chunks group by all""")
def _(spark, sf):
    return C.last_chunk_per_source(V.turn_chunks(spark, sf)).select("conv_id", "turn", "source_id", "chunk_id")


@query("k6_valid_citations", "select conv_id, turn, pos::bigint as pos, cast(src as varchar) as source_id, "
       "src * 5 + case when pos = 0 then 1 else 0 end as chunk_id from turn_cites")
def _(spark, sf):
    return _cited(spark, sf).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "source_id", "chunk_id")


@query("e4_k5_citation_numbers", "select conv_id, number, source_id, chunk_id, title from citations")
def _(spark, sf):
    return _citations(spark, sf).select("conv_id", "number", "source_id", "chunk_id", "title")


@query("f5_turn_citations", """select t.conv_id, t.turn, t.pos::bigint as pos, c.number, c.chunk_id from turn_cites t
join citations c on c.conv_id = t.conv_id and c.source_id = cast(t.src as varchar)""")
def _(spark, sf):
    cited = _cited(spark, sf)
    return C.turn_citations(cited, C.conversation_citations(cited)).select(
        "conv_id", "turn", F.col("pos").cast("long").alias("pos"), "number", "chunk_id")


@query("k3_stored_messages", """select m.conv_id, m.turn, m.role, case when m.role = 'assistant' then coalesce(s.ids, '') end as sources,
  case when m.role = 'assistant' then coalesce(s.cids, '') end as chunk_ids
from messages m left join (select t.conv_id, t.turn, string_agg(t.src, ',' order by t.pos) as ids,
  string_agg(c.chunk_id, ',' order by t.pos) as cids from turn_cites t join citations c on c.conv_id = t.conv_id
  and c.source_id = cast(t.src as varchar) group by all) s using (conv_id, turn)""")
def _(spark, sf):
    cited = _cited(spark, sf)
    out = C.store_citations(V.messages(spark, sf), cited, C.conversation_citations(cited))
    return out.select("conv_id", "turn", "role", F.array_join("cited_source_ids", ",").alias("sources"),
                      F.array_join(F.col("cited_chunk_ids").cast("array<string>"), ",").alias("chunk_ids"))


# An answer's display: heading and references go, a and b become their numbers, c stays, [3] stays where 3 is a number.
_DISPLAY = """shown as (select m.conv_id, m.turn, m.role, case when m.role <> 'assistant' then m.content else
    rtrim(ltrim(text, E': \\t\\n') || ' [' || na.number || ', ' || nb.number || '] ['
      || coalesce(nc.number::varchar, 'PMC' || ((a + 50) % 100)) || ']' || case when n >= 3 then ' [3]' else ' ' end, E' \\n') end as display
  from messages m
  left join citations na on na.conv_id = m.conv_id and na.source_id = cast(a as varchar)
  left join citations nb on nb.conv_id = m.conv_id and nb.source_id = cast((a + m.turn % 3) % 100 as varchar)
  left join citations nc on nc.conv_id = m.conv_id and nc.source_id = cast((a + 50) % 100 as varchar)
  left join (select conv_id, count(*) as n from citations group by all) k on k.conv_id = m.conv_id)"""


@query("k7_display_messages", f"with {_DISPLAY} select conv_id, turn, role, rtrim(display) as display from shown")
def _(spark, sf):
    d = C.display_messages(V.messages(spark, sf), _citations(spark, sf))
    return d.withColumn("display", F.rtrim("display"))


@query("k10_chat_turns", f"""with {_DISPLAY}, before as (select m.conv_id, m.turn,
    (select max(turn) from messages u where u.conv_id = m.conv_id and u.role = 'user' and u.turn < m.turn) as u,
    (select max(turn) from messages b where b.conv_id = m.conv_id and b.role = 'assistant' and b.turn < m.turn) as b
    from messages m where m.role = 'assistant'),
  asked as (select conv_id, turn, case when u > coalesce(b, -1) then u end as asked from before)
select m.conv_id, m.turn, q.content as user_message, rtrim(s.display) as generated_response,
  m.content as raw_response, (select string_agg(c.number, ',' order by t.pos) from turn_cites t join citations c
    on c.conv_id = t.conv_id and c.source_id = cast(t.src as varchar) where t.conv_id = m.conv_id and t.turn = m.turn) as numbers,
  (select string_agg(chunk_id, ',' order by rank) from turn_chunks r where r.conv_id = m.conv_id and r.turn = m.turn) as retrieved
from messages m join shown s using (conv_id, turn) left join asked k on k.conv_id = m.conv_id and k.turn = m.turn
  left join messages q on q.conv_id = m.conv_id and q.turn = k.asked where m.role = 'assistant'""")
def _(spark, sf):
    m, r = V.messages(spark, sf), V.turn_chunks(spark, sf)
    cited = C.valid_citations(m, r)
    cites = C.conversation_citations(cited)
    out = K.chat_turns(m, C.display_messages(m, cites), C.turn_citations(cited, cites), r)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("conv_id", "turn", "user_message", F.rtrim("generated_response").alias("generated_response"),
                      "raw_response", join("citation_numbers").alias("numbers"), join("retrieved_chunk_ids").alias("retrieved"))


@query("k1_create_conversations", """select conv_id, arg_min(user_id, ts) as user_id, count(*) - 1 as rejected
from messages group by all""")
def _(spark, sf):
    return K.create_conversations(V.messages(spark, sf)).select("conv_id", "user_id", "rejected")


@query("k2_access_check", """select c_custkey, case when conv_id is null then 404 when who <> owner then 403 else 200 end::bigint as status
from (select c_custkey, 'anon_' || (c_custkey % 5) as who from customer) a
left join (select conv_id, any_value(user_id) as owner from messages group by all) m on m.conv_id = c_custkey""")
def _(spark, sf):
    a = V.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_custkey").alias("conv_id"), F.concat(F.lit("anon_"), F.col("c_custkey") % 5).alias("user_id"))
    return K.access_check(a, K.create_conversations(V.messages(spark, sf))).select(
        "c_custkey", F.col("status").cast("long").alias("status"))


def _outcomes(spark, sf):
    return V.messages(spark, sf).where("role = 'assistant'").select(
        "conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 9 != 0).alias("ok"))


@query("k4_rollback_failed", """with spaced as (select conv_id, turn * 2 as turn, role from messages
    union all select conv_id, turn * 2 + 1, 'system' from messages where role = 'user' and conv_id % 3 <> 0),
  failed as (select a.conv_id, a.turn, (select max(u.turn) from spaced u where u.conv_id = a.conv_id and u.role = 'user' and u.turn < a.turn) as u,
    (select max(b.turn) from spaced b where b.conv_id = a.conv_id and b.role = 'assistant' and b.turn < a.turn) as b
    from spaced a where a.role = 'assistant' and (a.conv_id + a.turn // 2) % 9 = 0)
select conv_id, turn from spaced m where not exists (select 1 from failed f where f.conv_id = m.conv_id
  and (f.turn = m.turn or (f.u = m.turn and f.u > coalesce(f.b, -1))))""")
def _(spark, sf):
    """Turns are spread out, with a system message after most questions."""
    m = V.messages(spark, sf).select("conv_id", (F.col("turn") * 2).alias("turn"), "role")
    notes = m.where("role = 'user' and conv_id % 3 <> 0").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("system").alias("role"))
    outcomes = _outcomes(spark, sf).withColumn("turn", F.col("turn") * 2)
    return K.rollback_failed(m.unionByName(notes), outcomes).select("conv_id", "turn")


@query("k8_f6_summaries", """select user_id, conv_id, coalesce(arg_min(substr(content, 1, 100), turn) filter (where role = 'user'), '')
  as first_message, count(*) as message_count, max(ts) as last_updated from messages group by all""")
def _(spark, sf):
    return K.summaries(V.messages(spark, sf)).withColumn("last_updated", F.unix_seconds("last_updated"))


@query("k9_idle_conversations", """select conv_id, max(ts) as last_accessed from messages group by conv_id
having 1704067200 + 180000 - max(ts) > 3600""")
def _(spark, sf):
    now = F.timestamp_seconds(F.lit(1704067200 + 180000))
    return K.idle_conversations(V.messages(spark, sf), now, 3600).withColumn(
        "last_accessed", F.unix_seconds("last_accessed"))


@query("b10_validate_requests", r"""select request_id, case when reason is null
  then trim(regexp_replace(user_message, '<[^>]+>', '', 'g'), E' \n') end as clean_message, reason from (select *,
  case when length(user_message) > 10000 then 'message too long' when trim(user_message, E' \n') = '' then 'message empty'
    when user_id is null then 'user_id missing' when not regexp_matches(user_id, '^[a-zA-Z0-9_-]+$') then 'user_id characters'
    when not regexp_matches(conversation_id, '^[a-zA-Z0-9_-]+$') then 'conversation_id characters'
    when additional_chunks_per_doc not between 0 and 50 then 'additional_chunks_per_doc range'
    when top_k is null or top_k not between 1 and 200 then 'top_k range'
    when top_n is null or top_n not between 1 and 20 then 'top_n range' end as reason from requests)""")
def _(spark, sf):
    return K.validate_requests(V.requests(spark, sf)).select("request_id", "clean_message", "reason")


# ---- token streams ----

_METRICS_SQL = """select conv_id, turn, case when len(toks) = 1 then 500 + stall else 500 end as time_to_first_token, len(toks) - 1 as total_tokens,
  round((gap * (len(toks) - 1) + stall) / (len(toks) - 1)::double, 6) as avg_time_per_token, gap * len(toks) + stall as total_stream_time,
  round((len(toks) - 1) / ((gap * len(toks) + stall) / 1000.0::double), 6) as tokens_per_second
from answer_tokens where outcome = 'complete' and len(toks) > 1"""


@query("l2_stream_metrics", _METRICS_SQL)
def _(spark, sf):
    m = K.stream_metrics(V.token_events(spark, sf))
    return m.withColumns({c: F.round(c, 6) for c in ("avg_time_per_token", "tokens_per_second")})


def _holed(events):
    """Token events some of which never arrived."""
    return events.where(~((F.col("type") == "token") & (F.col("seq") % 5 == 4) & ((F.col("conv_id") + F.col("turn")) % 2 == 1)))


_HOLED = "(select * from token_events where not (type = 'token' and seq % 5 = 4 and (conv_id + turn) % 2 = 1))"


@query("e8_token_gaps", f"""select conv_id, turn, seq::bigint as seq, ms - lag(ms) over (partition by conv_id, turn order by seq) as gap_ms
from {_HOLED} where type = 'token'""")
def _(spark, sf):
    return K.token_gaps(_holed(V.token_events(spark, sf))).withColumn("seq", F.col("seq").cast("long"))


_FAILURES_SQL = """select conv_id, turn, case when stall_at <= least(late, err) then 'stall' when late <= err then 'timeout' else 'error' end as failure
from (select conv_id, turn, coalesce(min(case when ms - prev > 120000 then prev + 120000 end), 1e18) as stall_at,
    case when max(ms) - min(ms) > 300000 then min(ms) + 300000 else 1e18 end as late,
    coalesce(min(case when type = 'error' then ms end), 1e18) as err
  from (select *, lag(ms) over (partition by conv_id, turn order by seq) as prev from token_events) group by all)
where least(stall_at, late, err) < 1e18"""


@query("l3_l4_stream_failures", _FAILURES_SQL.replace("token_events", _HOLED))
def _(spark, sf):
    return K.stream_failures(_holed(V.token_events(spark, sf)))


_FILTERED_SQL = """select conv_id, turn, content, kind from (
  select conv_id, turn, rtrim(ltrim(text, E': \\n') || ' [PMC' || a || ', PMC' || ((a + turn % 3) % 100) || '] [PMC' || ((a + 50) % 100) || '] [3]') as content,
    'shown' as kind from messages where role = 'assistant'
  union all select conv_id, turn, case when outcome = 'complete' then regexp_replace(content, '\\s*\\[PMC\\d+\\] x$', '') end, outcome
  from answer_tokens where outcome = 'complete')"""


def _shown(parts):
    """The shown text of each answer, and the response kept for the completed ones; the parts are made once for both."""
    shown = F.col("type") == "token"
    rows = parts.where(F.col("type").isin("token", "end_of_response")).withColumns({
        "kind": F.when(shown, "shown").otherwise("complete"), "end": F.when(~shown, F.col("part"))})
    return rows.groupBy("conv_id", "turn", "kind", "end").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda p: p["content"]), "")
        .alias("content")).select("conv_id", "turn", "content", "kind")


@query("l1_answer_filter", _FILTERED_SQL)
def _(spark, sf):
    return _shown(T.filter_answers(V.token_events(spark, sf)))


def _event_stream(spark, sf):
    landing = scratch_path(spark, "token-events")
    V.token_events(spark, sf).write.parquet(landing)
    return spark.readStream.schema(S.TOKEN_EVENT).parquet(landing)


def _drain(spark, stream, name):
    """Runs a stream over all landed files and reads back what it wrote."""
    out = scratch_path(spark, name)
    run = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True) \
        .option("checkpointLocation", scratch_path(spark, f"{name}-state")).start(out)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("l1_answer_filter_stream", _FILTERED_SQL)
def _(spark, sf):
    return _shown(_drain(spark, T.filter_answer_stream(_event_stream(spark, sf)), "answers"))


@query("l2_l4_monitor_stream", f"""with failures as ({_FAILURES_SQL}), done as ({_METRICS_SQL})
select conv_id, turn, failure as outcome, null::bigint as total_tokens, null::bigint as total_stream_time from failures
union all select conv_id, turn, 'complete', total_tokens, total_stream_time from done
where (conv_id, turn) not in (select (conv_id, turn) from failures)""")
def _(spark, sf):
    out = _drain(spark, T.monitor_streams(_event_stream(spark, sf)), "monitor")
    return out.select("conv_id", "turn", "outcome", "total_tokens", "total_stream_time")


_SESSIONS_SQL = """select user_id, min(us) as start_us, max(us) + 3600000000 as end_us, count(*) as n from (
  select *, sum(case when us - prev <= 3600000000 then 0 else 1 end) over (partition by user_id order by us, event_id) as grp from (
    select user_id, event_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as prev from events))
group by user_id, grp"""


@query("l5_activity_sessions", _SESSIONS_SQL)
def _(spark, sf):
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return K.sessions(e)


@query("l5_activity_sessions_stream", f"with s as ({_SESSIONS_SQL}) select * from s where end_us <= "
       "(select max(epoch_us(ts)) - 600000000 from events)")
def _(spark, sf):
    """Sessions closed by the watermark; those of the last minutes are still open when the stream pauses."""
    raw = V.table(spark, sf, "events")
    e = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(sf) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    return _drain(spark, activity.activity_sessions(e), "sessions")


@query("l5_idle_expiry_stream", """select conv_id, max(ts) * 1000 as last_accessed_ms from messages group by conv_id
having max(ts) + 3630 < (select max(ts) from messages) - 60""")
def _(spark, sf):
    landing = scratch_path(spark, "messages")
    V.messages(spark, sf).select("conv_id", "ts").write.parquet(landing)
    stream = spark.readStream.schema("conv_id bigint, ts timestamp").parquet(landing)
    return _drain(spark, activity.expire_idle(stream, 3630), "expired")
