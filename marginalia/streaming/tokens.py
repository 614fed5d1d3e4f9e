"""Token streams: the answer filter, and the monitor of timing, stalls and time-outs.

Both run per answer, keyed by (conv_id, turn): an answer has a bounded number of tokens, so no state and
no group grows with the conversation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from marginalia.functions.text import ANSWER_HEADING, REFERENCES_HEADING

# Look-ahead in tokens, characters to wait for after the heading, tokens to wait for a heading.
LOOK_AHEAD, AFTER_HEADING, NO_HEADING = 5, 3, 100
# Limits in milliseconds.
STALL_MS, TIMEOUT_MS = 120_000, 300_000

_ANSWER = re.compile(ANSWER_HEADING, re.IGNORECASE)
_REFERENCES = re.compile(REFERENCES_HEADING, re.IGNORECASE)

FILTERED = "conv_id long, turn long, part int, type string, content string"
MONITORED = ("conv_id long, turn long, outcome string, time_to_first_token long, total_tokens long, "
             "avg_time_per_token double, total_stream_time long, tokens_per_second double")


class AnswerFilter:
    """Passes on the text between the answer heading and the references heading, token by token."""

    def __init__(self, state: str | None = None):
        saved = json.loads(state) if state else {}
        self.head: str = saved.get("head", "")
        self.full: str = saved.get("full", "")
        self.seen: int = saved.get("seen", 0)
        self.phase: str = saved.get("phase", "waiting")
        self.ahead: list[str] = saved.get("ahead", [])
        self.parts: int = saved.get("parts", 0)

    def save(self) -> str:
        return json.dumps(vars(self))

    def feed(self, token: str) -> list[str]:
        if self.phase == "done":
            return []
        self.full += token
        self.seen += 1
        if self.phase == "waiting":
            self._look_for_start(token)
            return []
        self.ahead.append(token)
        window = "".join(self.ahead)
        end = _REFERENCES.search(window)
        if end:
            self.phase, self.ahead = "done", []
            text = window[:end.start()].rstrip()
            return [text] if text else []
        ready = max(0, len(self.ahead) - LOOK_AHEAD)
        out, self.ahead = self.ahead[:ready], self.ahead[ready:]
        return out

    def _look_for_start(self, token: str) -> None:
        self.head += token
        found = _ANSWER.search(self.head)
        if found is None:
            if self.seen > NO_HEADING:
                self.phase, self.ahead, self.head = "passing", [self.head], ""
        elif len(self.head) - found.end() >= AFTER_HEADING:
            text = self.head[found.end():].lstrip(": \n")
            self.phase, self.ahead, self.head = "passing", [text] if text else [], ""

    def finish(self) -> tuple[list[str], str]:
        rest, self.ahead = self.ahead, []
        return rest, self.full.strip()


class _Feed:
    """Feeds the events of one answer in order; ``ended`` once the stream has."""

    def __init__(self, conv_id: int, turn: int, answer: AnswerFilter | None = None):
        self.key, self.answer, self.ended = (conv_id, turn), answer or AnswerFilter(), False

    def take(self, kind: str, content: str | None, rows: list[tuple]) -> None:
        """Appends the output rows of one event."""
        if self.ended:
            return
        if kind == "token":
            for text in self.answer.feed(content):
                self._emit(rows, "token", text)
        elif kind == "complete":
            rest, full = self.answer.finish()
            for text in rest:
                self._emit(rows, "token", text)
            self._emit(rows, "end_of_response", full)
            self.ended = True
        elif kind == "error":
            self._emit(rows, "error", content)
            self.ended = True

    def _emit(self, rows: list[tuple], kind: str, text: str | None) -> None:
        rows.append((*self.key, self.answer.parts, kind, text))
        self.answer.parts += 1


def _run(answer: AnswerFilter, conv_id: int, turn: int, events: pd.DataFrame) -> tuple[list[tuple], bool]:
    """Feeds events in sequence order; returns output rows and whether the stream ended."""
    rows: list[tuple] = []
    feed = _Feed(conv_id, turn, answer)
    for kind, content in events.sort_values("seq")[["type", "content"]].itertuples(index=False):
        feed.take(kind, content, rows)
    return rows, feed.ended


_FILTERED_COLUMNS = [f.split()[0] for f in FILTERED.split(", ")]
_FILTERED_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]


def filter_answers(events: DataFrame) -> DataFrame:
    """Batch form: all tokens of an answer at once.

    Answers lie one after the other in sorted partitions and are fed as the rows come by, so that a task holds a batch of
    rows and one answer, and no frame is made for each answer.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, feed = None, None
        for batch in batches:
            rows: list[tuple] = []
            for *at, kind, content in zip(*(c.to_pylist() for c in batch.columns)):
                if at != key:
                    key, feed = at, _Feed(*at)
                feed.take(kind, content, rows)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FILTERED_TYPES)], _FILTERED_COLUMNS)

    rows = events.select("conv_id", "turn", "seq", "type", "content").repartition("conv_id", "turn") \
        .sortWithinPartitions("conv_id", "turn", F.asc_nulls_last("seq"), F.desc("type"), "content")
    return rows.select("conv_id", "turn", "type", "content").mapInArrow(run, FILTERED)


class _FilterProcessor(StatefulProcessor):
    """Feeds events in order of their sequence numbers, which start at 0, whatever order they arrive in.

    An event waits until all before it are there. Once the watermark passes an answer's last event by the time limit, what
    waits is fed and the state goes. The state of a closed answer stays as long, so late events don't open it again.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", "saved string, next int, closed boolean, last long")
        self.waiting = handle.getMapState("waiting", "seq int", "type string, content string")
        self.text = handle.getListState("text", "piece string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        saved, at, closed, last = self.state.get() if self.state.exists() else (None, 0, False, 0)
        events = pd.concat(list(rows))
        last = max(last, int(events["ms"].max()))
        out: list[tuple] = []
        if not closed:
            ready: dict[int, tuple] = {}
            for seq, kind, content in events[["seq", "type", "content"]].itertuples(index=False):
                if seq >= at:
                    ready[int(seq)] = (kind, None if content is None or content != content else content)
            out, saved, at, closed = self._feed(key, saved, at, ready)
        self.state.update((saved, at, closed, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(last + TIMEOUT_MS)
        yield pd.DataFrame(out, columns=_FILTERED_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.state.exists():
            saved, at, closed, _ = self.state.get()
            if not closed:
                out, *_ = self._feed(key, saved, at, {}, gaps=True)
        self.state.clear()
        self.waiting.clear()
        self.text.clear()
        yield pd.DataFrame(out, columns=_FILTERED_COLUMNS)

    def _feed(self, key, saved, at: int, ready: dict[int, tuple], gaps: bool = False):
        """Runs what is in order from ``at`` on, or all that waits; returns rows, filter state, next number, closed."""
        answer = AnswerFilter(saved)
        lined: list[tuple] = []
        if gaps:
            lined = [(seq[0], *event) for seq, event in sorted(self.waiting.iterator())]
        else:
            while True:
                if at in ready:
                    event = ready.pop(at)
                elif self.waiting.containsKey((at,)):
                    event = self.waiting.getValue((at,))
                    self.waiting.removeKey((at,))
                else:
                    break
                lined.append((at, *event))
                at += 1
            for seq, event in ready.items():
                self.waiting.updateValue((seq,), event)
        ends = any(kind == "complete" for _, kind, _ in lined)
        if ends:
            answer.full = "".join(piece for piece, in self.text.get()) if self.text.exists() else ""
        out, closed = _run(answer, int(key[0]), int(key[1]), pd.DataFrame(lined, columns=["seq", "type", "content"]))
        if closed:
            self.waiting.clear()
            self.text.clear()
        elif answer.full:
            self.text.appendValue((answer.full,))  # kept apart, so that a batch writes only its own text
            answer.full = ""
        return out, None if closed else answer.save(), at, closed

    def close(self) -> None:
        pass


def filter_answer_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming form; tokens of an answer may arrive in any order over micro-batches, as late as the delay."""
    timed = events.withWatermark("ts", delay).selectExpr("conv_id", "turn", "seq", "type", "content", "unix_millis(ts) as ms", "ts")
    return timed.groupBy("conv_id", "turn").transformWithStateInPandas(_FilterProcessor(), FILTERED, "Append", "EventTime")


_MONITORED_COLUMNS = [f.split()[0] for f in MONITORED.split(", ")]


class _Times(NamedTuple):
    """What is known of a stream: start, first and last token, tokens, last event in order, next number, whether it ended,
    and its latest event."""
    t0: int | None = None
    t1: int | None = None
    t2: int | None = None
    n: int = 0
    last: int | None = None
    next: int = 0
    closed: bool = False
    latest: int = 0

    def deadline(self) -> int:
        """When the stream has failed, if nothing more comes."""
        return self.latest + STALL_MS if self.t0 is None else min(self.last + STALL_MS, self.t0 + TIMEOUT_MS)


class _MonitorProcessor(StatefulProcessor):
    """Metrics on completion; failure on an error event, a stalled stream or one above the time limit.

    Events count in order of their sequence numbers, which start at 0: an event waits until all before it are there, or until
    the watermark passes the stream's deadline. A closed stream is remembered until the watermark has passed its latest event
    by the time limit, so late events don't open it again.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "times", "t0 long, t1 long, t2 long, n long, last long, next long, closed boolean, latest long")
        self.waiting = handle.getMapState("waiting", "seq long", "type string, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = _Times(*self.state.get()) if self.state.exists() else _Times()
        events = pd.concat(list(rows))
        times = times._replace(latest=max(times.latest, int(events["ms"].max())))
        out: list[tuple] = []
        if not times.closed:
            ready = {int(seq): (kind, int(at)) for seq, kind, at in events[["seq", "type", "ms"]].itertuples(index=False) if seq >= times.next}
            lined = []
            while True:
                if times.next in ready:
                    event = ready.pop(times.next)
                elif self.waiting.containsKey((times.next,)):
                    event = self.waiting.getValue((times.next,))
                    self.waiting.removeKey((times.next,))
                else:
                    break
                lined.append(event)
                times = times._replace(next=times.next + 1)
            times, out = self._run(key, times, lined)
            if not times.closed:
                for seq, event in ready.items():
                    self.waiting.updateValue((seq,), event)
        self._keep(times)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        times = _Times(*self.state.get()) if self.state.exists() else _Times(closed=True)
        if times.closed:
            self.state.clear()
            self.waiting.clear()
            yield self._rows([])
            return
        # what is missing can't come any more
        lined = sorted((seq[0], *event) for seq, event in self.waiting.iterator())
        self.waiting.clear()
        if lined:
            times = times._replace(next=lined[-1][0] + 1)
        times, out = self._run(key, times, [event[1:] for event in lined])
        if not times.closed and times.deadline() <= timerValues.getCurrentWatermarkInMs():
            kind = "stall" if times.last + STALL_MS <= times.t0 + TIMEOUT_MS else "timeout"
            times, out = times._replace(closed=True), self._result(key, kind, None, times)
        self._keep(times)
        yield self._rows(out)

    def _run(self, key, times: _Times, lined: list[tuple]) -> tuple[_Times, list[tuple]]:
        """Takes events in order; returns what is known then, and the row of a stream that ended."""
        for kind, at in lined:
            t0 = at if times.t0 is None else times.t0
            # the limit that ran out first decides
            stalled = at if times.last is None or at - times.last <= STALL_MS else times.last + STALL_MS
            late = at if at - t0 <= TIMEOUT_MS else t0 + TIMEOUT_MS
            outcome = None
            if min(stalled, late) < at:
                outcome = "stall" if stalled <= late else "timeout"
            elif kind in ("error", "complete"):
                outcome = kind
            if outcome:
                self.waiting.clear()
                return times._replace(t0=t0, closed=True), self._result(key, outcome, at, times)
            times = times._replace(t0=t0, last=at)
            if kind == "token":
                times = times._replace(t1=at if times.t1 is None else times.t1, t2=at, n=times.n + 1)
        return times, []

    def _keep(self, times: _Times) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.state.update(tuple(times))
        self.handle.registerTimer(times.latest + TIMEOUT_MS if times.closed else times.deadline())

    @staticmethod
    def _result(key, outcome, at, times: _Times) -> list[tuple]:
        t0, t1, t2, n, *_ = times
        if outcome != "complete":
            return [(int(key[0]), int(key[1]), outcome, None, None, None, None, None)]
        if n < 2:
            return []
        total = at - t1
        return [(int(key[0]), int(key[1]), outcome, t1 - t0, n - 1, (t2 - t1) / (n - 1), total,
                 (n - 1) / (total / 1000) if total else None)]

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=_MONITORED_COLUMNS)
        return frame.astype({c: "Int64" for c in ("time_to_first_token", "total_tokens", "total_stream_time")})

    def close(self) -> None:
        pass


def monitor_streams(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """One row per ended stream: timing when it completed, otherwise why it failed."""
    timed = events.withWatermark("ts", delay).selectExpr("conv_id", "turn", "seq", "type", "unix_millis(ts) as ms", "ts")
    return timed.groupBy("conv_id", "turn").transformWithStateInPandas(
        _MonitorProcessor(), MONITORED, "Append", "EventTime")
