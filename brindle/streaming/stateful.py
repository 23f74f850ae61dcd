"""Responses and tasks of a stream, with timers for those that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessorHandle, TimerValues

from brindle.operators.relational import DONE, FAILED

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINES = "response_id string, seq long, line string, timed_out boolean"
TASKS = "task string, status string, state string, polls long"


def keep_in_rocks(spark: SparkSession) -> None:
    """Lists and timers need this state store; queries that run keep the one they were started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def is_end(line: str | None) -> bool:
    return line is not None and line.startswith("data: ") and line[6:].strip() == "[DONE]"


def reset_timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The key's only timer is at `at` from now on; none for None."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    if at is not None:
        handle.registerTimer(at)


class Responses(StatefulProcessor):
    """Lines of a response, held as a list that is appended to, and given out at its end or after `timeout` seconds without a line."""

    def __init__(self, timeout: int | None):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.lines = handle, handle.getListState("lines", "seq long, line string")

    def given(self, key: str, timed_out: bool) -> pd.DataFrame:
        got = sorted((int(s), x) for s, x in self.lines.get()) if self.lines.exists() else []
        self.lines.clear()
        return pd.DataFrame({"response_id": [key] * len(got), "seq": [s for s, _ in got], "line": [x for _, x in got], "timed_out": [timed_out] * len(got)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        ended = False
        for f in rows:
            self.lines.appendList([(int(s), x) for s, x in zip(f["seq"], f["line"], strict=True)])
            ended = ended or any(map(is_end, f["line"]))
        if self.timeout is not None:
            reset_timer(self.handle, None if ended else timerValues.getCurrentProcessingTimeInMs() + 1000 * self.timeout)
        if ended:
            yield self.given(key[0], False)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.given(key[0], True)

    def close(self) -> None:
        pass


def complete_responses(lines: DataFrame, timeout: int | None = None) -> DataFrame:
    """(response_id, seq, line, timed_out) of a streaming frame of lines (response_id, seq, line), once a response has its [DONE], or after `timeout` seconds of processing time without a line if one is given.

    Until then the lines wait in the state store, where each batch appends what is new. What comes
    after a response's end starts anew. Null lines and null responses are left out. `assemble_chat` takes what comes out.
    """
    keep_in_rocks(lines.sparkSession)
    rows = lines.select(F.col("response_id").cast("string").alias("response_id"), F.col("seq").cast("long").alias("seq"), "line").where("line is not null and response_id is not null")
    return rows.groupBy("response_id").transformWithStateInPandas(Responses(timeout), LINES, "Append", "None" if timeout is None else "ProcessingTime")


class Tasks(StatefulProcessor):
    """The latest poll of a task by (ts, event_id), given out once: when it ends, or `timeout` seconds after the first poll."""

    def __init__(self, timeout: int, by_event: bool):
        self.timeout, self.by_event = timeout, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ts timestamp, event_id long, status string, polls long, until long, closed boolean")

    def ended(self, task: str, held: tuple, state: str) -> pd.DataFrame:
        self.last.update((*held[:5], True))
        return pd.DataFrame({"task": [task], "status": [held[2]], "state": [state], "polls": [held[3]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        polls = sorted((pd.Timestamp(t), int(e), s) for f in rows for t, e, s in zip(f["ts"], f["event_id"], f["status"], strict=True))
        held = tuple(self.last.get()) if self.last.exists() else None
        if held is not None and held[5]:
            return  # it has ended: later polls change nothing
        if held is None:
            start = polls[0][0].timestamp() * 1000 if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            held = (None, 0, None, 0, int(start) + 1000 * self.timeout, False)
            self.handle.registerTimer(held[4])
        for at, event, status in polls:
            if self.by_event and at.timestamp() * 1000 > held[4]:
                yield self.ended(key[0], held, "timed_out")  # it was too late when this poll was made
                return
            if held[0] is None or (pd.Timestamp(held[0]), held[1]) <= (at, event):
                held = (at.to_pydatetime(), event, status, *held[3:])
            held = (*held[:3], held[3] + 1, *held[4:])
        low = (held[2] or "").lower()
        if low in DONE or low in FAILED:
            yield self.ended(key[0], held, "completed" if low in DONE else "failed")
        else:
            self.last.update(held)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.last.get()) if self.last.exists() else None
        if held is not None and held[5]:
            self.last.clear()  # a task that has ended is forgotten when its time is over
        elif held is not None:
            yield self.ended(key[0], held, "timed_out")

    def close(self) -> None:
        pass


def ended_tasks(polls: DataFrame, timeout: int = 180, by_event: bool = False) -> DataFrame:
    """(task, status, state, polls) of a streaming frame of polls (task, ts, event_id, status): a row when a task ends, completed, failed or, `timeout` seconds after its first poll, timed_out though no poll comes any more.

    Time is that of processing, or with by_event that of ts, of which the frame
    needs a watermark; polls made later than that don't count then. Polls after an end change nothing; the state of a task
    that ends goes when its time is over. Null tasks are left out.
    """
    keep_in_rocks(polls.sparkSession)
    rows = polls.where("task is not null").withColumns({"task": F.col("task").cast("string"), "event_id": F.col("event_id").cast("long")}).select("task", "ts", "event_id", "status")
    return rows.groupBy("task").transformWithStateInPandas(Tasks(timeout, by_event), TASKS, "Append", "EventTime" if by_event else "ProcessingTime")
