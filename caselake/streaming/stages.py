"""The stage machine of cases as a stream: state by case, event-time timers for retries, and a log of every step.

Messages (id, ts, seq, message) move a case on; a busy model is asked again after a pause, BUSY_TRIES times, then loaded once more, and
a run that fails queues again until its attempts are used up. ``fold`` is the one rule book: the stream applies it to the rows of each batch and
to expired timers, and ``batch_log`` to a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .cases import BUSY_TRIES, MAX_ATTEMPTS

#: The stage after each, for a run that goes well.
NEXT = {"ocr": "structuring", "structuring": "classifying", "classifying": "done"}
STATE = "stage string, attempts int, busy int, reloaded boolean, due long"
LOG = "at timestamp, n int, old string, new string, attempts int, why string"


@dataclass
class Case:
    """What is known of a case. ``due``: when a busy model is asked again, in microseconds; nothing else moves a waiting case but a stop or a failure."""

    stage: str = ""
    attempts: int = 0
    busy: int = 0
    reloaded: bool = False
    due: int | None = None

    def _settle(self) -> str:
        self.busy, self.reloaded, self.due = 0, False, None
        return "error" if self.attempts >= MAX_ATTEMPTS else "queued"

    def step(self, message: str, at: int, wait: int) -> tuple[str, str] | None:
        """The new stage and why, or None where the message changes no stage."""
        working = self.stage in NEXT
        match message:
            case "submit" if self.stage in ("", "done", "error"):
                self.attempts, self.busy, self.reloaded, self.due = 0, 0, False, None
                return "queued", "submitted"
            case "claim" if self.stage == "queued":
                self.attempts += 1
                return "ocr", "claimed"
            case "advance" if working and self.due is None:
                return NEXT[self.stage], "went well"
            case "busy" if working and self.due is None:
                if self.busy < BUSY_TRIES:
                    self.busy, self.due = self.busy + 1, at + wait
                    return self.stage, "busy"
                if not self.reloaded:
                    self.busy, self.reloaded = 0, True
                    return self.stage, "reloaded"
                return self._settle(), "busy too long"
            case "fail" if working:
                return self._settle(), "failed"
            case "stop" if working:
                return self._settle(), "interrupted"
        return None


def _entry(case: Case, at: int, told: tuple[str, str]) -> tuple:
    old, case.stage = case.stage, told[0]
    return at, old, case.stage, case.attempts, told[1]


def fold(case: Case, messages: list[tuple[int, str]], wait: int, until: int | None = None) -> Iterator[tuple]:
    """Log entries (at, old, new, attempts, why) of messages (at, message) in order of time; a timer that is due fires before what comes after it.

    ``until``: the time up to which timers fire at the end.
    """
    for at, message in [*messages, *([(until, "")] if until is not None else [])]:
        if case.due is not None and case.due <= at:
            due, case.due = case.due, None
            yield _entry(case, due, (case.stage, "asked again"))
        if message and (told := case.step(message, at, wait)):
            yield _entry(case, at, told)


def _frame(key, entries: list[tuple]) -> pd.DataFrame:
    """Entries as rows; ``n`` orders those of one time."""
    rows = [(key, pd.Timestamp(e[0], unit="us"), i, *e[1:]) for i, e in enumerate(entries)]
    return pd.DataFrame(rows, columns=["id", "at", "n", "old", "new", "attempts", "why"])


def _messages(rows: pd.DataFrame) -> list[tuple[int, str]]:
    rows = rows.sort_values(["ts", "seq"])
    return list(zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["message"].tolist(), strict=True))


class CaseStages(StatefulProcessor):
    """State and timers of one case."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", STATE)

    def _load(self) -> Case:
        return Case(*self.case.get()) if self.case.exists() else Case()

    def _keep(self, case: Case, before: int | None) -> None:
        self.case.update(astuple(case))
        if before != case.due:
            # timers count milliseconds: one more, so that none fires before its time
            if before is not None:
                self.handle.deleteTimer(before // 1000 + 1)
            if case.due is not None:
                self.handle.registerTimer(case.due // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        case = self._load()
        before = case.due
        entries = list(fold(case, _messages(pd.concat(list(rows))), self.wait))
        self._keep(case, before)
        yield _frame(key[0], entries)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        case = self._load()
        before = case.due
        entries = list(fold(case, [], self.wait, expiredTimerInfo.getExpiryTimeInMs() * 1000))
        self.case.update(astuple(case)) if before != case.due else None
        yield _frame(key[0], entries)

    def close(self) -> None:
        pass


def stream_log(messages: DataFrame, wait_seconds: float, delay: str) -> DataFrame:
    """The log of a stream of messages (id, ts, seq, message); messages later than ``delay`` are left out. Needs the RocksDB state store."""
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(messages.dtypes)["id"]
    return messages.withWatermark("ts", delay).groupBy("id").transformWithStateInPandas(CaseStages(int(wait_seconds * 1e6)), f"id {kind}, {LOG}", "Append", "EventTime")


def batch_log(messages: DataFrame, wait_seconds: float) -> DataFrame:
    """The log of a whole table of messages, timers fired as far as the last message of all. A case's messages are one group."""
    wait, kind = int(wait_seconds * 1e6), dict(messages.dtypes)["id"]
    end = messages.agg(F.max("ts").alias("end"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        until = int(rows["end"].astype("datetime64[us]").astype("int64").iloc[0])
        return _frame(key[0], list(fold(Case(), _messages(rows), wait, until)))

    return messages.join(F.broadcast(end)).groupBy("id").applyInPandas(run, f"id {kind}, {LOG}")


def final_states(log: DataFrame) -> DataFrame:
    """The stage, attempts and number of steps of each case."""
    order = F.struct("at", "n")
    return log.groupBy("id").agg(F.max_by("new", order).alias("stage"), F.max_by("attempts", order).alias("attempts"), F.count("*").alias("steps"))
