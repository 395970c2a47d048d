"""Capture that remembers the newest sessions of each repository and forgets the others, as a bounded state of a stream.

A repository's state is a map of at most `n` sessions. An event that changes a session's state (a buffered plan, a capture) makes it the newest; whatever is
then beyond the n newest goes, so an event of a forgotten session starts anew: its plan is gone, and its transcript is taken from the beginning.
The stream needs the RocksDB state store (`STORE`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .capture import COMMIT, EVENTS, OUTPUT, TIMEOUT_MS, step

NEWEST = 20
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RESULT = f"repo string, {OUTPUT}, forgotten string"
_NAMES = [c.split()[0] for c in f"{EVENTS}, {COMMIT}".split(", ")]
_STATE = ("plan", "last_commit", "last_line", "seen")
_FRESH = {"plan": None, "last_commit": None, "last_line": 0, "seen": -1}


def _changes(result: dict) -> bool:
    return result["status"] in ("buffered-plan", "captured")


def replay(sessions: dict[str, tuple], events: list[dict], n: int) -> tuple[dict[str, tuple], list[dict]]:
    """Events of one repository in their order on its sessions ((state), time of the last change): the sessions that are left and a result an event, which names those that it made be forgotten."""
    sessions, out = dict(sessions), []
    for e in events:
        name = e["session_id"]
        state, result = step(dict(zip(_STATE, sessions[name][:4], strict=True)) if name in sessions else dict(_FRESH), e)
        gone: list[str] = []
        if _changes(result):
            sessions[name] = (*(state[k] for k in _STATE), e.get("at") or "")
            order = sorted(sessions, key=lambda s: (sessions[s][4], s == name, s))  # of one time this one is the newest
            gone = order[: max(0, len(order) - n)]
            for s in gone:
                del sessions[s]
        out.append(result | {"forgotten": ",".join(gone) or None})
    return sessions, out


def _rows(frame: pd.DataFrame) -> list[dict]:
    clean = [{k: None if not isinstance(v, str | bool | int) and pd.isna(v) else v for k, v in e.items()} for e in frame.to_dict("records")]
    return sorted(clean, key=lambda e: (e.get("at") or "", e["seq"] if e["seq"] is not None else -1, e["session_id"]))


def _frame(repo: str, results: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{"repo": repo, **r} for r in results], columns=[c.split()[0] for c in RESULT.split(", ")])


class Newest(StatefulProcessor):
    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle = n, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session string", "plan string, last_commit string, last_line bigint, seen bigint, at string")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = {k[0]: tuple(v) for k, v in self.sessions.iterator()}
        now, results = replay(had, _rows(pd.concat(list(rows))), self.n)
        for name in had.keys() - now.keys():
            self.sessions.removeKey((name,))
        for name, value in now.items():
            if had.get(name) != value:
                self.sessions.updateValue((name,), value)
        if self.idle is not None:
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield _frame(key[0], results)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A repository without events for so long is forgotten."""
        self.sessions.clear()
        self.due.clear()
        yield _frame(key[0], [])

    def close(self) -> None:
        pass


def capture_newest(events: DataFrame, n: int = NEWEST, idle_ms: int | None = TIMEOUT_MS) -> DataFrame:
    """RESULT rows, one an event, of a stream or a batch of EVENTS with `repo` and, if there are any, COMMIT's columns. Events without a session are left out; a null repo is one repository.

    Events of one batch go in the order of `at`, `seq` and session. A repository's events go one after another, as they did on its machine.
    idle_ms: a repository without events for so long is forgotten, by a timer; None: never. With timers Spark goes on to look for due ones, so a stream with the trigger availableNow ends only without.
    """
    rows = events.where(F.col("session_id").isNotNull()).select(F.coalesce("repo", F.lit("")).alias("repo"), *[F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in _NAMES])
    if events.isStreaming:
        return rows.groupBy("repo").transformWithStateInPandas(Newest(n, idle_ms), RESULT, "append", "None" if idle_ms is None else "ProcessingTime")

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _frame(key[0], replay({}, _rows(frame), n)[1])

    return rows.groupBy("repo").applyInPandas(whole, RESULT)
