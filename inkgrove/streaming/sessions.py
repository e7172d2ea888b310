"""The last state of every session, kept for a time after its last event and then let go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEPT_DAYS = 30
#: The store that timers and several states need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keep(StatefulProcessor):
    """One value and one timer a session: an event moves the timer, a timer that runs out ends the session."""

    def __init__(self, days: int):
        self.milliseconds = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at bigint, state string")

    def _row(self, key: tuple, at: int, state: str, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"session": [key[0]], "at": [pd.Timestamp(at, unit="ms")], "state": [state], "ended": [ended]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.held.get() if self.held.exists() else None
        best = (was[0], was[1]) if was else None
        for frame in rows:
            for at, state in zip((frame["at"].astype("int64") // 10**3 if frame["at"].dtype == "datetime64[us]" else frame["at"].astype("datetime64[ms]").astype("int64")).tolist(), frame["state"].tolist()):
                best = max(best, (at, state)) if best else (at, state)
        if best is None or was and best == (was[0], was[1]):
            return
        if was:
            self.handle.deleteTimer(was[0] + self.milliseconds)
        self.held.update(best)
        self.handle.registerTimer(best[0] + self.milliseconds)
        yield self._row(key, *best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            at, state = self.held.get()
            self.held.clear()
            yield self._row(key, at, state, True)

    def close(self) -> None:
        pass


def session_states(events: DataFrame, days: int = KEPT_DAYS, late: str = "1 hour") -> DataFrame:
    """(session, at, state, ended) from a stream (session, at timestamp, state): a row for each change of a session's newest state, by time, then state,
    and one with ended once the watermark is so many days past it. Its state is then gone; a later event begins anew. Rows that come
    later than the watermark allows are dropped. Sets the session's state store to STORE, which the operator needs."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = events.select("session", "at", F.col("state").cast("string").alias("state")).withWatermark("at", late)
    kind = events.schema["session"].dataType.simpleString()
    return stream.groupBy("session").transformWithStateInPandas(_Keep(days), f"session {kind}, at timestamp, state string, ended boolean", "append", "eventTime")
