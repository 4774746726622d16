"""Runs that stay RUNNING for too long, told once each while the ledger is streamed."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: ``transformWithState`` keeps its state there; set it on the session before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "run_id string, started_at timestamp, stale_at timestamp"


class _Watch(StatefulProcessor):
    """State of a run: when it started, and whether it was told.  One timer, at the time at which it turns stale."""

    def __init__(self, minutes: float):
        self.minutes = minutes

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started_at timestamp, told boolean")

    def _drop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        if (found["status"] != "RUNNING").any():  # a terminal row ends the run, whatever came before it
            self._drop_timers()
            self.run.clear()
        elif not self.run.exists():
            started = found["started_at"].min()
            self.run.update((started.to_pydatetime(), False))
            self.handle.registerTimer(_millis(started.to_pydatetime()) + int(self.minutes * 60_000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            started, told = self.run.get()
            if not told:
                self.run.update((started, True))
                yield pd.DataFrame({"run_id": [key[0]], "started_at": [started], "stale_at": [started + timedelta(minutes=self.minutes)]})

    def close(self) -> None:
        pass


def _millis(at: datetime) -> int:
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def watch_stale_runs(ledger: DataFrame, minutes: float = 15, delay: str = "0 seconds") -> DataFrame:
    """A stream of (run_id, started_at, stale_at) from a streamed ledger (run_id, status, started_at, written_at).

    The clock is that of the ledger: the greatest ``written_at`` less ``delay``.  A run is told once, when the clock passes the time at which it
    turns stale and no terminal row of it has come; a run whose terminal row comes later isn't taken back.
    """
    rows = ledger.select("run_id", "status", "started_at", "written_at").withWatermark("written_at", delay)
    return rows.groupBy("run_id").transformWithStateInPandas(_Watch(minutes), _OUT, "Append", "EventTime")
