"""Page states from a stream of what workers report, with timers for workers that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "doc_id long, page int, status string, retry_count int, error string"
#: Seconds that a worker may take, and how often a page is tried again.
TIMEOUT, RETRIES = 240, 1
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Page(StatefulProcessor):
    """One page: pending, in_progress since some time, completed or failed; every change is a row."""

    def __init__(self, timeout: int, retries: int) -> None:
        self.timeout, self.retries = timeout * 1000, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("page", "status string, failures int, since long")

    def read(self) -> tuple[str, int, int]:
        return tuple(self.state.get()) if self.state.exists() else ("pending", 0, 0)

    def rows(self, key: tuple, changes: list[tuple[str, int, str | None]]) -> pd.DataFrame:
        n = len(changes)
        columns = list(zip(*changes, strict=True))
        return pd.DataFrame({"doc_id": [key[0]] * n, "page": pd.Series([key[1]] * n, dtype="int32"), "status": columns[0], "retry_count": pd.Series(columns[1], dtype="int32"), "error": pd.Series(columns[2], dtype=object)})

    def failed(self, failures: int) -> str:
        return "pending" if failures <= self.retries else "failed"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, failures, since = self.read()
        changes: list[tuple[str, int, str | None]] = []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            at = int(r.at.timestamp() * 1000)
            if status == "in_progress" and at >= since + self.timeout:  # the timer has not come round yet, but its time is over
                failures += 1
                status = self.failed(failures)
                changes.append((status, failures, "worker timed out"))
            if status in ("completed", "failed"):
                break
            if r.what == "started":
                status, since, error = "in_progress", at, None
            elif r.what == "ok":
                status, error = "completed", None
            else:
                failures, error = failures + 1, "worker failed"
                status = self.failed(failures)
            changes.append((status, failures, error))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "in_progress":
            self.handle.registerTimer(since + self.timeout)
        if changes:
            self.state.update((status, failures, since))
            yield self.rows(key, changes)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, failures, since = self.read()
        if status == "in_progress" and expiredTimerInfo.getExpiryTimeInMs() >= since + self.timeout:
            status, failures = self.failed(failures + 1), failures + 1
            self.state.update((status, failures, since))
            yield self.rows(key, [(status, failures, "worker timed out")])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((str(r["status"]), int(r["failures"]), 0))

    def close(self) -> None:
        pass


def watched(reports: DataFrame, saved: DataFrame | None = None, timeout: int = TIMEOUT, retries: int = RETRIES, late: str = "10 seconds") -> DataFrame:
    """doc_id, page, status, retry_count, error of every change, from reports (doc_id, page, at, what: started, ok or failed), a stream.

    A worker that has started and says nothing for timeout seconds of the reports' time has failed; a page is tried again until retries are used up.
    saved: states of a session (doc_id, page, status, failures), from which pages go on. Reports on a page that is completed or failed count
    for nothing, so what is sent twice after a loss does no harm. The session needs the state store PROVIDER, which keeps timers.
    """
    grouped = reports.withWatermark("at", late).groupBy("doc_id", "page")
    first = saved.select("doc_id", "page", "status", "failures").groupBy("doc_id", "page") if saved is not None else None
    return grouped.transformWithStateInPandas(statefulProcessor=Page(timeout, retries), outputStructType=OUT, outputMode="Update", timeMode="EventTime", initialState=first)
