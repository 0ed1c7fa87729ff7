"""Page states kept up to date from a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE, OUT = "status string, retry_count int", "doc_id long, page int, status string, retry_count int"


def tracked(attempts: DataFrame, retries: int = 1) -> DataFrame:
    """doc_id, page, status, retry_count whenever attempts (doc_id, page, attempt, ok) change a page.

    The state of a page is two fields. Attempts of one batch count in order of attempt; those that arrive in a later batch count
    after them; attempts on a page that is completed or failed count for nothing, so a batch may be repeated after a loss.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, failures = state.get if state.exists else ("pending", 0)
        for row in pd.concat(list(batches)).sort_values("attempt", kind="stable").itertuples():
            if status != "pending":
                break
            if row.ok:
                status = "completed"
            else:
                failures += 1
                status = "pending" if failures <= retries else "failed"
        state.update((status, failures))
        yield pd.DataFrame([(*key, status, failures)], columns=["doc_id", "page", "status", "retry_count"])

    return attempts.groupBy("doc_id", "page").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
