"""What became of a streamed run (R4, A9, K5): a summary row, also for a run that failed.

A listener adds up what the triggers report, so no table is read again for the summary, however many triggers there were;
the reason of a failure is in the row and is raised as well, if asked for.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sinks.tables import write_run_rows

SUMMARY = "run_id string, status string, reason string, n_triggers long, n_input_rows long, last_epoch long, elapsed_s double"
#: Seconds to wait for the last events of a query that has ended.
EVENTS_S = 60.0


class TriggerTotals(StreamingQueryListener):
    """Totals of the triggers of each started query, by its run id."""

    def __init__(self):
        self.totals: dict[str, dict] = {}
        self.ended: dict[str, threading.Event] = {}

    def _of(self, run) -> dict:
        self.ended.setdefault(str(run), threading.Event())
        return self.totals.setdefault(str(run), {"n_triggers": 0, "n_input_rows": 0, "last_epoch": None, "reason": None})

    def onQueryStarted(self, event):  # noqa: N802
        self._of(event.runId)

    def onQueryProgress(self, event):  # noqa: N802
        p, t = event.progress, self._of(event.progress.runId)
        if p.numInputRows:
            t["n_triggers"] += 1
            t["n_input_rows"] += p.numInputRows
            t["last_epoch"] = p.batchId

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self._of(event.runId)["reason"] = event.exception
        self.ended[str(event.runId)].set()


def drain_reported(spark: SparkSession, start: Callable[[], StreamingQuery], run_id: str, path: str | None = None,
                   raise_failure: bool = True) -> DataFrame:
    """Start a query, wait for its end, and return its summary row (status ``ended`` or ``failed``, with the reason).

    With ``path`` the row is appended there first (``sinks.tables.write_run_rows``). A failure is raised after that unless
    ``raise_failure`` is off. Rows of the trigger that failed are not counted: it has not reported.
    """
    totals, began = TriggerTotals(), time.time()
    spark.streams.addListener(totals)
    try:
        q = start()
        failure = None
        try:
            q.awaitTermination()
        except Exception as e:  # noqa: BLE001  told by the row, raised below
            failure = e
        t = totals._of(q.runId)
        totals.ended[str(q.runId)].wait(EVENTS_S)
    finally:
        spark.streams.removeListener(totals)
    reason = t["reason"] or (str(failure) if failure else None)
    row = (run_id, "failed" if reason else "ended", reason, t["n_triggers"], t["n_input_rows"], t["last_epoch"], time.time() - began)
    out = spark.createDataFrame([row], SUMMARY)
    if path:
        write_run_rows(out, path)
    if reason and raise_failure:
        raise RuntimeError(f"run {run_id} failed: {reason}") from failure
    return out
