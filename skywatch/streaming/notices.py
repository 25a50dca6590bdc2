"""Failure notices of streams (H8): a query that ends with an error leaves one notification.

The error itself reaches whoever awaits the query, as without a notice.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from skywatch.sources import sinks


class FailureNotices(StreamingQueryListener):
    """Writes a notification to ``sink_path`` when a query of one of the given names fails.

    Register it with ``spark.streams.addListener`` before the queries start. ``workloads``: query name to workload."""

    def __init__(self, spark: SparkSession, sink_path: str, workloads: dict[str, str]) -> None:
        super().__init__()
        self.spark, self.sink_path, self.workloads = spark, sink_path, workloads
        self.watched: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        if event.name in self.workloads:
            self.watched[str(event.runId)] = self.workloads[event.name]

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        workload = self.watched.pop(str(event.runId), None)
        if workload is not None and event.exception:
            sinks.write_notifications(sinks.failure_notice(self.spark, workload, str(event.runId), str(event.exception)), self.sink_path)
