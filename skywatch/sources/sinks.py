"""Notification and report sinks.

A notification is a row ``(invocation_id, subject, message)``; the transport
(mail, topic, chat) is whatever reads the sink directory. Writes are
idempotent per ``invocation_id`` (dynamic partition overwrite), so a retried
batch or job replaces its own message instead of sending it twice.
"""

from __future__ import annotations

import traceback
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_notifications(df: DataFrame, path: str) -> None:
    """Append ``(invocation_id, subject, message)`` rows, replacing a rerun's own rows."""
    (df.select("invocation_id", "subject", "message")
     .write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("invocation_id")
     .json(path))


def write_report_lines(lines: DataFrame, path: str, order_cols: list[str], line_col: str = "line") -> None:
    """Render a report frame as text, in order, without collecting it.

    A global sort range-partitions the lines, so the part files read in name
    order give the report in order.
    """
    lines.orderBy(*order_cols).select(F.col(line_col).alias("value")).write.mode("overwrite").text(path)


def notification(spark, subject: str, message: str, invocation_id: str) -> DataFrame:
    return spark.createDataFrame([(invocation_id, subject, message)], "invocation_id string, subject string, message string")


def failure_notice(spark, workload: str, invocation_id: str, error: str) -> DataFrame:
    return notification(spark, f"AWS account {workload} alert", f"Error occurred running {workload}: \n{error}", invocation_id)


@contextmanager
def notify_on_failure(spark, sink_path: str, workload: str, invocation_id: str):
    """H8: an exception writes an error notification, then propagates."""
    try:
        yield
    except Exception as e:  # noqa: BLE001 - re-raised below
        write_notifications(failure_notice(spark, workload, invocation_id, "".join(traceback.format_exception(e))), sink_path)
        raise
