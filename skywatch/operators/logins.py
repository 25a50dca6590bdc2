"""Console sign-in alerting.

``login_alerts`` is one pure ``DataFrame -> DataFrame`` function used by the
batch job and, per micro-batch, by the stream (``skywatch.streaming.logins``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch import config
from skywatch.functions.scalars import js_text
from skywatch.operators.allowlist import outside_ranges

# ---- fixed values that must equal the reference's messages ----
ALERT_INTRO = "The following cloudtrail records originated from IPs that weren't in expected ranges:\n\n"
ALERT_SUBJECT = "AWS account login alert"
# ---------------------------------------------------------------------------


def signin_events(records: DataFrame) -> DataFrame:
    """B12 + B13: successful console sign-ins and role switches.

    A missing ``eventName`` is kept (JavaScript ``!=`` keeps it), so the test
    is null-safe; a missing ``responseElements`` or a missing result counts
    as success.
    """
    correct = ((F.col("eventSource") == config.SIGNIN_EVENT_SOURCE)
               & (F.col("eventType") == config.SIGNIN_EVENT_TYPE)
               & ~F.col("eventName").eqNullSafe(F.lit(config.SIGNIN_SKIPPED_EVENT_NAME)))
    console_ok = F.coalesce(F.col("responseElements.ConsoleLogin"), F.lit("Success")) == "Success"
    switch_ok = F.coalesce(F.col("responseElements.SwitchRole"), F.lit("Success")) == "Success"
    return records.where(correct & console_ok & switch_ok)


def user_label() -> Column:
    """``<type> - <arn>``; role switches add `` from <SwitchFrom>``."""
    ident = F.col("userIdentity")
    utype = F.when(ident.isNull(), F.lit("[unknown]")).otherwise(js_text(ident.getField("type")))
    uarn = F.when(ident.isNull(), F.lit("[unknown]")).otherwise(js_text(ident.getField("arn")))
    extra = F.col("additionalEventData")
    from_ = F.when(extra.isNull(), F.lit("[unknown]")).otherwise(js_text(extra.getField("SwitchFrom")))
    base = F.concat(utype, F.lit(" - "), uarn)
    return F.when(F.col("eventName") == "SwitchRole", F.concat(base, F.lit(" from "), from_)).otherwise(base)


def alert_projection(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The alert row shape."""
    return records.select(
        *(keep or []),
        user_label().alias("user"),
        F.col("eventTime").alias("time"),
        F.col("sourceIPAddress").alias("sourceIp"),
        "userAgent",
        F.col("recipientAccountId").alias("account"),
        F.struct("eventSource", "eventType", "eventName", "responseElements").alias("sourceData"))


def login_alerts(spark: SparkSession, records: DataFrame, ip_ranges: list[str],
                 keep: list[str] | None = None) -> DataFrame:
    """Alert rows for sign-ins from outside the allowed ranges.

    Filters, allowlist and projection are one pass over the records, in batch and in a stream alike.
    """
    return alert_projection(outside_ranges(signin_events(records), "sourceIPAddress", ip_ranges), keep)


def alert_messages(alerts: DataFrame, group_col: str, invocation_id: Column | None = None) -> DataFrame:
    """H6: one message per trigger (a trail file, or a micro-batch); no rows, no message.

    A group is one input file or batch, so its size is bounded by that input.
    """
    body = F.to_json(F.collect_list(F.struct("user", "time", "sourceIp", "userAgent", "account", "sourceData")))
    out = (alerts.groupBy(group_col)
           .agg(F.count(F.lit(1)).alias("n_alerts"), body.alias("records"))
           .select(F.col(group_col),
                   F.lit(ALERT_SUBJECT).alias("subject"),
                   F.concat(F.lit(ALERT_INTRO), F.col("records")).alias("message"),
                   "n_alerts"))
    if invocation_id is not None:
        out = out.withColumn("invocation_id", invocation_id)
    return out
