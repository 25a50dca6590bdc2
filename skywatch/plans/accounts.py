"""Account check plug-in (J2) and the monitor definitions (J1) of the three
posture checks.

The reference loops over accounts in series, calling ``checkOneAccount``
and then ``summarise`` on the list. Here the account is a column: a check
is one ``DataFrame -> DataFrame`` function over the rows of all accounts
(``df.transform``), scoped to the listed accounts by a semi-join (C8), and
the summary is another function over its result. No loop, no per-account
job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skywatch.functions.scalars import js_date_text
from skywatch.operators import issues as iss
from skywatch.operators import rules

Check = Callable[[DataFrame], DataFrame]


def run_account_check(inputs: DataFrame, check: Check, summarise: Check | None = None,
                      accounts: list[str] | None = None, account_col: str = "accountId") -> DataFrame:
    """J2 + C8 + F2: scope the input rows to the listed accounts, apply the
    per-account check to all of them at once, then the summary."""
    if accounts is not None:
        spark = inputs.sparkSession
        scope = spark.createDataFrame([(a,) for a in accounts], f"{account_col} string")  # a local list: the planner knows its size
        inputs = inputs.join(scope, on=account_col, how="left_semi")
    out = inputs.transform(check)
    return out.transform(summarise) if summarise else out


def _fields(*names: str, longs: tuple[str, ...] = ()) -> StructType:
    return StructType([StructField(n, LongType() if n in longs else StringType()) for n in names])


IAM = iss.Monitor(
    type="iam-checker", label="IAM",
    fields=_fields("accountId", "resource", "attribute", "expected", "actual"),
    text=rules.credential_issue_text,
    pk=lambda: F.concat_ws("-", "accountId", "resource", "attribute", "expected"))

DRIFT = iss.Monitor(
    type="cfn-drift-checker", label="CFN-DRIFT",
    fields=_fields("accountId", "stackName", "driftStatus"),
    text=lambda: F.format_string("%s: %s is '%s'", F.col("accountId"), F.col("stackName"),
                                 F.coalesce(F.col("driftStatus"), F.lit("null"))),
    pk=lambda: F.concat_ws("-", "accountId", "stackName"))

UPTIME = iss.Monitor(
    type="uptime-checker", label="uptime",
    fields=_fields("thingName", "thingId", "timestamp", longs=("timestamp",)),
    text=lambda: F.concat(F.col("thingName"), F.lit(" ("), F.col("thingId"), F.lit(") was disconnected since "),
                          F.coalesce(js_date_text(F.col("timestamp")), F.lit("[unknown]")),
                          F.lit("'")),
    pk=lambda: F.col("thingName"))


def run_monitor(spark, monitor: iss.Monitor, current: DataFrame, store_root: str, sink_root: str,
                today, invocation_id: str, attempts: int = 5) -> dict[str, int]:
    """One posture-check run for any monitor.

    Keys the current issues (G9), diffs them with the stored snapshot (H3),
    writes the next snapshot as a new version only when something was
    raised or fixed (A10: no write otherwise), writes the message lines and
    a notification when H4 says so, and only then moves the store pointer:
    a run that fails before the end leaves the store as it was and can be
    repeated, and one that another run overtook is repeated here from the
    snapshot that won (its message replaces its own earlier one). The message is written as ordered lines next to the
    notification row (subject + counts), never gathered into one string.
    Returns the state counts (three small rows, D6).
    """
    from skywatch.session import materialize
    from skywatch.sources import store

    # written once: states, snapshot and message all come from the same rows
    keyed = materialize(iss.with_keys(monitor, current), f"{monitor.type}-issues")
    for left in range(attempts - 1, -1, -1):
        try:
            return _run_once(spark, monitor, keyed, store_root, sink_root, today, invocation_id)
        except store.CommitConflict:
            if not left:
                raise
    raise ValueError("attempts must be at least 1")


def _run_once(spark, monitor: iss.Monitor, keyed: DataFrame, store_root: str, sink_root: str, today, invocation_id: str) -> dict[str, int]:
    from skywatch.session import materialize
    from skywatch.sources import sinks, store

    seq = store.next_seq(spark, store_root, monitor.type)
    previous = store.read_issues(spark, store_root, monitor.type)
    states = materialize(iss.issue_states(monitor, keyed, previous), f"{monitor.type}-states")
    counts = {r.state: r.n for r in iss.state_counts(states).collect()}
    version = None
    if counts["raised"] or counts["fixed"]:
        version = store.write_snapshot(spark, store_root, iss.next_snapshot(monitor, keyed, previous),
                                       monitors=[monitor.type], commit=False)
    if iss.should_notify(spark.createDataFrame([(k, v) for k, v in counts.items()], "state string, n bigint"),
                         today).first().notify:
        out = f"{sink_root.rstrip('/')}/messages/{invocation_id}"
        sinks.write_report_lines(iss.message_lines(monitor, states), out, ["section", "kind", "line"])
        summary = (f"{monitor.label} issues found: {counts['raised']} raised, {counts['existing']} existing, "
                   f"{counts['fixed']} resolved. Message: {out}")
        sinks.write_notifications(sinks.notification(spark, f"AWS account {monitor.label} alert", summary,
                                                     invocation_id), f"{sink_root.rstrip('/')}/notifications")
    if version is not None:
        store.commit_version(spark, store_root, version, [monitor.type], seq)
    return counts
