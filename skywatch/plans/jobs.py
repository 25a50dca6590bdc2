"""Job entry points for the reference's scheduled and event-driven tasks.

Each job reads its inputs from storage with the library readers, runs the
same operators the registered queries use, and writes results to sinks.
Nothing is collected to the driver except a few counts. A job that fails
leaves one error notification next to its own (H8) and raises the error again;
intermediate tables are removed when a job ends.

* weekly usage report  -> :func:`usage_report_job`
* credential check     -> :func:`credential_check_job`
* drift check          -> :func:`drift_check_job`
* uptime check         -> :func:`uptime_check_job`
* tear-down report     -> :func:`teardown_report_job`
* object sync plan     -> :func:`inventory_sync_job`
* login alerts         -> :func:`skywatch.streaming.logins.start_login_alert_stream`
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.config import Params
from skywatch.operators import devices, drift, rules, usage
from skywatch.plans import accounts
from skywatch.plans import usage_report as ur
from skywatch.session import materialize, prepare_session, scratch_removed
from skywatch.sources import logs, reports, sinks


def notices(workload: str, sink: str = "out_path") -> Callable:
    """H8 around a job: the argument named ``sink`` is the folder its ``notifications`` go to."""
    def around(job: Callable) -> Callable:
        signature = inspect.signature(job)

        @functools.wraps(job)
        def run(*args, **kwargs):
            given = signature.bind(*args, **kwargs)
            given.apply_defaults()
            a = given.arguments
            prepare_session(a["spark"])
            with sinks.notify_on_failure(a["spark"], f"{a[sink].rstrip('/')}/notifications", workload, a["invocation_id"]), scratch_removed(a["spark"]):
                return job(*args, **kwargs)
        return run
    return around


@notices("usage report")
def usage_report_job(spark: SparkSession, params: Params, stacks_path: str, ip_info_path: str, out_path: str,
                     invocation_id: str, cdn_path: str | None = None, object_log_path: str | None = None,
                     api_log_path: str | None = None, log_groups: DataFrame | None = None) -> dict[str, int]:
    """Weekly usage report: tracked resources from the stack
    descriptions, the three log families, IP risk, roll-up; writes the short
    report and the detailed report as ordered text, and a notification.

    Every file under the log roots is read: a file's name does not say which
    lines it holds (late deliveries), so only the lines' own dates decide.
    Land logs by date (:func:`skywatch.sources.logs.land_log_family`) where
    the history is long.
    """
    resources = usage.scope_accounts(reports.tracked_resources(reports.read_stacks(spark, stacks_path)),
                                     params.accounts)
    routed = reports.route_resources(resources)
    rows = usage.usage_rows(
        routed.where(F.col("route") != "error"), params.window_start, params.window_end,
        cdn=logs.read_cdn_logs(spark, cdn_path) if cdn_path else None,
        objlog=logs.read_object_access_logs(spark, object_log_path) if object_log_path else None,
        api=logs.read_api_logs(spark, api_log_path) if api_log_path else None,
        log_groups=log_groups, now=params.now)
    enriched = materialize(ur.usage_enriched(rows, reports.read_ip_info(spark, ip_info_path),
                                             params.high_risk_countries, params.home_countries), "usage_enriched")
    lines = ur.report_lines(enriched, routed.where(F.col("route") == "error"), params.days)
    sinks.write_report_lines(lines, f"{out_path}/report", ["section", "title", "kind", "line"])
    sinks.write_report_lines(ur.detail_lines(enriched), f"{out_path}/detail", ["line"])
    n_rows = enriched.count()
    sinks.write_notifications(
        sinks.notification(spark, "AWS usage info",
                           f"Usage info for the past {params.days} days: {n_rows} usage rows. "
                           f"Report: {out_path}/report", invocation_id),
        f"{out_path}/notifications")
    return {"usage_rows": n_rows}


@notices("credential check", "sink_root")
def credential_check_job(spark: SparkSession, report_path: str, account_ids: list[str], store_root: str,
                         sink_root: str, params: Params, invocation_id: str) -> dict[str, int]:
    """Daily credential check: reports -> rules -> lifecycle -> notification."""
    rep = reports.read_credential_report(spark, report_path)
    accts = spark.createDataFrame([(a,) for a in account_ids], "accountId string")
    found = accounts.run_account_check(
        rep, lambda df: rules.credential_issues(df, accts, params.now, params.max_credential_age),
        accounts=account_ids)
    return accounts.run_monitor(spark, accounts.IAM, found, store_root, sink_root, params.now, invocation_id)


@notices("drift check", "sink_root")
def drift_check_job(spark: SparkSession, stack_path: str, drift_path: str, store_root: str, sink_root: str,
                    params: Params, invocation_id: str, include_deleted: bool = False) -> dict[str, int]:
    """Daily drift check: every stack not in sync after the false-positive rules is an issue."""
    stacks, drifts = reports.read_drift_results(spark, stack_path, drift_path)
    status = drift.drift_status(stacks, drifts, keys=["accountId", "StackName"], include_deleted=include_deleted)
    found = status.where("is_issue").select("accountId", "stackName", "driftStatus")
    return accounts.run_monitor(spark, accounts.DRIFT, found, store_root, sink_root, params.now, invocation_id)


@notices("uptime check", "sink_root")
def uptime_check_job(spark: SparkSession, devices_path: str, store_root: str, sink_root: str,
                     params: Params, invocation_id: str) -> dict[str, int]:
    """Six-hourly uptime check over a device search export."""
    found = devices.disconnected_devices(reports.read_devices(spark, devices_path))
    return accounts.run_monitor(spark, accounts.UPTIME, found.select("thingName", "thingId", "timestamp"),
                                store_root, sink_root, params.now, invocation_id)


@notices("tear-down report")
def teardown_report_job(spark: SparkSession, stacks_path: str, results_path: str | None, out_path: str,
                        invocation_id: str) -> dict[str, int]:
    """Emergency tear-down report (B32, D7): which stacks are protected, and
    the outcome of each delete request (``results_path``: JSON lines of
    ``StackName, deleteResult``; a missing result is a rejected request).
    Deleting stacks is not built; this reports on a tear-down run."""
    from skywatch.operators import inventory as inv
    stacks = reports.read_stacks(spark, stacks_path).select("StackName", "EnableTerminationProtection")
    if results_path:
        res = spark.read.schema("StackName string, deleteResult string").json(results_path)
        stacks = stacks.join(res, on="StackName", how="left")
    else:
        stacks = stacks.withColumn("deleteResult", F.lit(None).cast("string"))
    outcome = materialize(inv.teardown_outcome(inv.teardown_split(stacks)), "teardown")
    outcome.write.mode("overwrite").json(f"{out_path}/outcomes")
    counts = {r.outcome: r.n for r in inv.teardown_tally(outcome).collect()}
    sinks.write_notifications(sinks.notification(
        spark, "AWS Emergency Tear Down",
        f"Attempted to destroy some stacks: skipped {counts.get('skipped', 0)}, destroyed "
        f"{counts.get('destroyed', 0)}, failed {counts.get('failed', 0)}. Details: {out_path}/outcomes",
        invocation_id), f"{out_path}/notifications")
    return counts


@notices("object sync plan")
def inventory_sync_job(spark: SparkSession, remote_keys_path: str, local_paths_path: str, prefix: str,
                       out_path: str, include: list[str] | None = None, exclude: list[str] | None = None,
                       base_path: str | None = None, invocation_id: str = "object-sync") -> dict[str, int]:
    """Object sync plan (B33, B34, C6, D10) and the key listing of the
    remote side (H7 with J3 links). Inputs are key listings, one key per
    line; copying and deleting objects is not built."""
    from skywatch.operators import inventory as inv
    remote = inv.strip_prefix(spark.read.text(remote_keys_path).withColumnRenamed("value", "key"), "key", prefix)
    remote = inv.suffix_filter(remote, "key", include, exclude).withColumnRenamed("key", "path")
    local = inv.suffix_filter(spark.read.text(local_paths_path).withColumnRenamed("value", "path"),
                              "path", include, exclude)
    diff = materialize(inv.inventory_diff(remote, local), "sync_plan")
    diff.write.mode("overwrite").partitionBy("action").text(f"{out_path}/plan")
    tree = inv.file_links(inv.key_tree(remote), base_path or prefix)
    (tree.orderBy("listing_order").select("depth", "kind", "name", "link")
     .write.mode("overwrite").json(f"{out_path}/listing"))
    return {r.action: r.n for r in inv.action_counts(diff).collect()}
