"""Registered queries: each takes ``(spark, sf_dir)`` and returns
a DataFrame over the whole driver tables. Oracle SQL: ``skywatch.plans.oracle``."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch import config
from skywatch.config import Params
from skywatch.operators import devices as dev
from skywatch.operators import drift as drf
from skywatch.operators import inventory as inv
from skywatch.operators import issues as iss
from skywatch.operators import attribution, logins, rules, usage
from skywatch.plans import accounts as monitors
from skywatch.plans import shims as sh
from skywatch.plans import usage_report as ur
from skywatch.session import materialize, prepare_session, scratch_path, write_tasks
from skywatch.sources import logs, reports, sinks, store, trail

PARAMS = Params(now=sh.NOW, days=sh.DAYS, high_risk_countries=sh.HIGH_RISK, home_countries=sh.HOME,
                ip_ranges=sh.IP_RANGES, accounts=sh.ACCOUNTS, max_credential_age=sh.MAX_AGE)
START, END = PARAMS.window_start, PARAMS.window_end

# ------------------------------------------------------------------ usage family


def q_cdn_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.cdn_usage(sh.cdn_logs(spark, d), START, END)


def q_cdn_usage_files(spark: SparkSession, d: str) -> DataFrame:
    """A1 end to end: the CDN shim written as gzip TSV files (two header lines
    per resource), read back with the CSV reader, counted (D1)."""
    base = sh.write_cdn_log_files(spark, d, scratch_path(spark, f"cdn_logs/{uuid.uuid4().hex}"))
    return usage.cdn_usage(logs.read_cdn_logs(spark, base), START, END)


def q_object_usage_files(spark: SparkSession, d: str) -> DataFrame:
    """A2 end to end: log lines written as gzip text files, read and parsed."""
    base = sh.write_object_log_files(spark, d, scratch_path(spark, f"object_logs/{uuid.uuid4().hex}"))
    return usage.object_usage(logs.read_object_access_logs(spark, base), START, END)


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


def q_login_alerts_files(spark: SparkSession, d: str) -> DataFrame:
    """A4 end to end: trail documents written as gzip JSON, read back, alerted."""
    base = sh.write_trail_files(spark, d, _scratch(spark, "trail"))
    recs = trail.read_audit_trail(spark, base, multi_line=False)
    return flatten_alerts(logins.login_alerts(spark, recs, PARAMS.ip_ranges, keep=["eventID"]))


def q_cred_rules_files(spark: SparkSession, d: str) -> DataFrame:
    """A5 end to end: one credential CSV per account folder, read back, checked."""
    base = sh.write_credential_reports(spark, d, _scratch(spark, "credential_reports"))
    rep = reports.read_credential_report(spark, base)
    out = rules.credential_issues(rep, sh.accounts(spark, d), sh.CRED_NOW, PARAMS.max_credential_age)
    return out.withColumn("text", rules.credential_issue_text())


def q_api_usage_files(spark: SparkSession, d: str) -> DataFrame:
    """A3 end to end: API log records as gzip JSON lines per account and log group, read back, counted."""
    base = sh.write_api_log_files(spark, d, _scratch(spark, "api_logs"))
    return usage.api_usage(logs.read_api_logs(spark, base), START, END)


def q_account_check(spark: SparkSession, d: str) -> DataFrame:
    """The credential check as a plug-in over the listed accounts, summed up by account."""
    listed = [str(k) for k in range(0, 25, 2)]
    names = sh.accounts(spark, d).where(F.col("accountId").isin(*listed))
    return monitors.run_account_check(
        sh.credential_report(spark, d), lambda rep: rules.credential_issues(rep, names, sh.CRED_NOW, PARAMS.max_credential_age),
        summarise=lambda found: found.groupBy("accountId", "attribute").agg(F.count(F.lit(1)).alias("n")), accounts=listed)


def q_drift_status_files(spark: SparkSession, d: str) -> DataFrame:
    """A7 end to end: drift summaries and resource drifts as JSON files in the
    reader's schema (keyed by account and stack name), read back, evaluated."""
    base = sh.write_drift_results(spark, d, _scratch(spark, "drift"))
    stacks, drifts = reports.read_drift_results(spark, f"{base}/stacks", f"{base}/drifts")
    return drf.drift_status(stacks, drifts, keys=["accountId", "StackName"])


def q_device_issues_files(spark: SparkSession, d: str) -> DataFrame:
    """A8 end to end: device search documents, read back, checked."""
    base = sh.write_device_searches(spark, d, _scratch(spark, "devices"))
    return dev.disconnected_devices(reports.read_devices(spark, base))


def _object_log(spark, d) -> DataFrame:
    return logs.parse_object_log(sh.object_log_lines(spark, d))


def q_object_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.object_usage(_object_log(spark, d), START, END)


def _api_log(spark, d) -> DataFrame:
    return logs.parse_api_log(sh.api_log_records(spark, d))


def q_api_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.api_usage(_api_log(spark, d), START, END)


def _resources(spark, d) -> DataFrame:
    return usage.scope_accounts(sh.usage_resources(spark, d), PARAMS.accounts)


def q_usage_all(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_rows(_resources(spark, d), START, END,
                            cdn=sh.cdn_logs(spark, d), objlog=_object_log(spark, d), api=_api_log(spark, d),
                            log_groups=sh.api_log_groups(spark, d))


def q_usage_by_source(spark: SparkSession, d: str) -> DataFrame:
    """C9 over files: CDN logs under several buckets, with equal stack and resource names in two accounts, some a
    folder deeper; each line belongs to the resource with the longest registered location around it."""
    base = sh.write_cdn_log_files(spark, d, _scratch(spark, "cdn_by_source"))
    return usage.usage_rows(_resources(spark, d), START, END, cdn=logs.read_cdn_logs(spark, base))


def q_usage_landed(spark: SparkSession, d: str) -> DataFrame:
    """CDN logs landed by folder; the usage run reads the tracked resources' folders only."""
    base, resources = _scratch(spark, "cdn_landed"), _resources(spark, d)
    logs.land_log_family(sh.cdn_logs(spark, d).repartition(write_tasks(spark), "logFolder"), base, date_col=None)
    return usage.usage_rows(resources, START, END, cdn=logs.read_tracked(spark, base, resources, config.TYPE_CLOUDFRONT))


def q_log_group_errors(spark: SparkSession, d: str) -> DataFrame:
    """Watched log groups that are missing or not the only one of their name, as rows."""
    state = usage.log_group_state(sh.usage_resources(spark, d), sh.broken_log_groups(spark, d), END, PARAMS.now)
    return state.where("error IS NOT NULL").select("accountId", "source", "n_groups", "error")


def q_location_errors(spark: SparkSession, d: str) -> DataFrame:
    return attribution.location_errors(sh.crowded_resources(spark, d))


def _enriched(spark, d):
    return ur.usage_enriched(q_usage_all(spark, d), sh.ip_info(spark, d), PARAMS.high_risk_countries,
                             PARAMS.home_countries)


def q_ip_risk(spark: SparkSession, d: str) -> DataFrame:
    from skywatch.operators import iprisk
    ips = q_usage_all(spark, d).select("sourceIp").distinct()
    dim = iprisk.ip_dimension(sh.ip_info(spark, d), PARAMS.high_risk_countries, PARAMS.home_countries)
    return (iprisk.enrich(ips, dim)
            .select(F.col("sourceIp").alias("ip"), "risk", "description", "shortDescription", "known"))


def q_usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_rollup(_enriched(spark, d))


def q_usage_report(spark: SparkSession, d: str) -> DataFrame:
    enriched = materialize(_enriched(spark, d), "usage_enriched")
    errors = reports.route_resources(_resources(spark, d)).where(F.col("route") == "error")
    return ur.report_lines(enriched, errors, PARAMS.days)


def q_usage_detail(spark: SparkSession, d: str) -> DataFrame:
    return ur.detail_lines(_enriched(spark, d))


def q_report_ordered(spark: SparkSession, d: str) -> DataFrame:
    enriched = materialize(_enriched(spark, d), "usage_enriched")
    errors = reports.route_resources(_resources(spark, d)).where(F.col("route") == "error")
    return ur.ordered_lines(ur.report_lines(enriched, errors, PARAMS.days))


def q_report_written(spark: SparkSession, d: str) -> DataFrame:
    """The report as the sink writes it, read back."""
    out = _scratch(spark, "report")
    sinks.write_report_lines(q_usage_report(spark, d), out, ["section", "title", "kind", "line"])
    return spark.read.text(out).withColumnRenamed("value", "line")


def q_tracked_resources(spark: SparkSession, d: str) -> DataFrame:
    return reports.route_resources(reports.tracked_resources(sh.stacks_with_outputs(spark, d)))


def q_log_range_guard(spark: SparkSession, d: str) -> DataFrame:
    return usage.log_range_guard(sh.log_groups(spark, d), sh.GUARD_END, sh.GUARD_NOW)


# ------------------------------------------------------------------ logins

def q_login_filter(spark: SparkSession, d: str) -> DataFrame:
    r = logins.signin_events(sh.trail_records(spark, d))
    return r.select("eventID", "eventName", "sourceIPAddress", "eventSource", "eventType",
                    F.col("responseElements.ConsoleLogin").alias("consoleLogin"),
                    F.col("responseElements.SwitchRole").alias("switchRole"))


def flatten_alerts(a: DataFrame) -> DataFrame:
    return a.select("eventID", "user", "time", "sourceIp", "userAgent", "account",
                    F.col("sourceData.eventSource").alias("eventSource"),
                    F.col("sourceData.eventType").alias("eventType"),
                    F.col("sourceData.eventName").alias("eventName"),
                    F.col("sourceData.responseElements.ConsoleLogin").alias("consoleLogin"),
                    F.col("sourceData.responseElements.SwitchRole").alias("switchRole"))


def q_login_alerts(spark: SparkSession, d: str) -> DataFrame:
    a = logins.login_alerts(spark, sh.trail_records(spark, d), PARAMS.ip_ranges, keep=["eventID"])
    return flatten_alerts(a)


# ------------------------------------------------------------------ credentials, drift, devices

def cred_issues(spark, d, now, mfa_above: int = 5000) -> DataFrame:
    rep = sh.credential_report(spark, d, mfa_above)
    return rules.credential_issues(rep, sh.accounts(spark, d), now, PARAMS.max_credential_age)


def q_cred_rules(spark: SparkSession, d: str) -> DataFrame:
    return cred_issues(spark, d, sh.CRED_NOW).withColumn("text", rules.credential_issue_text())


def q_drift_status(spark: SparkSession, d: str) -> DataFrame:
    return drf.drift_status(sh.drift_stacks(spark, d), sh.resource_drifts(spark, d), keys=["stackKey"])


def q_device_issues(spark: SparkSession, d: str) -> DataFrame:
    return dev.disconnected_devices(sh.devices(spark, d))


def q_device_latest(spark: SparkSession, d: str) -> DataFrame:
    return dev.latest_state(sh.device_events(spark, d), tiebreak="event_id")


# ------------------------------------------------------------------ issue lifecycle

IAM_MONITOR = monitors.IAM


def _lifecycle_inputs(spark, d):
    """Current issues and the previous snapshot (in production a stored
    table; here the issues of an earlier date, when fewer customers were
    without a second factor), over all customers. One pass over a report
    finds its issues and its root rows; what it finds is written, the rest
    are projections of that."""
    def keyed(now, mfa_above: int, name: str) -> DataFrame:
        findings = rules.credential_findings(sh.credential_report(spark, d, mfa_above), now, PARAMS.max_credential_age)
        return iss.with_keys(IAM_MONITOR, rules.issues_of_findings(materialize(findings, name), sh.accounts(spark, d)))

    current = keyed(sh.CRED_NOW, 5000, "iam_current")
    prev_issues = keyed(sh.CRED_PREV_NOW, 3000, "iam_previous")
    previous = prev_issues.select(F.lit(IAM_MONITOR.type).alias("monitor"), "pk", "obj")
    return current, previous


def q_issue_states(spark: SparkSession, d: str) -> DataFrame:
    current, previous = _lifecycle_inputs(spark, d)
    return iss.issue_states(IAM_MONITOR, current, previous).select("state", "pk", "text")


def q_issue_snapshot(spark: SparkSession, d: str) -> DataFrame:
    current, previous = _lifecycle_inputs(spark, d)
    return iss.next_snapshot(IAM_MONITOR, current, previous)


def q_issue_message(spark: SparkSession, d: str) -> DataFrame:
    current, previous = _lifecycle_inputs(spark, d)
    # the message reads the states twice (headings need the counts)
    states = materialize(iss.issue_states(IAM_MONITOR, current, previous), "iam_states")
    return iss.message_lines(IAM_MONITOR, states)


def q_issue_notify(spark: SparkSession, d: str) -> DataFrame:
    current, previous = _lifecycle_inputs(spark, d)
    counts = iss.state_counts(iss.issue_states(IAM_MONITOR, current, previous))
    return iss.should_notify(counts, sh.CRED_NOW)


def _stored(spark, previous: DataFrame) -> tuple[str, DataFrame]:
    """``previous`` written to an issue store and read back with its buckets."""
    root = _scratch(spark, "issue_store")
    store.write_snapshot(spark, root, previous, [IAM_MONITOR.type])
    return root, store.read_issues(spark, root, IAM_MONITOR.type)


def q_issue_lifecycle_stored(spark: SparkSession, d: str) -> DataFrame:
    """H3 against a snapshot in the store: its side of the joins comes bucketed by key."""
    current, previous = _lifecycle_inputs(spark, d)
    return iss.issue_states(IAM_MONITOR, current, _stored(spark, previous)[1]).select("state", "pk", "text")


def q_store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Two runs commit one after the other; the store then holds the second one's snapshot."""
    current, previous = _lifecycle_inputs(spark, d)
    root, _ = _stored(spark, previous)
    store.update(spark, root, IAM_MONITOR.type, lambda before: iss.next_snapshot(IAM_MONITOR, current, before))
    return store.read_issues(spark, root, IAM_MONITOR.type)


# ------------------------------------------------------------------ inventory and templates

EXCLUDE_SUFFIXES = [".html"]


def _inventory_sides(spark, d):
    remote = inv.strip_prefix(sh.remote_keys(spark, d), "key", sh.SITE_PREFIX)
    remote = inv.suffix_filter(remote, "key", None, EXCLUDE_SUFFIXES).select(F.col("key").alias("path"))
    local = inv.suffix_filter(sh.local_paths(spark, d), "path", None, EXCLUDE_SUFFIXES)
    return remote, local


def q_inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    remote, local = _inventory_sides(spark, d)
    return inv.inventory_diff(remote, local)


def q_inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    remote, local = _inventory_sides(spark, d)
    return inv.action_counts(inv.inventory_diff(remote, local))


def q_key_tree(spark: SparkSession, d: str) -> DataFrame:
    remote = inv.strip_prefix(sh.remote_keys(spark, d), "key", sh.SITE_PREFIX)
    return inv.key_tree(remote, "key").drop("path_parts", "listing_order")


def q_key_listing(spark: SparkSession, d: str) -> DataFrame:
    remote = inv.strip_prefix(sh.remote_keys(spark, d), "key", sh.SITE_PREFIX)
    return inv.file_links(inv.key_listing(remote, "key"), sh.SITE_PREFIX)


def q_template_policies(spark: SparkSession, d: str) -> DataFrame:
    return rules.template_violations(sh.template_resources(spark, d))


def _function_resources(spark, d):
    r = sh.template_resources(spark, d)
    props = F.try_parse_json(F.col("Properties"))
    return r.select("template", "logicalId", "Type",
                    F.try_variant_get(props, "$.Handler", "string").alias("handler"),
                    F.try_variant_get(props, "$.Code.S3Key", "string").alias("s3Key"))


def q_asset_counts(spark: SparkSession, d: str) -> DataFrame:
    assets = inv.function_assets(_function_resources(spark, d))
    expected = sh.template_resources(spark, d).select("template").distinct().withColumn(
        "expected", F.lit(sh.EXPECTED_ASSETS).cast("bigint"))
    return inv.asset_count_check(assets, expected)


def q_unique_lookup(spark: SparkSession, d: str) -> DataFrame:
    return inv.unique_lookup(sh.template_resources(spark, d), sh.template_lookups(spark, d))


def q_deployed_stacks(spark: SparkSession, d: str) -> DataFrame:
    return inv.deployed_stacks(sh.deploy_stacks(spark, d))


def q_teardown_split(spark: SparkSession, d: str) -> DataFrame:
    return inv.teardown_split(sh.deploy_stacks(spark, d)).select("StackName", "protected")


def q_teardown_tally(spark: SparkSession, d: str) -> DataFrame:
    return inv.teardown_tally(inv.teardown_outcome(inv.teardown_split(sh.deploy_stacks(spark, d))))


THRESHOLDS = [("warning", sh.WARNING_BUDGET_CENTS, 5), ("warning", sh.WARNING_BUDGET_CENTS, 100),
              ("maximum", sh.MAX_BUDGET_CENTS, 100)]


def q_budget_alerts(spark: SparkSession, d: str) -> DataFrame:
    return inv.budget_alerts(sh.monthly_costs(spark, d), THRESHOLDS)


def q_upload_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = inv.upload_manifest(sh.upload_requests(spark, d), sh.BUCKET_PREFIX)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return m.select("request_id", "valid", "errors", "key",
                    F.date_format("put_expires", fmt).alias("put_expires"),
                    F.date_format("get_expires", fmt).alias("get_expires"))


def q_field_rows(spark: SparkSession, d: str) -> DataFrame:
    return inv.fields_to_row(sh.event_fields(spark, d), "fields", ["type", "user"], keep=["event_id"])


def q_login_stream(spark: SparkSession, d: str) -> DataFrame:
    from skywatch.streaming.logins import run_login_stream_over_drops
    return flatten_alerts(run_login_stream_over_drops(spark, d, PARAMS.ip_ranges))


def q_login_messages(spark: SparkSession, d: str) -> DataFrame:
    from skywatch.streaming.logins import run_login_messages
    return run_login_messages(spark, d, PARAMS.ip_ranges)


def q_device_stream(spark: SparkSession, d: str) -> DataFrame:
    from skywatch.streaming.devices import run_device_state_stream
    return run_device_state_stream(spark, d)


def _prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, d: str) -> DataFrame:
        prepare_session(spark)
        return fn(spark, d)
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cdn_usage": q_cdn_usage,
    "object_usage": q_object_usage,
    "cdn_usage_files": q_cdn_usage_files,
    "object_usage_files": q_object_usage_files,
    "api_usage": q_api_usage,
    "api_usage_files": q_api_usage_files,
    "usage_all": q_usage_all,
    "usage_by_source": q_usage_by_source,
    "usage_landed": q_usage_landed,
    "log_group_errors": q_log_group_errors,
    "location_errors": q_location_errors,
    "ip_risk": q_ip_risk,
    "usage_rollup": q_usage_rollup,
    "usage_report": q_usage_report,
    "usage_detail": q_usage_detail,
    "report_ordered": q_report_ordered,
    "report_written": q_report_written,
    "tracked_resources": q_tracked_resources,
    "log_range_guard": q_log_range_guard,
    "login_filter": q_login_filter,
    "login_alerts": q_login_alerts,
    "login_alerts_files": q_login_alerts_files,
    "cred_rules": q_cred_rules,
    "cred_rules_files": q_cred_rules_files,
    "account_check": q_account_check,
    "drift_status": q_drift_status,
    "drift_status_files": q_drift_status_files,
    "device_issues": q_device_issues,
    "device_issues_files": q_device_issues_files,
    "device_latest": q_device_latest,
    "issue_states": q_issue_states,
    "issue_snapshot": q_issue_snapshot,
    "issue_message": q_issue_message,
    "issue_notify": q_issue_notify,
    "issue_lifecycle_stored": q_issue_lifecycle_stored,
    "store_round_trip": q_store_round_trip,
    "inventory_diff": q_inventory_diff,
    "inventory_counts": q_inventory_counts,
    "key_tree": q_key_tree,
    "key_listing": q_key_listing,
    "template_policies": q_template_policies,
    "asset_counts": q_asset_counts,
    "unique_lookup": q_unique_lookup,
    "deployed_stacks": q_deployed_stacks,
    "teardown_split": q_teardown_split,
    "teardown_tally": q_teardown_tally,
    "budget_alerts": q_budget_alerts,
    "upload_manifest": q_upload_manifest,
    "field_rows": q_field_rows,
    "login_stream": q_login_stream,
    "login_messages": q_login_messages,
    "device_stream": q_device_stream,
}
QUERIES = {name: _prepared(fn) for name, fn in QUERIES.items()}

