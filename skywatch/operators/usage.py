"""Usage counting and roll-up.

Plan shape at scale: every log family is filtered (date predicate pushed to
the scan) and *aggregated first* -- partial aggregation map-side collapses a
hot IP or resource before the shuffle -- and only the small aggregated rows
meet the tracked-resource table, by the folder their logs lie in. The roll-up (D4) is a second partial+final
aggregate. No step collects a group.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch import config
from skywatch.functions.scalars import first_path_segment, log_time_to_date
from skywatch.operators.attribution import FOLDER, attribute, registered
from skywatch.operators.constraints import guarded, matches
from skywatch.session import materialize


def _d(x) -> Column:
    if isinstance(x, dt.datetime):
        x = x.date()
    return F.lit(x)


def _ts(x) -> Column:
    return F.lit(x).cast("timestamp")


# ------------------------------------------------------------------ B2-B7, D1-D3

def cdn_usage(cdn: DataFrame, start, end, by_folder: bool = False) -> DataFrame:
    """Count CDN requests by status, date, ip, geo flag, method, URL root.

    B2 date window (both ends inclusive), B3 favicon exclusion (a NULL uri is
    dropped too, as in SQL), B4 geo flag, B5 URL root.
    """
    keys = [FOLDER] if by_folder else []
    return (cdn
            .where(F.col("date").between(_d(start), _d(end)) & (F.col("uri") != "/favicon.ico"))
            .select(*keys, "status", "date", "request_ip", "method",
                    F.when(F.col("x_edge_detailed_result_type") == "ClientGeoBlocked",
                           F.lit("GeoBlocked")).alias("geoBlocked"),
                    first_path_segment("uri").alias("uriRoot"))
            .groupBy(*keys, "status", "date", "request_ip", "geoBlocked", "method", "uriRoot")
            .agg(F.count(F.lit(1)).alias("count")))


def object_usage(objlog: DataFrame, start, end, by_folder: bool = False) -> DataFrame:
    """Signed requests (B6) by status, date (G2), ip, operation, in the window."""
    keys = [FOLDER] if by_folder else []
    return (objlog
            .where(F.col("authtype") == "QueryString")
            .select(*keys,
                    F.col("httpstatus").alias("status"),
                    log_time_to_date("requestdatetime").alias("date"),
                    F.col("remoteip").alias("request_ip"),
                    F.col("operation").alias("method"))
            .where(F.col("date").between(_d(start), _d(end)))
            .groupBy(*keys, "status", "date", "request_ip", "method")
            .agg(F.count(F.lit(1)).alias("count")))


def api_usage(api: DataFrame, start, end, by_folder: bool = False) -> DataFrame:
    """D3: API requests by ip, method, path and UTC day; connection events dropped.

    The log query runs between two instants, both included.
    """
    keys = [FOLDER] if by_folder else []
    return (api
            .where((F.col("timestamp") >= _ts(start)) & (F.col("timestamp") <= _ts(end)))
            .where(F.col("method") != "CONNECTION_API")
            .select(*keys, "sourceIp", "method", "path",
                    F.date_format(F.date_trunc("day", "timestamp"), "yyyy-MM-dd").alias("date"))
            .groupBy(*keys, "sourceIp", "method", "path", "date")
            .agg(F.count(F.lit(1)).alias("count")))


# ------------------------------------------------------------------ B8, C8, C9

def scope_accounts(resources: DataFrame, accounts: list[str] | None) -> DataFrame:
    """Keep only listed accounts (None = all). The list is config-sized."""
    if accounts is None:
        return resources
    return resources.where(F.col("accountId").isin(*accounts))


def _in_range(end, now) -> Column:
    end_c, now_c = _ts(end), _ts(now)
    oldest = now_c - F.make_dt_interval(days=F.col("retentionInDays"))
    return F.coalesce((end_c >= F.col("creationTime")) & (F.col("retentionInDays").isNull() | (end_c >= oldest)), F.lit(False))


def log_range_guard(groups: DataFrame, end, now) -> DataFrame:
    """Per log group, can the window ending at ``end`` hold entries?

    True when ``end`` is at or after the group's creation and at or after
    ``now - retention days``. NULL retention means unlimited (deviation: the
    reference compares against NaN and returns no rows). ``n_groups`` counts
    groups sharing the name: anything but 1 is an error (C7-style check).
    """
    counted = groups.groupBy("logGroupName").agg(
        F.count(F.lit(1)).alias("n_groups"), F.bool_and(_in_range(end, now)).alias("all_in_range"))
    return counted.select("logGroupName", "n_groups",
                          ((F.col("n_groups") == 1) & F.col("all_in_range")).alias("in_range"))


def log_group_state(resources: DataFrame, groups: DataFrame, end, now) -> DataFrame:
    """B8 per watched log group: (accountId, source, n_groups, in_range, error).

    A group is found by its name as a prefix within the account, and exactly one must be found; ``error`` says how many
    were where that fails. ``in_range`` as in :func:`log_range_guard`. Group names are short (512 characters at most),
    so their prefixes are exploded and equi-joined with the watched names."""
    wanted = resources.where(F.col("type") == config.TYPE_LOG_GROUP).select("accountId", "source").distinct()
    name = F.col("logGroupName")
    starts = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, F.lit(1), i))
    found = groups.where(F.length(name) > 0).select("accountId", F.explode(starts).alias("source"), _in_range(end, now).alias("_ok"))
    found = found.join(wanted, on=["accountId", "source"], how="left_semi")
    counted = matches(wanted, found, ["accountId", "source"], F.bool_and("_ok").alias("_ok"))
    return counted.select(
        "accountId", "source", F.col("n_matches").alias("n_groups"), ((F.col("n_matches") == 1) & F.col("_ok")).alias("in_range"),
        F.when(F.col("n_matches") != 1, F.format_string("%d log groups named '%s' in account %s, one expected", "n_matches", "source", "accountId")).alias("error"))


def usage_rows(resources: DataFrame, start, end,
               cdn: DataFrame | None = None, objlog: DataFrame | None = None,
               api: DataFrame | None = None, log_groups: DataFrame | None = None,
               api_end=None, now=None) -> DataFrame:
    """the three families normalised to one row shape (``schemas.USAGE``).

    B10 event label, B11 URL root kept only for resources that split by it
    (a NULL root becomes ``''``). The object family carries no geo flag. The
    log frames carry the folder of each row (``logFolder``); rows belong to the
    resource with the longest registered location around it (C9). With
    ``log_groups`` the API family is limited to groups passing B8, and a watched
    group that is missing or not the only one of its name fails the run. The
    tracked resources are checked and written at once, the logs read when the
    result is.
    """
    if log_groups is not None:
        state = log_group_state(resources, log_groups, api_end if api_end is not None else end, now if now is not None else end)
        open_groups = state.where(guarded(F.col("in_range"), F.col("error").isNull(), F.col("error"))).select("accountId", "source")
        watched = F.col("type") == config.TYPE_LOG_GROUP
        resources = resources.where(~watched).unionByName(resources.where(watched).join(open_groups, on=["accountId", "source"], how="left_semi"))
    owners = materialize(registered(resources), "tracked")  # one row per resource, read by each family
    parts = []
    # NULL result cells read as '' (as the reference reads them); one SQL
    # projection per family.
    if cdn is not None:
        a = attribute(cdn_usage(cdn, start, end, by_folder=True), owners, config.TYPE_CLOUDFRONT)
        parts.append(a.selectExpr(
            "accountId", "stackName", "stackResourceName", "date_format(date, 'yyyy-MM-dd') AS date", "count",
            "concat_ws(' ', coalesce(method, ''), coalesce(CAST(status AS STRING), '')) AS event",
            "request_ip AS sourceIp", "geoBlocked",
            "CASE WHEN _split THEN coalesce(uriRoot, '') END AS uriRoot"))
    if objlog is not None:
        a = attribute(object_usage(objlog, start, end, by_folder=True), owners, config.TYPE_S3_ACCESS_LOGS)
        parts.append(a.selectExpr(
            "accountId", "stackName", "stackResourceName", "date_format(date, 'yyyy-MM-dd') AS date", "count",
            "concat_ws(' ', coalesce(method, ''), coalesce(status, '')) AS event",
            "request_ip AS sourceIp", "CAST(NULL AS STRING) AS geoBlocked", "CAST(NULL AS STRING) AS uriRoot"))
    if api is not None:
        a = attribute(api_usage(api, start, api_end if api_end is not None else end, by_folder=True), owners, config.TYPE_LOG_GROUP)
        parts.append(a.selectExpr(
            "accountId", "stackName", "stackResourceName", "date", "count",
            "concat_ws(' ', coalesce(method, ''), coalesce(path, '')) AS event",
            "sourceIp", "CAST(NULL AS STRING) AS geoBlocked", "CAST(NULL AS STRING) AS uriRoot"))
    if not parts:
        raise ValueError("no log family given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ G7, D4

def report_title(accountId="accountId", stackName="stackName", resource="stackResourceName",
                 uriRoot="uriRoot") -> Column:
    """``account / stack / resource[ / uriRoot]`` (NULL root skipped, '' kept)."""
    return F.concat_ws(" / ", F.col(accountId), F.col(stackName), F.col(resource), F.col(uriRoot))


def usage_rollup(enriched: DataFrame) -> DataFrame:
    """Sum of counts per report title and IP descriptor (BIGINT).

    ``enriched`` carries ``descriptor`` (from :func:`skywatch.operators.iprisk.ip_descriptor`).
    """
    return (enriched
            .select(report_title().alias("title"), "descriptor", F.col("count").cast("bigint").alias("count"))
            .groupBy("title", "descriptor")
            .agg(F.sum("count").alias("total")))
