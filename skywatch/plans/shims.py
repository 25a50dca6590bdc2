"""Reference-shaped inputs derived from the driver tables (FIXTURES.md §3).

The driver tables hold no cloud logs, so each input is derived by fixed
expressions over a base table; the oracle SQL (``skywatch.plans.oracle``)
computes the expected result from the *base* columns directly, so the
parsing steps here are really exercised. No clock, no randomness: ``now``
values are literals. Every shim is a lazy projection of a full table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.session import write_tasks

NOW = dt.datetime(2024, 1, 17, 0, 0, 0)
DAYS = 7
ACCOUNTS = ["acct0", "acct1", "acct2"]
HIGH_RISK = ["C1", "C2"]
HOME = ["C3", "C4"]
IP_RANGES = ["10.0.0.0/24", "2001:db8::/124"]
CRED_NOW = dt.datetime(2001, 8, 2)
CRED_PREV_NOW = dt.datetime(2001, 6, 1)
MAX_AGE = 90
GUARD_END = dt.datetime(1998, 6, 1, 0, 0, 0)
GUARD_NOW = dt.datetime(1998, 6, 1, 6, 0, 0)
WARNING_BUDGET_CENTS = 5_000_000_000
MAX_BUDGET_CENTS = 6_000_000_000
UPLOAD_TS = dt.datetime(2024, 1, 17, 12, 0, 0)
BUCKET_PREFIX = "uploads"
SITE_PREFIX = "site"
EXPECTED_ASSETS = 3


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. The scan is created once per session and path and
    reused, as a catalog table handle would be: no repeated schema inference
    or file listing, and identical scans in one plan are shared.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    df = _TABLES.get(key)
    if df is None:
        df = _TABLES[key] = spark.read.parquet(path)
    return df


def _ev_ip() -> str:
    return "concat('10.0.', user_id % 4, '.', user_id)"


# Where an event's log line lies: stack and resource follow the user (ten to a resource), so their number grows with
# the table, and the same names occur in three buckets; some lines lie a folder deeper.
_EV_FOLDER = ("concat('bucket-', event_id % 3, '/stack', user_id DIV 10 % 9, '/r', user_id DIV 10, "
              "CASE WHEN event_id % 4 = 0 THEN '/2024' ELSE '' END) AS logFolder")
_EV_GROUP = "concat('acct', event_id % 4, '/http/', user_id DIV 10, '/access') AS logFolder"


# Each derivation is one SQL projection (``selectExpr``): the expression
# text is parsed once on the JVM side instead of being assembled from
# hundreds of single-function calls.

def cdn_logs(spark, d) -> DataFrame:
    """M1 rows from ``events`` (the CSV reader itself is tested on files)."""
    return table(spark, d, "events").selectExpr(
        "CAST(ts AS DATE) AS date",
        "date_format(ts, 'HH:mm:ss') AS time",
        f"{_ev_ip()} AS request_ip",
        "event_type AS method",
        "CASE WHEN event_id % 10 = 0 THEN 403 ELSE 200 END AS status",
        "CASE WHEN event_id % 10 = 0 THEN 'ClientGeoBlocked' ELSE 'Hit' END AS x_edge_detailed_result_type",
        "CASE WHEN event_id % 101 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 7 = 0 THEN '/favicon.ico' "
        "WHEN event_id % 5 = 0 THEN '/index.html' ELSE concat('/', event_type, '/', event_id % 3) END AS uri",
        _EV_FOLDER)


def object_log_lines(spark, d) -> DataFrame:
    """M2 as raw text lines from ``events``; some lines lack the optional
    fields, some are junk, some are logged at +0100."""
    head = ("concat('o b [', date_format(CASE WHEN event_id % 8 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END, "
            "'dd/MMM/yyyy:HH:mm:ss'), ' ', CASE WHEN event_id % 8 = 0 THEN '+0100' ELSE '+0000' END, '] 10.0.0.', "
            "user_id, ' r ', event_id, ' ', event_type, ' k \"GET /k HTTP/1.1\" ', "
            "CASE WHEN event_id % 10 = 0 THEN '403' ELSE '200' END, ' - 113 - 7 - \"-\" \"UA x\" -')")
    tail = "concat(' h SigV4 C ', CASE WHEN event_id % 3 = 0 THEN 'QueryString' ELSE '-' END, ' ep TLS - -')"
    return table(spark, d, "events").selectExpr(
        f"CASE WHEN event_id % 89 = 0 THEN 'junk line' WHEN event_id % 4 = 1 THEN {head} "
        f"ELSE concat({head}, {tail}) END AS value",
        _EV_FOLDER)


def api_log_records(spark, d) -> DataFrame:
    """M3 ``(timestamp, message)`` from ``events``, with web-socket and junk lines."""
    return table(spark, d, "events").selectExpr(
        "ts AS timestamp",
        f"CASE WHEN event_id % 83 = 0 THEN 'junk' "
        f"WHEN event_id % 9 = 0 THEN concat({_ev_ip()}, ',MESSAGE $default,', event_id) "
        f"ELSE concat({_ev_ip()}, ',', CASE WHEN event_type = 'signup' THEN 'CONNECTION_API' ELSE 'GET' END, "
        f"' /', event_type, ',', event_id) END AS message",
        _EV_GROUP)


_RTYPE = ("CASE WHEN p_size % 7 IN (0, 1) THEN 'CloudFront' WHEN p_size % 7 IN (2, 3) THEN 'S3AccessLogs' "
          "WHEN p_size % 7 IN (4, 5) THEN 'LogGroup' ELSE 'Unknown' END")


# Parts 2k and 2k + 1 register the same stack and resource name, in two accounts and two buckets.
_PK = "(p_partkey DIV 2)"
_GROUP = f"concat('/http/', {_PK}, '/access')"


def usage_resources(spark, d) -> DataFrame:
    """M7 tracked resources from ``part`` (one per part)."""
    return table(spark, d, "part").selectExpr(
        "concat('acct', p_partkey % 4) AS accountId", f"concat('stack', {_PK} % 9) AS stackName", f"concat('r', {_PK}) AS name",
        f"CASE WHEN p_size % 7 IN (4, 5) THEN {_GROUP} ELSE concat('bucket-', p_partkey % 3) END AS source", f"{_RTYPE} AS type",
        "CASE WHEN p_partkey % 2 = 0 THEN true END AS splitReportingByUrlRoot")


def api_log_groups(spark, d) -> DataFrame:
    """One log group per part, as :func:`usage_resources` names them; some are younger than the window's end."""
    return table(spark, d, "part").selectExpr(
        "concat('acct', p_partkey % 4) AS accountId", f"{_GROUP} AS logGroupName",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(p_partkey % 23) AS creationTime",
        "CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 5 END AS INT) AS retentionInDays")


def broken_log_groups(spark, d) -> DataFrame:
    """:func:`api_log_groups` with every 11th missing and every 13th beside another one whose name it begins."""
    whole = api_log_groups(spark, d).withColumn("k", F.split("logGroupName", "/")[2].cast("long"))
    kept = whole.where("k % 11 <> 0")
    return kept.unionByName(kept.where("k % 13 = 0").withColumn("logGroupName", F.concat("logGroupName", F.lit("-old")))).drop("k")


def crowded_resources(spark, d) -> DataFrame:
    """Resources of which several of one type keep their logs at one location: ten parts share stack and name, in two buckets."""
    return table(spark, d, "part").selectExpr(
        "concat('acct', p_partkey % 4) AS accountId", "concat('stack', p_partkey % 9) AS stackName", "concat('r', p_partkey DIV 90) AS name",
        "concat('bucket-', p_partkey % 2) AS source", f"{_RTYPE} AS type", "true AS splitReportingByUrlRoot")


def ip_info(spark, d) -> DataFrame:
    """M12 from ``events`` + ``nation`` + ``region``; some addresses unknown."""
    users = (table(spark, d, "events").where("user_id % 30 < 25")
             .selectExpr("user_id", "CAST(user_id % 30 AS INT) AS nk").distinct())
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    rows = users.join(n, F.col("nk") == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.selectExpr(
        f"{_ev_ip()} AS ip", "n_name AS country",
        "CASE WHEN user_id % 30 = 24 THEN CAST(NULL AS STRING) ELSE concat('C', n_nationkey) END AS countryCode",
        "r_name AS region", "concat('City', user_id % 7) AS city",
        "CASE WHEN user_id % 6 = 0 THEN concat('Org', user_id % 5) "
        "ELSE concat('AS', user_id, ' Org', user_id % 5) END AS org")


# ------------------------------------------------------------------ orders + part -> stacks

def stacks_with_outputs(spark, d) -> DataFrame:
    """M6 stacks from ``orders``; outputs from the ``part`` row keyed by ``o_custkey``."""
    o = table(spark, d, "orders")
    p = table(spark, d, "part")
    value = (f"to_json(named_struct('name', concat('r', p_partkey), 'source', concat('bucket-', p_partkey % 5), "
             f"'type', {_RTYPE}, 'splitReportingByUrlRoot', CASE WHEN p_partkey % 2 = 0 THEN true END))")
    key = "CASE WHEN p_partkey % 3 = 0 THEN concat('USAGETRACKING', p_partkey) ELSE concat('Other', p_partkey) END"
    outputs = (f"CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE array("
               f"named_struct('OutputKey', {key}, 'OutputValue', {value}), "
               f"named_struct('OutputKey', 'Endpoint', 'OutputValue', concat('https://', o_orderkey))) END")
    return o.join(p, o.o_custkey == p.p_partkey, "left").selectExpr(
        "o_orderpriority AS accountId", "concat('stack', o_orderkey) AS StackName",
        "'UPDATE_COMPLETE' AS StackStatus", "o_orderkey % 4 = 0 AS EnableTerminationProtection",
        f"{outputs} AS Outputs")


def log_groups(spark, d) -> DataFrame:
    """Log-group metadata from ``orders``; some names repeat, some retentions are NULL."""
    return table(spark, d, "orders").selectExpr(
        "CASE WHEN o_orderkey % 50 = 1 THEN concat('lg', o_orderkey - 1) ELSE concat('lg', o_orderkey) END "
        "AS logGroupName",
        "CAST(o_orderdate AS TIMESTAMP) AS creationTime",
        "CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 1000 END AS INT) AS retentionInDays")


def deploy_stacks(spark, d) -> DataFrame:
    """Stacks per profile (B39) and tear-down inputs (B32, D7) from ``orders``."""
    return table(spark, d, "orders").selectExpr(
        "concat(lower(replace(o_orderpriority, ' ', '')), "
        "CASE WHEN o_orderkey % 2 = 0 THEN '-developer' ELSE '-admin' END) AS profile",
        "CASE WHEN o_orderkey % 1000 = 0 THEN 'CDKToolkit' ELSE concat('stack', o_orderkey) END AS StackName",
        "CASE o_orderstatus WHEN 'F' THEN 'CREATE_COMPLETE' WHEN 'O' THEN 'DELETE_COMPLETE' "
        "ELSE 'UPDATE_COMPLETE' END AS StackStatus",
        "o_orderkey % 4 = 0 AS EnableTerminationProtection",
        "CASE o_orderstatus WHEN 'F' THEN 'DELETE_COMPLETE' WHEN 'O' THEN 'DELETE_FAILED' END AS deleteResult")


# ------------------------------------------------------------------ events -> audit trail

def trail_records(spark, d) -> DataFrame:
    """M4 records from ``events`` with the edge cases of FIXTURES §1."""
    name = ("CASE WHEN event_id % 11 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 7 = 0 THEN 'CheckMfa' "
            "WHEN event_id % 2 = 0 THEN 'SwitchRole' ELSE 'ConsoleLogin' END")
    result = ("CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 5 = 1 THEN 'Failure' "
              "ELSE 'Success' END")
    is_switch = f"coalesce(({name}) = 'SwitchRole', false)"
    return table(spark, d, "events").selectExpr(
        "'1.05' AS eventVersion",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE named_struct("
        "'type', CASE WHEN user_id % 2 = 0 THEN 'IAMUser' ELSE 'AssumedRole' END, "
        "'principalId', concat('p', user_id), 'arn', concat('arn:aws:iam::', user_id), "
        "'accountId', concat('a', user_id % 4), 'userName', concat('u', user_id)) END AS userIdentity",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS eventTime",
        "CASE WHEN event_type <> 'view' THEN 'signin.amazonaws.com' ELSE 'other' END AS eventSource",
        f"{name} AS eventName",
        "'us-east-1' AS awsRegion",
        "CASE WHEN event_id % 23 = 0 THEN 'signin.amazonaws.com' "
        "WHEN event_id % 29 = 0 THEN concat('::ffff:10.0.0.', user_id) "
        "WHEN event_id % 31 = 0 THEN concat('2001:db8::', user_id) "
        "ELSE concat('10.0.', user_id % 3, '.', user_id) END AS sourceIPAddress",
        "concat('agent-', event_type) AS userAgent",
        "CAST(NULL AS STRING) AS requestParameters",
        f"CASE WHEN event_id % 13 = 3 THEN NULL ELSE named_struct("
        f"'SwitchRole', CASE WHEN {is_switch} THEN {result} END, "
        f"'ConsoleLogin', CASE WHEN NOT {is_switch} THEN {result} END) END AS responseElements",
        "CASE WHEN event_id % 19 = 0 THEN NULL ELSE named_struct("
        "'SwitchFrom', concat('arn:from:', user_id), 'RedirectTo', CAST(NULL AS STRING), "
        "'LoginTo', CAST(NULL AS STRING), 'MobileVersion', 'No', 'MFAUsed', 'Yes') END AS additionalEventData",
        "CAST(event_id AS STRING) AS eventID",
        "CASE WHEN event_type = 'error' THEN 'AwsApiCall' ELSE 'AwsConsoleSignIn' END AS eventType",
        "concat('acct', user_id % 4) AS recipientAccountId")


# ------------------------------------------------------------------ customer + orders -> credentials

def credential_report(spark, d, mfa_above: int = 5000) -> DataFrame:
    """M5 rows from ``customer`` with the latest order date as every credential date."""
    c = table(spark, d, "customer")
    latest = (table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
              .agg(F.max("o_orderdate").alias("latest")))
    date = "coalesce(date_format(latest, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\"), 'N/A')"
    tf = lambda cond: f"CASE WHEN {cond} THEN 'true' ELSE 'false' END"
    return c.join(latest, on="c_custkey", how="left").selectExpr(
        "CAST(c_nationkey AS STRING) AS accountId",
        "CASE WHEN c_custkey % 50 = 0 THEN '<root_account>' ELSE c_name END AS user",
        "concat('arn:', c_custkey) AS arn",
        f"{tf('c_custkey % 2 = 0')} AS password_enabled", f"{date} AS password_last_changed",
        f"{tf(f'c_acctbal > {mfa_above}')} AS mfa_active",
        f"{tf('c_custkey % 3 = 0')} AS access_key_1_active", f"{date} AS access_key_1_last_rotated",
        f"{tf('c_custkey % 5 = 0')} AS access_key_2_active", f"{date} AS access_key_2_last_rotated")


def accounts(spark, d) -> DataFrame:
    return table(spark, d, "nation").selectExpr("CAST(n_nationkey AS STRING) AS accountId")


# ------------------------------------------------------------------ lineitem + orders -> drift

def drift_stacks(spark, d) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS stackKey", "o_orderpriority AS accountId", "concat('stack', o_orderkey) AS StackName",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'DELETE_COMPLETE' WHEN o_orderkey % 17 = 0 THEN 'ROLLBACK_COMPLETE' "
        "WHEN o_orderkey % 19 = 0 THEN 'IMPORT_COMPLETE' ELSE 'UPDATE_COMPLETE' END AS StackStatus",
        "'DETECTION_COMPLETE' AS DetectionStatus",
        "CASE WHEN o_orderkey % 23 = 0 THEN 'NOT_CHECKED' WHEN o_orderstatus = 'F' THEN 'DRIFTED' "
        "WHEN o_orderstatus = 'O' THEN 'UNKNOWN' ELSE 'IN_SYNC' END AS StackDriftStatus")


_DIFFS = "array<struct<PropertyPath:string,ExpectedValue:string,ActualValue:string,DifferenceType:string>>"


def resource_drifts(spark, d, lines: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Resource drifts from ``lineitem`` (or ``lines``, rows of it with further columns, of which ``keep`` stay)."""
    diff = ("named_struct("
            "'PropertyPath', CASE l_linenumber % 4 WHEN 0 THEN '/Tags' WHEN 1 THEN '/Body' "
            "WHEN 2 THEN '/IntegrationUri' ELSE '/Targets/0/RetryPolicy' END, "
            "'ExpectedValue', '{\"MaximumRetryAttempts\":1}', "
            "'ActualValue', CASE WHEN l_partkey % 97 = 0 THEN CAST(NULL AS STRING) "
            "WHEN l_linestatus = 'F' THEN 'null' ELSE 'x' END, "
            "'DifferenceType', 'NOT_EQUAL')")
    return (table(spark, d, "lineitem") if lines is None else lines).selectExpr(
        *keep, "l_orderkey AS stackKey", "concat('res', l_linenumber) AS LogicalResourceId",
        "CASE l_returnflag WHEN 'A' THEN 'AWS::Events::Rule' WHEN 'R' THEN 'AWS::ApiGatewayV2::Api' "
        "ELSE 'AWS::ApiGatewayV2::Integration' END AS ResourceType",
        "'MODIFIED' AS StackResourceDriftStatus",
        f"CASE WHEN l_linenumber = 7 THEN CAST(array() AS {_DIFFS}) ELSE array({diff}) END AS PropertyDifferences")


# ------------------------------------------------------------------ supplier / events -> devices

def devices(spark, d) -> DataFrame:
    return table(spark, d, "supplier").selectExpr(
        "concat('thing', s_suppkey) AS thingName", "concat('id', s_suppkey) AS thingId",
        "CASE WHEN s_suppkey % 5 = 0 THEN CAST(NULL AS ARRAY<STRING>) "
        "WHEN s_suppkey % 2 = 0 THEN array('uptime-monitoring', 'x') ELSE array('x') END AS thingGroupNames",
        "named_struct('connected', s_acctbal > 1000, 'timestamp', "
        "CASE WHEN s_suppkey % 7 = 0 THEN CAST(NULL AS BIGINT) ELSE 1700000000000 + s_suppkey * 1000 END) "
        "AS connectivity")


def device_events(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "user_id AS thing", "ts", "event_id", "event_type IN ('click', 'view', 'signup') AS connected")


# ------------------------------------------------------------------ pages -> inventory

def page_paths(spark, d) -> DataFrame:
    return table(spark, d, "pages").selectExpr(
        "page_id", "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '[?#].*$', '') AS path")


def remote_keys(spark, d) -> DataFrame:
    """Every page; those of an older name are not in the local tree."""
    return page_paths(spark, d).selectExpr(f"concat('{SITE_PREFIX}/', CASE WHEN page_id % 4 = 0 THEN concat('old/', path) ELSE path END) AS key")


def local_paths(spark, d) -> DataFrame:
    """Every page; those of a newer name are not remote yet."""
    return page_paths(spark, d).selectExpr("CASE WHEN page_id % 3 = 0 THEN concat('new/', path) ELSE path END AS path")


# ------------------------------------------------------------------ part -> templates

def template_resources(spark, d) -> DataFrame:
    bucket = ("CASE WHEN p_size > 10 THEN concat('{\"BucketEncryption\":{\"ServerSideEncryptionConfiguration\":"
              "[{\"ServerSideEncryptionByDefault\":{\"SSEAlgorithm\":\"', "
              "CASE WHEN p_size > 40 THEN 'aws:kms' ELSE 'AES256' END, '\"}}]}}') ELSE '{}' END")
    policy = ("CASE WHEN p_size % 5 = 0 THEN '{\"Description\":\"\"}' WHEN p_size % 5 = 1 THEN '{}' "
              "ELSE concat('{\"Description\":\"policy ', p_partkey, '\"}') END")
    function = ("to_json(named_struct('Handler', CASE WHEN p_size % 9 = 0 THEN 'framework.onEvent' "
                "ELSE 'index.handler' END, 'Code', named_struct('S3Key', CASE WHEN p_size % 11 = 0 "
                "THEN CAST(NULL AS STRING) ELSE concat('asset', p_partkey, '.zip') END)))")
    return table(spark, d, "part").selectExpr(
        "p_brand AS template", "concat('Res', p_partkey) AS logicalId",
        "CASE p_partkey % 4 WHEN 0 THEN 'AWS::S3::Bucket' WHEN 1 THEN 'AWS::IAM::ManagedPolicy' "
        "WHEN 2 THEN 'AWS::SecretsManager::Secret' ELSE 'AWS::Lambda::Function' END AS Type",
        "CASE p_size % 3 WHEN 1 THEN 'Delete' WHEN 2 THEN 'Retain' END AS DeletionPolicy",
        "CASE p_size % 4 WHEN 1 THEN 'Delete' WHEN 2 THEN 'Snapshot' END AS UpdateReplacePolicy",
        f"CASE p_partkey % 4 WHEN 0 THEN {bucket} WHEN 1 THEN {policy} WHEN 2 THEN '{{}}' "
        f"ELSE {function} END AS Properties",
        "concat(p_brand, '/', p_name) AS path",
        "CASE WHEN p_partkey % 7 <> 0 THEN concat('phys-', p_partkey) END AS physicalId")


def template_lookups(spark, d) -> DataFrame:
    """Every part is looked up, some under a name that does not exist."""
    return table(spark, d, "part").selectExpr(
        "p_brand AS template", "concat(p_brand, '/', p_name, CASE WHEN p_partkey % 10 = 1 THEN '-missing' ELSE '' END) AS path").distinct()


# ------------------------------------------------------------------ orders -> costs; documents -> requests

def monthly_costs(spark, d) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS month",
        "CAST(round(o_totalprice * 100) AS BIGINT) AS cost_cents")


def upload_requests(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS request_id",
        "CASE WHEN doc_id % 13 = 0 THEN CAST(NULL AS STRING) ELSE concat(source, ' (', doc_id, ')!.txt') END "
        "AS fileName",
        "CASE doc_id % 3 WHEN 0 THEN CAST(NULL AS ARRAY<STRING>) WHEN 1 THEN CAST(array() AS ARRAY<STRING>) "
        "ELSE array(lang) END AS prefixes",
        f"TIMESTAMP '{UPLOAD_TS:%Y-%m-%d %H:%M:%S}' AS ts")


def event_fields(spark, d) -> DataFrame:
    f = lambda n, v: f"named_struct('field', '{n}', 'value', CAST({v} AS STRING))"
    return table(spark, d, "events").selectExpr(
        "event_id",
        f"CASE WHEN event_id % 2 = 0 THEN array({f('type', 'event_type')}, {f('user', 'user_id')}, "
        f"{f('type', 'upper(event_type)')}) ELSE array({f('type', 'event_type')}, {f('user', 'user_id')}) END "
        "AS fields")


# ------------------------------------------------------------------ log files written from the shims

CDN_HEADER = ["#Version: 1.0", "#Fields: date time x-edge-location sc-bytes c-ip cs-method ..."]


_FOLDERS = ["bucket", "stack", "resource", "year"]


def _by_folder(rows: DataFrame) -> DataFrame:
    """``logFolder`` as columns to partition by; the last is empty where the file lies a folder higher."""
    steps = F.split("logFolder", "/")
    return rows.select("*", *[F.coalesce(F.get(steps, F.lit(i)), F.lit("-")).alias(c) for i, c in enumerate(_FOLDERS)]).drop("logFolder")


def write_cdn_log_files(spark, d, base: str) -> str:
    """Write the CDN shim as gzip TSV files laid out ``<base>/<bucket>/<stack>/<resource>/[<year>/]``
    with the two ``#`` header lines per folder, as the CDN delivers them."""
    rows = cdn_logs(spark, d)
    cols = [f.name for f in __import__("skywatch.schemas", fromlist=["CDN_LOG"]).CDN_LOG.fields]
    have = set(rows.columns)
    # a NULL cell is written empty (read back as NULL); fields the shim has no
    # value for are '-', as in delivered logs
    cells = [f"coalesce(CAST(`{c}` AS STRING), '')" if c in have else "'-'" for c in cols]
    lines = rows.selectExpr("logFolder", f"concat_ws('\t', {', '.join(cells)}) AS value")
    heads = (rows.select("logFolder").distinct()
             .selectExpr("logFolder", f"explode(array({', '.join(repr(h) for h in CDN_HEADER)})) AS value"))
    (_by_folder(heads.unionByName(lines)).repartition(write_tasks(spark), *_FOLDERS).sortWithinPartitions(*_FOLDERS, F.expr("CASE WHEN startswith(value, '#') THEN 0 ELSE 1 END"))
     .write.mode("overwrite").option("compression", "gzip").partitionBy(*_FOLDERS).text(base))
    return base


def write_object_log_files(spark, d, base: str) -> str:
    """Write the object-log shim lines as gzip text files per folder."""
    (_by_folder(object_log_lines(spark, d)).repartition(write_tasks(spark), *_FOLDERS).write.mode("overwrite").option("compression", "gzip")
     .partitionBy(*_FOLDERS).text(base))
    return base


def write_api_log_files(spark, d, base: str) -> str:
    """Write the API-log shim as gzip JSON lines per account and log group."""
    (_by_folder(api_log_records(spark, d)).repartition(write_tasks(spark), *_FOLDERS).write.mode("overwrite").option("compression", "gzip")
     .partitionBy(*_FOLDERS).json(base))
    return base


def write_trail_files(spark, d, base: str, records_per_file: int = 250) -> str:
    """Trail documents (bounded groups of records) as gzip JSON lines."""
    recs = trail_records(spark, d)
    docs = (recs.withColumn("doc", F.floor(F.col("eventID").cast("bigint") / records_per_file))
            .groupBy("doc").agg(F.collect_list(F.struct(*recs.columns)).alias("Records")))
    docs.select("Records").write.mode("overwrite").option("compression", "gzip").json(base)
    return base


def write_credential_reports(spark, d, base: str, records_per_file: int = 10_000) -> str:
    """Credential-report CSVs (with header, of bounded length) per account folder, in which the columns that count stand behind a hundred
    others and a quoted note of two lines with commas and quotes."""
    rep = credential_report(spark, d)
    others = [F.lit(str(i)).alias(f"other_{i}") for i in range(100)]
    note = F.concat(F.lit('said "no,'), F.lit("\n"), F.lit('never", '), F.col("user")).alias("note")
    (rep.select("accountId", *others, note, *[c for c in rep.columns if c != "accountId"])
     .write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", records_per_file).partitionBy("accountId").csv(base))
    return base


def write_drift_results(spark, d, base: str) -> str:
    """Stack drift summaries and resource drifts as gzip JSON lines, in the
    reader's schema: resource drifts carry the account and the stack *name*."""
    drift_stacks(spark, d).drop("stackKey").write.mode("overwrite").option("compression", "gzip").json(f"{base}/stacks")
    owner = drift_stacks(spark, d).select("stackKey", "accountId")
    lines = table(spark, d, "lineitem").join(owner, F.col("l_orderkey") == F.col("stackKey")).drop("stackKey")  # while the rows are narrow
    (resource_drifts(spark, d, lines, keep=("accountId",)).selectExpr("accountId", "concat('stack', stackKey) AS StackName", "LogicalResourceId",
                                          "ResourceType", "StackResourceDriftStatus", "PropertyDifferences")
     .write.mode("overwrite").option("compression", "gzip").json(f"{base}/drifts"))
    return base


def write_device_searches(spark, d, base: str, things_per_file: int = 20) -> str:
    """Device search results ``{"things": [...]}``, one bounded document per file."""
    dv = table(spark, d, "supplier").select(
        F.floor(F.col("s_suppkey") / things_per_file).alias("page"), "s_suppkey")
    docs = (devices(spark, d).join(dv.selectExpr("page", "concat('thing', s_suppkey) AS thingName"), "thingName")
            .groupBy("page").agg(F.collect_list(F.struct("thingName", "thingId", "thingGroupNames",
                                                         "connectivity")).alias("things")))
    docs.write.mode("overwrite").partitionBy("page").json(base)
    return base
