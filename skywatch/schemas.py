"""Explicit schemas of every input and intermediate shape.

No reader infers a schema: logs arrive in volume and a drifting inferred
type would silently change results.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DateType, DoubleType, FloatType,
                               IntegerType, LongType, MapType, StringType, StructField,
                               StructType, TimestampType)


def _s(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


# M1: CDN access log, tab separated, two '#' header lines.
CDN_LOG = StructType([
    StructField("date", DateType()),
    StructField("time", StringType()),
    StructField("location", StringType()),
    StructField("bytes", LongType()),
    StructField("request_ip", StringType()),
    StructField("method", StringType()),
    StructField("host", StringType()),
    StructField("uri", StringType()),
    StructField("status", IntegerType()),
    StructField("referrer", StringType()),
    StructField("user_agent", StringType()),
    StructField("query_string", StringType()),
    StructField("cookie", StringType()),
    StructField("result_type", StringType()),
    StructField("request_id", StringType()),
    StructField("host_header", StringType()),
    StructField("request_protocol", StringType()),
    StructField("request_bytes", LongType()),
    StructField("time_taken", FloatType()),
    StructField("xforwarded_for", StringType()),
    StructField("ssl_protocol", StringType()),
    StructField("ssl_cipher", StringType()),
    StructField("response_result_type", StringType()),
    StructField("http_version", StringType()),
    StructField("fle_status", StringType()),
    StructField("fle_encrypted_fields", IntegerType()),
    StructField("c_port", IntegerType()),
    StructField("time_to_first_byte", FloatType()),
    StructField("x_edge_detailed_result_type", StringType()),
    StructField("sc_content_type", StringType()),
    StructField("sc_content_len", LongType()),
    StructField("sc_range_start", LongType()),
    StructField("sc_range_end", LongType()),
])

# M2: object-store access log columns, in regex group order.
OBJECT_LOG_COLUMNS = [
    "bucketowner", "bucket_name", "requestdatetime", "remoteip", "requester", "requestid",
    "operation", "key", "request_uri", "httpstatus", "errorcode", "bytessent", "objectsize",
    "totaltime", "turnaroundtime", "referrer", "useragent", "versionid", "hostid", "sigv",
    "ciphersuite", "authtype", "endpoint", "tlsversion", "accesspointarn", "aclrequired",
]
OBJECT_LOG_BIGINT = {"bytessent", "objectsize"}
OBJECT_LOG = StructType([
    StructField(n, LongType() if n in OBJECT_LOG_BIGINT else StringType()) for n in OBJECT_LOG_COLUMNS
])

# M3: API access log record as exported from the log service.
API_LOG = StructType([StructField("timestamp", TimestampType()), StructField("message", StringType())])

# M4: audit trail document.
TRAIL_RECORD = StructType([
    StructField("eventVersion", StringType()),
    StructField("userIdentity", StructType(_s("type", "principalId", "arn", "accountId", "userName"))),
    StructField("eventTime", StringType()),
    StructField("eventSource", StringType()),
    StructField("eventName", StringType()),
    StructField("awsRegion", StringType()),
    StructField("sourceIPAddress", StringType()),
    StructField("userAgent", StringType()),
    StructField("requestParameters", StringType()),
    StructField("responseElements", StructType(_s("SwitchRole", "ConsoleLogin"))),
    StructField("additionalEventData",
                StructType(_s("SwitchFrom", "RedirectTo", "LoginTo", "MobileVersion", "MFAUsed"))),
    StructField("eventID", StringType()),
    StructField("eventType", StringType()),
    StructField("recipientAccountId", StringType()),
])
TRAIL_FILE = StructType([StructField("Records", ArrayType(TRAIL_RECORD))])

# M5: credential report; every cell is text.
CREDENTIAL_COLUMNS = [
    "user", "arn", "user_creation_time", "password_enabled", "password_last_used",
    "password_last_changed", "password_next_rotation", "mfa_active",
    "access_key_1_active", "access_key_1_last_rotated", "access_key_1_last_used_date",
    "access_key_2_active", "access_key_2_last_rotated", "access_key_2_last_used_date",
]
CREDENTIAL_REPORT = StructType(_s(*CREDENTIAL_COLUMNS))

# M6/M7: stacks with outputs; tracked resource JSON in an output value.
STACK_OUTPUT = StructType(_s("OutputKey", "OutputValue"))
STACKS = StructType([
    StructField("accountId", StringType()),
    StructField("StackName", StringType()),
    StructField("StackStatus", StringType()),
    StructField("EnableTerminationProtection", BooleanType()),
    StructField("Outputs", ArrayType(STACK_OUTPUT)),
])
TRACKED_RESOURCE = StructType([
    StructField("name", StringType()),
    StructField("source", StringType()),
    StructField("type", StringType()),
    StructField("splitReportingByUrlRoot", BooleanType()),
])

# M8: resource drift rows (only MODIFIED ones are read).
PROPERTY_DIFFERENCE = StructType(_s("PropertyPath", "ExpectedValue", "ActualValue", "DifferenceType"))
RESOURCE_DRIFT = StructType([
    StructField("accountId", StringType()),
    StructField("StackName", StringType()),
    StructField("LogicalResourceId", StringType()),
    StructField("ResourceType", StringType()),
    StructField("StackResourceDriftStatus", StringType()),
    StructField("PropertyDifferences", ArrayType(PROPERTY_DIFFERENCE)),
])
STACK_DRIFT = StructType(_s("accountId", "StackName", "StackStatus", "DetectionStatus", "StackDriftStatus"))

# M9: device search result.
DEVICE = StructType([
    StructField("thingName", StringType()),
    StructField("thingId", StringType()),
    StructField("thingGroupNames", ArrayType(StringType())),
    StructField("connectivity", StructType([
        StructField("connected", BooleanType()),
        StructField("timestamp", LongType()),
    ])),
])
DEVICE_SEARCH = StructType([StructField("things", ArrayType(DEVICE))])

# Issue rows and issue-store rows.
ISSUE_STORE = StructType(_s("monitor", "pk", "obj"))

# IP dimension.
IP_INFO = StructType(_s("ip", "country", "countryCode", "region", "city", "org"))

# Usage row, common to all three log families.
USAGE = StructType([
    StructField("accountId", StringType()),
    StructField("stackName", StringType()),
    StructField("stackResourceName", StringType()),
    StructField("date", StringType()),
    StructField("count", LongType()),
    StructField("event", StringType()),
    StructField("sourceIp", StringType()),
    StructField("geoBlocked", StringType()),
    StructField("uriRoot", StringType()),
])

# Template resources; free-form properties stay JSON text.
TEMPLATE_RESOURCE = StructType([
    StructField("Type", StringType()),
    StructField("DeletionPolicy", StringType()),
    StructField("UpdateReplacePolicy", StringType()),
    StructField("Properties", StringType()),
    StructField("Metadata", MapType(StringType(), StringType())),
])
TEMPLATES = StructType([
    StructField("template", StringType()),
    StructField("resources", MapType(StringType(), TEMPLATE_RESOURCE)),
])

# Object inventory.
INVENTORY = StructType(_s("side", "path"))

LOG_GROUPS = StructType([
    StructField("logGroupName", StringType()),
    StructField("creationTime", TimestampType()),
    StructField("retentionInDays", IntegerType()),
])
COSTS = StructType([StructField("month", DateType()), StructField("cost", DoubleType())])
UPLOAD_REQUESTS = StructType([
    StructField("request_id", StringType()),
    StructField("fileName", StringType()),
    StructField("prefixes", ArrayType(StringType())),
    StructField("ts", TimestampType()),
])
