"""File readers A1-A8, A11 on small written fixtures."""

import gzip
import json

from pyspark.sql import functions as F

from skywatch.sources import logs, reports

CDN_HEADER = "#Version: 1.0\n#Fields: date time x-edge-location ...\n"


def cdn_line(date, ip, method, uri, status, result="Hit", c_port="443"):
    cols = [date, "10:00:00", "LHR", "123", ip, method, "h.example", uri, status, "-", "UA", "-", "-",
            "Hit", "rid", "h.example", "https", "45", "0.01", "-", "TLSv1.3", "C", "Hit", "HTTP/2.0", "-", "-",
            c_port, "0.01", result, "text/html", "10", "-", "-"]
    assert len(cols) == 33
    return "\t".join(cols) + "\n"


def test_cdn_reader_gzip_headers_and_dashes(spark, tmp_path):
    d = tmp_path / "bucket" / "stackA" / "siteB"
    d.mkdir(parents=True)
    with gzip.open(d / "E1.2024-01-10-10.abc.gz", "wt") as f:
        f.write(CDN_HEADER)
        f.write(cdn_line("2024-01-10", "1.1.1.1", "GET", "/a/b", "200"))
        f.write(cdn_line("2024-01-11", "2.2.2.2", "GET", "/favicon.ico", "200", c_port="-"))
    df = logs.read_cdn_logs(spark, str(tmp_path / "bucket" / "*" / "*"))
    rows = df.orderBy("date").collect()
    assert len(rows) == 2
    assert rows[0].logFolder == "stackA/siteB"
    assert rows[0].status == 200 and rows[0].c_port == 443
    assert rows[1].c_port is None  # '-' in an INT column
    assert rows[1].sc_range_start is None and rows[1].referrer == "-"  # '-' in text stays '-'


OBJ_FULL = ('79a5 bucket [06/Feb/2019:00:00:38 +0000] 192.0.2.3 arn:aws:iam::1:user/x 3E57 REST.GET.OBJECT '
            'key.txt "GET /key.txt HTTP/1.1" 200 - 113 - 7 - "-" "S3Console/0.4" - hostid SigV4 '
            'ECDHE-RSA QueryString bucket.s3.amazonaws.com TLSv1.2 - -')
OBJ_SHORT = ('79a5 bucket [06/Feb/2019:23:30:38 -0500] 192.0.2.4 - 3E58 REST.PUT.OBJECT '
             'key.txt "PUT /key.txt HTTP/1.1" 403 AccessDenied 243 - 7 - "-" "curl" -')
OBJ_QUOTED_REF = ('79a5 bucket [07/Feb/2019:00:00:38 +0000] 192.0.2.5 - 3E59 REST.GET.OBJECT k "GET /k HTTP/1.1" '
                  '200 - - 10 7 - "http://a b" "UA" - h SigV4 C QueryString ep TLS - -')


def test_object_log_parse(spark):
    lines = spark.createDataFrame([(OBJ_FULL,), (OBJ_SHORT,), ("not a log line",), (OBJ_QUOTED_REF,)], "value string")
    rows = logs.parse_object_log(lines).collect()
    full, short, junk, quoted = rows
    assert full.remoteip == "192.0.2.3" and full.authtype == "QueryString" and full.bytessent == 113
    assert full.objectsize is None  # '-' -> NULL
    assert short.authtype is None and short.hostid is None and short.httpstatus == "403"
    assert all(junk[c] is None for c in junk.__fields__)
    # the referrer group takes no spaces: such a line does not match at all, so
    # every column is NULL, as the regex SerDe gives
    assert all(quoted[c] is None for c in quoted.__fields__)


def test_object_usage_date_in_logged_offset(spark):
    from skywatch.operators.usage import object_usage
    lines = spark.createDataFrame([(OBJ_FULL,), (OBJ_SHORT.replace(" -\x00", ""),)], "value string")
    parsed = logs.parse_object_log(lines)
    got = object_usage(parsed, "2019-02-06", "2019-02-06").collect()
    assert [(r.request_ip, str(r.date), r["count"]) for r in got] == [("192.0.2.3", "2019-02-06", 1)]


def test_api_log_parse(spark):
    df = spark.createDataFrame([("1.2.3.4,GET /items,req1",), ("5.6.7.8,MESSAGE $default,req2",), ("junk",)],
                               "message string")
    rows = logs.parse_api_log(df).collect()
    assert (rows[0].sourceIp, rows[0].method, rows[0].path) == ("1.2.3.4", "GET", "/items")
    assert (rows[1].method, rows[1].path) == ("MESSAGE", "$default")
    assert rows[2].method is None


def test_credential_report_reader(spark, tmp_path):
    d = tmp_path / "reports" / "123456789012"
    d.mkdir(parents=True)
    (d / "report.csv").write_text(
        "user,arn,user_creation_time,password_enabled,password_last_used,password_last_changed,"
        "password_next_rotation,mfa_active,access_key_1_active,access_key_1_last_rotated,"
        "access_key_1_last_used_date,access_key_2_active,access_key_2_last_rotated,access_key_2_last_used_date\n"
        "<root_account>,arn:root,2020-01-01T00:00:00+00:00,not_supported,N/A,not_supported,not_supported,true,"
        "false,N/A,N/A,false,N/A,N/A\n")
    r = reports.read_credential_report(spark, str(tmp_path / "reports" / "*")).collect()
    assert r[0].accountId == "123456789012" and r[0].user == "<root_account>" and r[0].mfa_active == "true"


def test_tracked_resources_and_routing(spark):
    from skywatch import schemas
    out = lambda k, v: {"OutputKey": k, "OutputValue": v}
    stacks = spark.createDataFrame([
        ("a", "s1", "UPDATE_COMPLETE", False, [out("USAGETRACKINGweb", json.dumps({"name": "web", "source": "b", "type": "CloudFront", "splitReportingByUrlRoot": True})),
                                               out("Other", "x")]),
        ("a", "s2", "UPDATE_COMPLETE", False, None),
        ("a", "s3", "UPDATE_COMPLETE", False, [out("USAGETRACKINGq", json.dumps({"name": "q", "source": "g", "type": "Queue"}))]),
        ("a", "S 4", "UPDATE_COMPLETE", False, [out("USAGETRACKINGapi", json.dumps({"name": "Api-1", "source": "lg", "type": "S3AccessLogs"}))]),
    ], schemas.STACKS)
    r = {x.name: x for x in reports.route_resources(reports.tracked_resources(stacks)).collect()}
    assert set(r) == {"web", "q", "Api-1"}  # the stack without outputs disappears
    assert r["web"].route == "CloudFront" and r["web"].splitReportingByUrlRoot is True
    assert r["web"].table_name == "cloudfrontlogs_s1_web"
    assert r["q"].route == "error" and r["q"].table_name is None
    assert r["Api-1"].table_name == "s3accesslogs_s__4_api__1"  # G8: every other char -> '__'


def test_devices_reader(spark, tmp_path):
    p = tmp_path / "things.json"
    p.write_text(json.dumps({"things": [
        {"thingName": "t1", "thingId": "i1", "thingGroupNames": ["uptime-monitoring"], "connectivity": {"connected": False, "timestamp": 1700000000000}},
        {"thingName": "t2", "thingId": "i2", "connectivity": {"connected": False}}]}, indent=1))
    df = reports.read_devices(spark, str(p))
    assert df.count() == 2
    from skywatch.operators.devices import disconnected_devices
    got = disconnected_devices(df).collect()
    assert [g.pk for g in got] == ["t1"]
    assert got[0].text == "t1 (i1) was disconnected since Tue Nov 14 2023 22:13:20 GMT+0000 (Coordinated Universal Time)'"


def test_register_log_table(spark, tmp_path):
    d = tmp_path / "b" / "stk" / "res"
    d.mkdir(parents=True)
    (d / "x.tsv").write_text(CDN_HEADER + cdn_line("2024-01-10", "1.1.1.1", "GET", "/a/b", "200"))
    name = logs.register_log_table(spark, "cloudfrontlogs", "stk", "Res-1", str(d))
    assert name == "cloudfrontlogs_stk_res__1"
    assert spark.table(name).where(F.col("status") == 200).count() == 1


def test_landed_logs_prune_by_date(spark, tmp_path):
    import datetime as dt
    from skywatch.operators.usage import cdn_usage
    d = tmp_path / "bucket" / "stackA" / "siteB"
    d.mkdir(parents=True)
    (d / "x.tsv").write_text(CDN_HEADER + cdn_line("2024-01-10", "1.1.1.1", "GET", "/a/b", "200")
                             + cdn_line("2024-01-01", "2.2.2.2", "GET", "/a/b", "200"))
    raw = logs.read_cdn_logs(spark, str(tmp_path / "bucket" / "*" / "*"))
    out = str(tmp_path / "landed")
    logs.land_log_family(raw, out)
    landed = logs.read_landed(spark, out)
    q = cdn_usage(landed, dt.date(2024, 1, 10), dt.date(2024, 1, 17))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert [r.request_ip for r in q.collect()] == ["1.1.1.1"]


def test_object_and_api_log_files(spark, tmp_path):
    d = tmp_path / "logs" / "stk" / "bucketlog"
    d.mkdir(parents=True)
    (d / "2019-02-06-00-00-38-ABC").write_text(OBJ_FULL + "\n" + OBJ_SHORT + "\n")
    df = logs.read_object_access_logs(spark, str(tmp_path / "logs" / "*" / "*"))
    rows = {r.remoteip: r for r in df.collect()}
    assert rows["192.0.2.3"].logFolder == "stk/bucketlog" and rows["192.0.2.4"].errorcode == "AccessDenied"
    a = tmp_path / "api" / "stk" / "apilog"
    a.mkdir(parents=True)
    (a / "part.json").write_text(json.dumps({"timestamp": "2024-01-12T10:00:00Z", "message": "1.2.3.4,GET /x,r1"}) + "\n")
    api = logs.read_api_logs(spark, str(tmp_path / "api" / "*" / "*")).first()
    assert (api.logFolder, api.sourceIp, api.method, api.path) == ("stk/apilog", "1.2.3.4", "GET", "/x")


def test_template_map_explode_and_stacks_reader(spark, tmp_path):
    from skywatch import schemas
    from skywatch.operators import rules
    t = spark.createDataFrame([
        ("tpl", {"B": ("AWS::S3::Bucket", "Retain", None, "{}", {"aws:cdk:path": "tpl/B"})}),
        ("empty", {})], schemas.TEMPLATES)
    res = rules.explode_template(t)
    assert [(r.template, r.logicalId, r.Type) for r in res.collect()] == [("tpl", "B", "AWS::S3::Bucket")]
    got = sorted(r.attribute for r in rules.template_violations(res).collect())
    assert got == ["DeletionPolicy", "SSEAlgorithm"]  # a template without resources has no checks
    p = tmp_path / "stacks.json"
    p.write_text(json.dumps({"accountId": "a", "StackName": "s", "StackStatus": "CREATE_COMPLETE",
                             "EnableTerminationProtection": True, "Outputs": None}) + "\n")
    assert reports.read_stacks(spark, str(p)).first().EnableTerminationProtection is True


def test_credential_report_by_header_names(spark, tmp_path):
    d = tmp_path / "r" / "accountId=111"
    d.mkdir(parents=True)
    (d / "a.csv").write_text("arn,user,mfa_active,cert_1_active,password_enabled\narn:x,bob,false,false,true\n")
    r = reports.read_credential_report(spark, str(tmp_path / "r")).first()
    assert (r.accountId, r.user, r.arn, r.mfa_active, r.password_enabled) == ("111", "bob", "arn:x", "false", "true")
    assert r.access_key_1_active is None  # absent column -> NULL


def test_credential_reports_with_other_column_order(spark, tmp_path):
    """Each file's own header names its columns; quoted cells and blank lines are fine."""
    for account, text in (("1", "user,mfa_active,password_enabled\nann,true,false\n"), ("2", "password_enabled,user,x,mfa_active\r\ntrue,\"b, c\",y,false\r\n\r\n"), ("3", "user,mfa_active\n")):
        d = tmp_path / "r" / account
        d.mkdir(parents=True)
        (d / "report.csv").write_text(text)
    got = sorted((r.accountId, r.user, r.mfa_active, r.password_enabled) for r in reports.read_credential_report(spark, str(tmp_path / "r")).collect())
    assert got == [("1", "ann", "true", "false"), ("2", "b, c", "false", "true")]


def test_late_files_and_odd_cells_are_read(spark, tmp_path):
    """A file delivered after the window counts by its lines; a cell may begin with a quote; a line may hold the separator."""
    import datetime as dt

    from skywatch.operators.usage import object_usage
    d = tmp_path / "logs" / "stk" / "res"
    d.mkdir(parents=True)
    (d / "2019-02-09-00-00-00-LATE").write_text(OBJ_FULL + "\n")
    (d / "no-date").write_text(OBJ_FULL.replace("192.0.2.3", "192.0.2.\x013") + "\n")
    df = logs.read_object_access_logs(spark, str(tmp_path / "logs"))
    got = sorted((r.request_ip, r["count"]) for r in object_usage(df, dt.date(2019, 2, 5), dt.date(2019, 2, 6)).collect())
    assert got == [("192.0.2.\x013", 1), ("192.0.2.3", 1)]
    c = tmp_path / "cdn" / "stk" / "res"
    c.mkdir(parents=True)
    from skywatch import schemas
    cells = ["-"] * len(schemas.CDN_LOG.fields)
    text = [i for i, f in enumerate(schemas.CDN_LOG.fields) if f.dataType.simpleString() == "string"]
    cells[text[0]], cells[text[-1]] = '"open', "end"
    (c / "f").write_text("\t".join(cells) + "\n")
    row = logs.read_cdn_logs(spark, str(tmp_path / "cdn"), with_path=False).first()
    assert (row[text[0]], row[text[-1]]) == ('"open', "end")


def test_delivered_folder_layouts(spark, tmp_path):
    a = tmp_path / "api" / "stk" / "res"
    a.mkdir(parents=True)
    (a / "a.json").write_text(json.dumps({"timestamp": "2024-01-12T10:00:00Z", "message": "1.2.3.4,GET /x,r1"}) + "\n")
    assert logs.read_api_logs(spark, str(tmp_path / "api")).count() == 1


def test_credential_report_of_many_columns_and_quoted_line_breaks(spark, tmp_path):
    d = tmp_path / "r" / "111"
    d.mkdir(parents=True)
    head = [f"c{i}" for i in range(200)] + ["arn", "note", "user", "mfa_active", "user"]
    rows = [["x"] * 200 + ["arn:1", '"two\r\nlines, ""quoted"""', "old", "true", "bob"],
            [""] * 200 + ["arn:2", '""', "old", "false", '"a,b"'],
            ["x"] * 200 + ["arn:3", 'an 8" disk', "old", "", "carol"]]
    (d / "r.csv").write_text("﻿" + "\r\n".join(",".join(r) for r in [head, *rows]) + "\r\n\r\n", newline="")
    got = sorted((r.arn, r.user, r.mfa_active, r.password_enabled) for r in reports.read_credential_report(spark, str(tmp_path / "r")).collect())
    assert got == [("arn:1", "bob", "true", None), ("arn:2", "a,b", "false", None), ("arn:3", "carol", None, None)]
    cells = spark.createDataFrame([('"two\r\nlines, ""quoted""",,"",x\n\n  \ny,"z\n"',)], "t string") \
        .select(reports.csv_records(F.col("t")).alias("l")).select(F.transform("l", reports.csv_cells).alias("c")).first().c
    assert cells == [['two\r\nlines, "quoted"', "", "", "x"], ["y", "z\n"]]


def test_a_long_report_is_read_whole(spark, tmp_path):
    d = tmp_path / "r" / "7"
    d.mkdir(parents=True)
    (d / "r.csv").write_text("user,arn,note\n" + "".join(f'u{i},a{i},"{"line" * 50}\n{i}"\n' for i in range(3000)))
    df = reports.read_credential_report(spark, str(tmp_path / "r"))
    assert df.count() == 3000 == df.select("arn").distinct().count()


def test_landed_folders_of_other_resources_are_pruned(spark, tmp_path):
    rows = [(f"b{k}/web/site", f"10.0.0.{k}") for k in range(6)] + [("b1/web/site/2024", "10.0.1.1")]
    logs.land_log_family(spark.createDataFrame(rows, "logFolder string, request_ip string"), str(tmp_path / "landed"), date_col=None)
    res = spark.createDataFrame([("A", "web", "site", "b1", "CloudFront"), ("B", "web", "site", "b2", "S3AccessLogs")],
                                "accountId string, stackName string, name string, source string, type string")
    df = logs.read_tracked(spark, str(tmp_path / "landed"), res, "CloudFront")
    assert sorted(r.request_ip for r in df.collect()) == ["10.0.0.1", "10.0.1.1"]
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()


def test_a_report_record_carries_no_other_record(spark, tmp_path):
    """Where records are dealt out, a row holds the account and the columns' places, not the file's header or records."""
    import re
    d = tmp_path / "r" / "7"
    d.mkdir(parents=True)
    (d / "r.csv").write_text("arn,x,user\na1,1,u1\na2,2,u2\n")
    (tmp_path / "r" / "8").mkdir()
    (tmp_path / "r" / "8" / "r.csv").write_text("arn,x,user\n")
    df = reports.read_credential_report(spark, str(tmp_path / "r"))
    carried = re.search(r"Generate explode\w*\(\S+, \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString()).group(1)
    assert sorted(re.sub(r"#\d+", "", c) for c in carried.split(", ")) == ["accountId", "at"]
    assert sorted((r.accountId, r.user, r.arn) for r in df.collect()) == [("7", "u1", "a1"), ("7", "u2", "a2")]


def test_names_in_a_large_or_empty_folder(spark, tmp_path):
    from skywatch.sources import files
    want = sorted([f"logFolder=b%2Fs, {k} ü" for k in range(40)] + ["a\nb"])
    for n in want:
        (tmp_path / "f" / n).mkdir(parents=True)
    (tmp_path / "none").mkdir()
    calls, send = [], spark.sparkContext._gateway._gateway_client.send_command
    spark.sparkContext._gateway._gateway_client.send_command = lambda *a, **k: calls.append(a) or send(*a, **k)
    try:
        assert files.names(spark, str(tmp_path / "f")) == want
    finally:
        del spark.sparkContext._gateway._gateway_client.send_command
    assert len([c for c in calls if c[0][0] == "c"]) < 30  # method calls: not one for each name
    assert files.names(spark, str(tmp_path / "none")) == [] == files.names(spark, str(tmp_path / "missing"))


def _events(spark, path, n=60):
    import datetime as dt
    rows = [(k, k % 50 * 10, ["click", "signup"][k % 2], dt.datetime(2024, 1, 12) + dt.timedelta(minutes=k)) for k in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{path}/events.parquet")
    return str(path)


def _tasks(spark, run):
    """Tasks of each stage of the jobs that ``run`` starts."""
    import uuid
    group, sc = uuid.uuid4().hex, spark.sparkContext
    sc.setJobGroup(group, "counted")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    return [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]


def test_folders_are_listed_by_a_few_tasks(spark, tmp_path):
    from skywatch.session import LISTING_TASKS
    base, limit = tmp_path / "logs", 2 * max(spark.sparkContext.defaultParallelism, 8)
    for k in range(limit + 40):
        (base / "b" / "s" / f"r{k}").mkdir(parents=True)
        (base / "b" / "s" / f"r{k}" / "f.json").write_text('{"timestamp": "2024-01-12T10:00:00Z", "message": "1.2.3.4,GET /x,r1"}\n')
        (tmp_path / "landed" / f"logFolder=r{k}").mkdir(parents=True)
    spark.createDataFrame([(1,)], "x int").coalesce(1).write.mode("append").parquet(str(tmp_path / "landed" / "logFolder=r1"))
    before = spark.conf.get(LISTING_TASKS)
    for read, path in ((logs.read_cdn_logs, base), (logs.read_object_access_logs, base), (logs.read_api_logs, base), (logs.read_landed, tmp_path / "landed")):
        found = _tasks(spark, lambda: read(spark, str(path)))
        assert found and max(found) <= limit
    assert spark.conf.get(LISTING_TASKS) == before
    assert logs.read_api_logs(spark, str(base)).count() == limit + 40


def test_many_small_log_files_are_written_by_all_tasks(spark, tmp_path):
    """Files, not bytes, are the work: a coalesced shuffle would leave it to one task."""
    from skywatch.plans import shims
    d = _events(spark, tmp_path)
    for write, kind in ((shims.write_cdn_log_files, "cdn"), (shims.write_object_log_files, "object"), (shims.write_api_log_files, "api")):
        found = list((tmp_path / kind).rglob("part-*")) if write(spark, d, str(tmp_path / kind)) else []
        assert len({p.name.split("-")[1] for p in found}) > 1
        assert len(found) == len({p.parent for p in found})  # still a file per folder


def test_landing_again_replaces_the_folders_that_come(spark, tmp_path):
    out = str(tmp_path / "landed")
    land = lambda *rows: logs.land_log_family(spark.createDataFrame(rows, "logFolder string, request_ip string"), out, date_col=None)
    seen = lambda: sorted((r.logFolder, r.request_ip) for r in logs.read_landed(spark, out).collect())
    land(("b/a", "1"), ("b/c", "2"))
    assert seen() == [("b/a", "1"), ("b/c", "2")]
    land(("b/c", "3"), ("b/d", "4"))
    assert seen() == [("b/a", "1"), ("b/c", "3"), ("b/d", "4")]
