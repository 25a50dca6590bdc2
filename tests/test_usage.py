"""Usage counting, risk descriptors, roll-up and report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skywatch.operators import attribution, iprisk, usage
from skywatch.plans import usage_report as ur

CDN_COLS = ("date date, request_ip string, method string, uri string, status int, "
            "x_edge_detailed_result_type string, logFolder string")


def cdn(spark, rows):
    return spark.createDataFrame(rows, CDN_COLS)


def test_cdn_usage_filters_and_roots(spark):
    d = dt.date
    rows = [(d(2024, 1, 10), "1.1.1.1", "GET", "/a/x", 200, "Hit", "src/s/r"),      # start day kept
            (d(2024, 1, 17), "1.1.1.1", "GET", "/a/y", 200, "Hit", "src/s/r"),      # partial "today" kept
            (d(2024, 1, 9), "1.1.1.1", "GET", "/a/x", 200, "Hit", "src/s/r"),       # before window
            (d(2024, 1, 12), "1.1.1.1", "GET", "/favicon.ico", 200, "Hit", "src/s/r"),
            (d(2024, 1, 12), "1.1.1.1", "GET", None, 200, "Hit", "src/s/r"),        # NULL uri dropped
            (d(2024, 1, 12), "2.2.2.2", "GET", "/index.html", 403, "ClientGeoBlocked", "src/s/r"),
            (d(2024, 1, 12), "2.2.2.2", "GET", "b/c", 200, "Hit", "src/s/r")]
    out = usage.cdn_usage(cdn(spark, rows), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 17)).collect()
    got = sorted(((str(r.date), r.request_ip, r.uriRoot, r.geoBlocked, r["count"]) for r in out), key=repr)
    assert got == sorted([("2024-01-10", "1.1.1.1", "a", None, 1), ("2024-01-12", "2.2.2.2", None, "GeoBlocked", 1),
                          ("2024-01-12", "2.2.2.2", "b", None, 1), ("2024-01-17", "1.1.1.1", "a", None, 1)], key=repr)


def resources(spark):
    return spark.createDataFrame(
        [("acc", "s", "r", "src", "CloudFront", True), ("acc", "s", "r2", "src", "CloudFront", None),
         ("acc", "s", "bad", "src", "Nope", None)],
        "accountId string, stackName string, name string, source string, type string, splitReportingByUrlRoot boolean")


def test_usage_rows_split_root_quirk(spark):
    d = dt.date(2024, 1, 12)
    rows = [(d, "1.1.1.1", "GET", "/index.html", 200, "Hit", "src/s/r"),
            (d, "1.1.1.1", "GET", "/app/x", 200, "Hit", "src/s/r2/2024/01")]
    u = usage.usage_rows(resources(spark), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 17), cdn=cdn(spark, rows))
    got = {r.stackResourceName: r for r in u.collect()}
    assert got["r"].uriRoot == ""          # split resource, NULL root -> ''
    assert got["r2"].uriRoot is None       # no split -> no root
    assert got["r"].event == "GET 200" and got["r"].date == "2024-01-12"
    titles = {r.title for r in usage.usage_rollup(u.withColumn("descriptor", u.sourceIp)).collect()}
    assert titles == {"acc / s / r / ", "acc / s / r2"}


def test_logs_belong_to_the_longest_registered_location(spark):
    d, w = dt.date(2024, 1, 12), (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 17))
    where = ["b1/web/site", "b2/web/site", "b2/web/site/2024", "b2/web/site/2024/01", "b2/web/sitemap", "b3/web/site", "b1/web", "b1/web/site/inner/x", None]
    rows = [(d, "1.1.1.1", "GET", "/a/x", 200, "Hit", f) for f in where for _ in range(1 + len(f or "") % 3)]
    res = spark.createDataFrame(
        [("A", "web", "site", "b1", "CloudFront", None), ("B", "web", "site", "b2", "CloudFront", None), ("C", "web", "site", "/b2/", "S3AccessLogs", None),
         ("D", "web", "site/inner", "b1", "CloudFront", None), ("E", "none", "x", "b9", "CloudFront", None)],
        "accountId string, stackName string, name string, source string, type string, splitReportingByUrlRoot boolean")
    got = {(r.accountId, r.stackResourceName): r["count"] for r in usage.usage_rows(res, *w, cdn=cdn(spark, rows)).collect()}
    n = lambda *fs: sum(1 + len(f) % 3 for f in fs)
    assert got == {("A", "site"): n("b1/web/site"), ("B", "site"): n("b2/web/site", "b2/web/site/2024", "b2/web/site/2024/01"),
                   ("D", "site/inner"): n("b1/web/site/inner/x")}
    # two resources at one location: listed, and the run fails
    twice = res.unionByName(res.where("accountId = 'A'").withColumn("accountId", F.lit("Z")))
    assert [(r.type, r.location, r.n_resources) for r in attribution.location_errors(twice).collect()] == [("CloudFront", "b1/web/site", 2)]
    with pytest.raises(Exception, match="2 resources keep their logs at 'b1/web/site'"):
        usage.usage_rows(twice, *w, cdn=cdn(spark, rows)).collect()


def test_watched_log_group_must_be_the_only_one(spark):
    now, w = dt.datetime(2024, 1, 17, 9), (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 17))
    res = spark.createDataFrame(
        [("A", "web", "api", "/http/one", "LogGroup", None), ("B", "web", "api", "/http/one", "LogGroup", None), ("A", "web", "late", "/late", "LogGroup", None)],
        "accountId string, stackName string, name string, source string, type string, splitReportingByUrlRoot boolean")
    schema = "accountId string, logGroupName string, creationTime timestamp, retentionInDays int"
    old, new = dt.datetime(2023, 1, 1), dt.datetime(2024, 2, 1)
    right = [("A", "/http/one", old, None), ("B", "/http/one", old, 30), ("A", "/late", new, None), ("C", "/http/one/two", old, None)]
    api = spark.createDataFrame([(dt.datetime(2024, 1, 12), "1.1.1.1", "GET", "/x", f) for f in ["A/http/one", "B/http/one", "B/http/one", "A/late", "C/http/one"]],
                                "timestamp timestamp, sourceIp string, method string, path string, logFolder string")
    run = lambda groups: usage.usage_rows(res, *w, api=api, log_groups=spark.createDataFrame(groups, schema), now=now)
    assert sorted((r.accountId, r.stackResourceName, r["count"]) for r in run(right).collect()) == [("A", "api", 1), ("B", "api", 2)]
    for groups, n in ((right[1:], 0), (right + [("A", "/http/one/more", old, None)], 2), (right + [right[0]], 2)):
        state = usage.log_group_state(res, spark.createDataFrame(groups, schema), w[1], now).where("error IS NOT NULL").collect()
        assert [(r.accountId, r.source, r.n_groups) for r in state] == [("A", "/http/one", n)] and not state[0].in_range
        with pytest.raises(Exception, match=f"{n} log groups named '/http/one' in account A, one expected"):
            run(groups).collect()


def test_log_range_guard(spark):
    g = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1), 30), ("b", dt.datetime(2024, 2, 1), None), ("c", dt.datetime(2023, 1, 1), None),
         ("d", dt.datetime(2023, 1, 1), 0), ("e", dt.datetime(2023, 1, 1), 30), ("e", dt.datetime(2023, 1, 1), 30)],
        "logGroupName string, creationTime timestamp, retentionInDays int")
    r = {x.logGroupName: x.in_range for x in usage.log_range_guard(
        g, dt.datetime(2024, 1, 17), dt.datetime(2024, 1, 17, 9)).collect()}
    assert r == {"a": True, "b": False, "c": True, "d": False, "e": False}


def test_risk_descriptor_and_report(spark):
    u = spark.createDataFrame(
        [("acc", "s", "r", "2024-01-12", 3, "GET 200", "1.1.1.1", "GeoBlocked", None),
         ("acc", "s", "r", "2024-01-12", 10, "GET 200", "2.2.2.2", None, None),
         ("acc", "s", "r", "2024-01-13", 2, "GET 200", "2.2.2.2", None, None),
         ("acc", "s", "r", "2024-01-13", 5, "GET 200", "9.9.9.9", None, None)],
        "accountId string, stackName string, stackResourceName string, date string, count bigint, "
        "event string, sourceIp string, geoBlocked string, uriRoot string")
    info = spark.createDataFrame(
        [("1.1.1.1", "Land", "HI", "Reg", "City", "AS123 Big Org"), ("2.2.2.2", "Home", "HO", None, "Town", "Small")],
        "ip string, country string, countryCode string, region string, city string, org string")
    enriched = ur.usage_enriched(u, info, ["HI"], ["HO"])
    desc = {r.sourceIp: (r.risk, r.descriptor) for r in enriched.collect()}
    assert desc["1.1.1.1"] == ("high", "high risk (GeoBlocked): Land (Big Org)")
    assert desc["2.2.2.2"] == ("low", "low risk: Home (Small)")
    assert desc["9.9.9.9"] == ("unknown", "9.9.9.9")
    errors = resources(spark).where("type = 'Nope'")
    text = ur.render(ur.report_lines(enriched, errors, 7))
    assert text.splitlines() == [
        "Usage info for the past 7 days:", "",
        "1.1.1.1: Land > Reg > City (AS123 Big Org) (high risk)",
        "2.2.2.2: Home > undefined > Town (Small) (low risk)", "",
        "acc / s / r", "9.9.9.9: 5", "high risk (GeoBlocked): Land (Big Org): 3", "low risk: Home (Small): 12", "",
        "errors: [", "  {", '    "name": "bad",', '    "source": "src",', '    "type": "Nope"', "  }", "]"]
    detail = sorted(r.line for r in ur.detail_lines(enriched).collect())
    assert detail[0] == "acc/s/r 2024-01-12 (10): GET 200, 2.2.2.2 (low ip risk)"
    assert "acc/s/r 2024-01-12 (3): GET 200, 1.1.1.1 (high ip risk, GeoBlocked)" in detail


def test_empty_usage_report(spark):
    u = spark.createDataFrame([], "accountId string, stackName string, stackResourceName string, date string, "
                                  "count bigint, event string, sourceIp string, geoBlocked string, uriRoot string")
    info = spark.createDataFrame([], "ip string, country string, countryCode string, region string, city string, org string")
    enriched = ur.usage_enriched(u, info, [], [])
    errors = spark.createDataFrame([], "name string, source string, type string, splitReportingByUrlRoot boolean")
    assert ur.render(ur.report_lines(enriched, errors, 7)).split("\n") == [
        "Usage info for the past 7 days:", "", "", "No usage found."]


def test_risk_class_null_country_is_medium(spark):
    df = spark.createDataFrame([(None,), ("X",), ("H",)], "countryCode string")
    got = [r[0] for r in df.select(iprisk.risk_class(df.countryCode, ["H"], ["L"])).collect()]
    assert got == ["medium", "medium", "high"]
