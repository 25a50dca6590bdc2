"""End-to-end job runs over files (the reference's scheduled tasks)."""

import datetime as dt
import gzip
import json
import pathlib

from skywatch.config import Params
from skywatch.plans import jobs
from skywatch.session import checkpoint_dir
from tests.test_readers import CDN_HEADER, cdn_line


def test_usage_report_job(spark, tmp_path):
    stacks = tmp_path / "stacks.json"
    stacks.write_text("\n".join(json.dumps(x) for x in [
        {"accountId": "111", "StackName": "web", "StackStatus": "UPDATE_COMPLETE", "Outputs": [
            {"OutputKey": "USAGETRACKINGsite", "OutputValue": json.dumps({"name": "site", "source": "b", "type": "CloudFront",
                                                                         "splitReportingByUrlRoot": True})},
            {"OutputKey": "USAGETRACKINGq", "OutputValue": json.dumps({"name": "q", "source": "b", "type": "Queue"})}]},
        {"accountId": "999", "StackName": "other", "StackStatus": "UPDATE_COMPLETE", "Outputs": None}]))
    d = tmp_path / "cdn" / "b" / "web" / "site"
    d.mkdir(parents=True)
    with gzip.open(d / "E1.2024-01-13-00.abc.gz", "wt") as f:
        f.write(CDN_HEADER + cdn_line("2024-01-12", "1.1.1.1", "GET", "/app/x", "200")
                + cdn_line("2024-01-13", "1.1.1.1", "GET", "/app/y", "200")
                + cdn_line("2024-01-13", "2.2.2.2", "GET", "/favicon.ico", "200"))
    spark.createDataFrame([("1.1.1.1", "Home", "HO", "R", "C", "AS1 Net")],
                          "ip string, country string, countryCode string, region string, city string, org string"
                          ).write.parquet(str(tmp_path / "ipinfo"))
    params = Params(now=dt.datetime(2024, 1, 17, 9), days=7, home_countries=["HO"], accounts=["111"])
    out = str(tmp_path / "out")
    scratch = len(list(pathlib.Path(checkpoint_dir(spark).removeprefix("file:")).iterdir()))
    res = jobs.usage_report_job(spark, params, str(stacks), str(tmp_path / "ipinfo"), out, "inv-9",
                                cdn_path=str(tmp_path / "cdn"))
    assert res == {"usage_rows": 2}
    assert len(list(pathlib.Path(checkpoint_dir(spark).removeprefix("file:")).iterdir())) == scratch  # nothing is left behind
    text = "".join(open(f).read() for f in sorted((tmp_path / "out" / "report").glob("part-*"))).splitlines()
    assert text == ["Usage info for the past 7 days:", "1.1.1.1: Home > R > C (AS1 Net) (low risk)",
                    "111 / web / site / app", "low risk: Home (Net): 2",
                    'errors: {"name":"q","source":"b","type":"Queue"}']
    assert spark.read.json(f"{out}/notifications").first().invocation_id == "inv-9"


def test_check_jobs(spark, tmp_path):
    params = Params(now=dt.datetime(2024, 3, 1), max_credential_age=90)
    rep = tmp_path / "reports" / "111"
    rep.mkdir(parents=True)
    (rep / "r.csv").write_text("user,arn,password_enabled,mfa_active,access_key_1_active,access_key_2_active\n"
                               "<root_account>,arn:root,not_supported,false,false,false\n")
    c = jobs.credential_check_job(spark, str(tmp_path / "reports"), ["111", "222"], str(tmp_path / "store"),
                                  str(tmp_path / "sink"), params, "cred-1")
    assert c == {"raised": 2, "existing": 0, "fixed": 0}  # root MFA off; account 222 has no root row
    (tmp_path / "s.json").write_text(json.dumps({"accountId": "111", "StackName": "s1", "StackStatus": "UPDATE_COMPLETE",
                                                 "DetectionStatus": "DETECTION_COMPLETE", "StackDriftStatus": "DRIFTED"}))
    (tmp_path / "d.json").write_text(json.dumps({"accountId": "111", "StackName": "s1", "LogicalResourceId": "x", "ResourceType": "AWS::SQS::Queue",
                                                 "StackResourceDriftStatus": "MODIFIED", "PropertyDifferences": [
                                                     {"PropertyPath": "/Delay", "ExpectedValue": "1", "ActualValue": "2"}]}))
    dr = jobs.drift_check_job(spark, str(tmp_path / "s.json"), str(tmp_path / "d.json"), str(tmp_path / "store"),
                              str(tmp_path / "sink"), params, "drift-1")
    assert dr == {"raised": 1, "existing": 0, "fixed": 0}
    (tmp_path / "dev.json").write_text(json.dumps({"things": [
        {"thingName": "t1", "thingId": "i1", "thingGroupNames": ["uptime-monitoring"],
         "connectivity": {"connected": False, "timestamp": 0}}]}))
    up = jobs.uptime_check_job(spark, str(tmp_path / "dev.json"), str(tmp_path / "store"), str(tmp_path / "sink"),
                               params, "up-1")
    assert up == {"raised": 1, "existing": 0, "fixed": 0}
    from skywatch.sources import store
    monitors = sorted(r.monitor for r in store.read_issues(spark, str(tmp_path / "store")).collect())
    assert monitors == ["cfn-drift-checker", "iam-checker", "iam-checker", "uptime-checker"]


def test_teardown_and_sync_jobs(spark, tmp_path):
    (tmp_path / "stacks.json").write_text("\n".join(json.dumps(x) for x in [
        {"StackName": "CDKToolkit", "EnableTerminationProtection": False},
        {"StackName": "keep", "EnableTerminationProtection": True},
        {"StackName": "a", "EnableTerminationProtection": False},
        {"StackName": "b", "EnableTerminationProtection": False}]))
    (tmp_path / "res.json").write_text(json.dumps({"StackName": "a", "deleteResult": "DELETE_COMPLETE"}))
    t = jobs.teardown_report_job(spark, str(tmp_path / "stacks.json"), str(tmp_path / "res.json"),
                                 str(tmp_path / "td"), "td-1")
    assert t == {"skipped": 2, "destroyed": 1, "failed": 1}
    (tmp_path / "remote.txt").write_text("site/a.pdf\nsite/docs/b.pdf\nsite/index.html\nsite/old.pdf\n")
    (tmp_path / "local.txt").write_text("a.pdf\ndocs/b.pdf\nnew.pdf\nskip.tmp\n")
    s = jobs.inventory_sync_job(spark, str(tmp_path / "remote.txt"), str(tmp_path / "local.txt"), "site",
                                str(tmp_path / "sync"), exclude=[".tmp"])
    assert s == {"ignore": 2, "upload": 1, "delete": 1}
    listing = [r.name for r in spark.read.json(str(tmp_path / "sync" / "listing")).collect()]
    assert sorted(listing) == ["a.pdf", "b.pdf", "docs", "old.pdf"]


def test_failing_job_leaves_one_notice_and_raises(spark, tmp_path):
    import pytest
    params = Params(now=dt.datetime(2024, 3, 1), max_credential_age=90)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jobs.credential_check_job(spark, str(tmp_path / "none"), ["111"], str(tmp_path / "store"), str(tmp_path / "sink"), params, "cred-9")
    got = spark.read.json(str(tmp_path / "sink" / "notifications")).collect()
    assert [(r.invocation_id, r.subject) for r in got] == [("cred-9", "AWS account credential check alert")] and "PATH_NOT_FOUND" in got[0].message
