"""A role switch and a console sign-in, with alerts derived by hand."""

import gzip
import json

from pyspark.sql import functions as F

from skywatch.operators import logins
from skywatch.sources.trail import read_audit_trail


def record(kind: str, **fields) -> dict:
    """A sign-in record: ``kind`` is the event name, whose result is the member of that name."""
    return {"eventVersion": "1.08", "eventSource": "signin.amazonaws.com", "eventType": "AwsConsoleSignIn", "eventName": kind,
            "awsRegion": "eu-central-1", "requestParameters": None, "responseElements": {kind: "Success"}, **fields}


SWITCH = record(
    "SwitchRole", eventID="e-1", eventTime="2023-03-04T05:06:07Z", sourceIPAddress="198.51.100.7", userAgent="browser/1", recipientAccountId="700000000001",
    userIdentity={"type": "AssumedRole", "principalId": "P1:ops", "arn": "arn:aws:sts::700000000001:assumed-role/Ops/ops", "accountId": "700000000001"},
    additionalEventData={"SwitchFrom": "arn:aws:iam::700000000009:user/olga", "RedirectTo": "https://console.example.org/"})
SIGN_IN = record(
    "ConsoleLogin", eventID="e-2", eventTime="2023-03-04T08:00:00Z", sourceIPAddress="203.0.113.20", userAgent="browser/2", recipientAccountId="700000000009",
    userIdentity={"type": "IAMUser", "principalId": "P2", "arn": "arn:aws:iam::700000000009:user/olga", "accountId": "700000000009", "userName": "olga"},
    additionalEventData={"LoginTo": "https://console.example.org/home", "MobileVersion": "No", "MFAUsed": "Yes"})
TRAIL = {"Records": [SWITCH, SIGN_IN]}


def alert(r: dict, user: str) -> dict:
    return {"user": user, "time": r["eventTime"], "sourceIp": r["sourceIPAddress"], "userAgent": r["userAgent"], "account": r["recipientAccountId"],
            "sourceData": {k: r[k] for k in ("eventSource", "eventType", "eventName", "responseElements")}}


ALERTS = [alert(SWITCH, "AssumedRole - arn:aws:sts::700000000001:assumed-role/Ops/ops from arn:aws:iam::700000000009:user/olga"),
          alert(SIGN_IN, "IAMUser - arn:aws:iam::700000000009:user/olga")]


def write_trail(tmp_path, doc, name="file.json.gz"):
    d = tmp_path / "AWSLogs" / "o-org" / "111122223333" / "CloudTrail" / "us-east-1" / "2020" / "09" / "11"
    d.mkdir(parents=True, exist_ok=True)
    with gzip.open(d / name, "wt") as f:
        json.dump(doc, f, indent=2)
    return str(tmp_path / "AWSLogs")


def test_switch_and_sign_in(spark, tmp_path):
    path = write_trail(tmp_path, TRAIL)
    recs = read_audit_trail(spark, path + "/*/*/CloudTrail/*/*/*/*/")
    alerts = logins.login_alerts(spark, recs, ["10.0.0.0/8"])  # excludes both addresses
    got = [json.loads(r[0]) for r in alerts.select(F.to_json(F.struct(*alerts.columns))).collect()]
    assert sorted(got, key=lambda r: r["user"]) == sorted(ALERTS, key=lambda r: r["user"])


def test_path_fields(spark, tmp_path):
    path = write_trail(tmp_path, TRAIL)
    r = read_audit_trail(spark, path + "/*/*/CloudTrail/*/*/*/*/").select(
        "trailOrgId", "trailAccountId", "trailRegion", "trailDate").distinct().collect()
    assert [tuple(x) for x in r] == [("o-org", "111122223333", "us-east-1", "2020-09-11")]


def test_allowed_addresses_give_no_alert(spark, tmp_path):
    path = write_trail(tmp_path, TRAIL)
    recs = read_audit_trail(spark, path + "/*/*/CloudTrail/*/*/*/*/")
    assert logins.login_alerts(spark, recs, ["198.51.100.7", "203.0.113.0/24"]).count() == 0


def test_one_message_per_file_and_none_when_empty(spark, tmp_path):
    path = write_trail(tmp_path, TRAIL)
    recs = read_audit_trail(spark, path + "/*/*/CloudTrail/*/*/*/*/")
    alerts = logins.login_alerts(spark, recs, [], keep=["trailFile"])
    msgs = logins.alert_messages(alerts, "trailFile").collect()
    assert len(msgs) == 1 and msgs[0].n_alerts == 2
    assert msgs[0].message.startswith(logins.ALERT_INTRO)
    assert len(json.loads(msgs[0].message[len(logins.ALERT_INTRO):])) == 2
    none = logins.alert_messages(logins.login_alerts(spark, recs, ["0.0.0.0/0"], keep=["trailFile"]), "trailFile")
    assert none.count() == 0
