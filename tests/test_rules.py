"""Rule engine B22 with credential rules (B15-B21) and template policies."""

import datetime as dt

from skywatch.operators import rules
from skywatch.schemas import CREDENTIAL_REPORT

NOW = dt.datetime(2024, 3, 1)


def report(spark, rows):
    cols = ["accountId"] + CREDENTIAL_REPORT.fieldNames()
    full = []
    for r in rows:
        d = dict.fromkeys(cols)
        d.update(r)
        full.append(tuple(d[c] for c in cols))
    return spark.createDataFrame(full, "accountId string, " + ", ".join(f"{c} string" for c in cols[1:]))


def issues(spark, rows, accounts=("A",)):
    acc = spark.createDataFrame([(a,) for a in accounts], "accountId string")
    got = rules.credential_issues(report(spark, rows), acc, NOW, 90).collect()
    return sorted((g.accountId, g.resource, g.attribute, g.expected, g.actual) for g in got)


def iso(days_ago, hours=0):
    return (NOW - dt.timedelta(days=days_ago, hours=hours)).strftime("%Y-%m-%dT%H:%M:%S+00:00")


def test_root_rules(spark):
    got = issues(spark, [{"accountId": "A", "user": "<root_account>", "arn": "root", "mfa_active": "false",
                          "access_key_1_active": "true", "access_key_2_active": "false"}])
    assert got == [("A", "root", "access_key_1_active", "false", "true"), ("A", "root", "mfa_active", "true", "false")]


def test_missing_root_and_empty_report(spark):
    got = issues(spark, [{"accountId": "A", "user": "bob", "arn": "b", "password_enabled": "false",
                          "access_key_1_active": "false", "access_key_2_active": "false"}], accounts=("A", "B"))
    assert got == [("A", "rootUsers", "length", "> 0", "0"), ("B", "rootUsers", "length", "> 0", "0")]


def test_age_rules(spark):
    base = {"accountId": "A", "password_enabled": "true", "mfa_active": "true",
            "access_key_1_active": "false", "access_key_2_active": "false"}
    rows = [dict(base, user="<root_account>", arn="root", access_key_1_active="false"),
            dict(base, user="u90", arn="u90", password_last_changed=iso(90)),      # exactly max -> issue
            dict(base, user="u89", arn="u89", password_last_changed=iso(89, 11)),  # 89.46 rounds to 89
            dict(base, user="u895", arn="u895", password_last_changed=iso(89, 12)),  # 89.5 rounds up to 90
            dict(base, user="na", arn="na", password_last_changed="N/A"),          # not a date -> NaN
            dict(base, user="fut", arn="fut", password_last_changed=iso(-3)),      # future date, negative age
            dict(base, user="k", arn="k", password_enabled="false", mfa_active="false",
                 access_key_2_active="true", access_key_2_last_rotated=iso(200))]
    got = issues(spark, rows)
    exp = "less than 90 days ago"
    assert got == [("A", "k", "access_key_2_last_rotated", exp, "200"),
                   ("A", "na", "password_last_changed", exp, "NaN"),
                   ("A", "u895", "password_last_changed", exp, "90"),
                   ("A", "u90", "password_last_changed", exp, "90")]


def test_console_user_mfa(spark):
    got = issues(spark, [{"accountId": "A", "user": "<root_account>", "arn": "root", "mfa_active": "true",
                          "access_key_1_active": "false", "access_key_2_active": "false"},
                         {"accountId": "A", "user": "c", "arn": "c", "password_enabled": "true", "mfa_active": "false",
                          "password_last_changed": iso(1), "access_key_1_active": "false", "access_key_2_active": "false"}])
    assert got == [("A", "c", "mfa_active", "true", "false")]


def test_template_policies(spark):
    res = spark.createDataFrame([
        ("t", "B1", "AWS::S3::Bucket", None, None, '{"BucketEncryption":{"ServerSideEncryptionConfiguration":[{"ServerSideEncryptionByDefault":{"SSEAlgorithm":"AES256"}}]}}'),
        ("t", "B2", "AWS::S3::Bucket", "Retain", "Delete", "{}"),
        ("t", "P1", "AWS::IAM::ManagedPolicy", "Delete", None, '{"Description":"ok"}'),
        ("t", "P2", "AWS::IAM::ManagedPolicy", None, None, '{"Description":""}'),
        ("t", "S1", "AWS::SecretsManager::Secret", None, "Snapshot", "{}"),
        ("u", "F1", "AWS::Lambda::Function", None, None, None)],
        "template string, logicalId string, Type string, DeletionPolicy string, UpdateReplacePolicy string, Properties string")
    got = sorted(((r.template, r.resource, r.attribute, r.actual) for r in rules.template_violations(res).collect()), key=repr)
    assert got == sorted([("t", "B2", "DeletionPolicy", "Retain"), ("t", "B2", "SSEAlgorithm", None),
                          ("t", "P2", "Description", ""), ("t", "S1", "UpdateReplacePolicy", "Snapshot"),
                          ("t", None, "AWS::SecretsManager::Secret", "1")], key=repr)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.integers(-400 * 24, 400 * 24).map(lambda h: ("h", h)),
                          st.sampled_from([("t", "N/A"), ("t", "no_information"), ("t", "")])),
                min_size=1, max_size=25))
def test_age_rule_matches_js_rounding(spark, dates):
    """Math.round((now - date) / day); an issue when not a date or >= max."""
    import math
    texts = [(NOW - dt.timedelta(hours=v)).strftime("%Y-%m-%dT%H:%M:%S+00:00") if k == "h" else v
             for k, v in dates]
    rows = [{"accountId": "A", "user": "<root_account>", "arn": "root", "mfa_active": "true",
             "access_key_1_active": "false", "access_key_2_active": "false"}]
    rows += [{"accountId": "A", "user": f"u{i}", "arn": f"u{i}", "password_enabled": "true", "mfa_active": "true",
              "password_last_changed": t, "access_key_1_active": "false", "access_key_2_active": "false"}
             for i, t in enumerate(texts)]
    got = {(r[1], r[4]) for r in issues(spark, rows)}
    want = set()
    for i, (k, v) in enumerate(dates):
        if k == "t":
            want.add((f"u{i}", "NaN"))
        else:
            age = math.floor(v / 24 + 0.5)
            if age >= 90:
                want.add((f"u{i}", str(age)))
    assert got == want
