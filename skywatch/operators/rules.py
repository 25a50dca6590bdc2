"""Declarative rule engine (B22) and the rule sets built on it.

Credential rules (B15-B21) and template policies (B35-B38). A rule is a
``Rule`` of SQL expressions; :func:`assert_rules` evaluates all of them in
one pass over the input (an array of structs, filtered and exploded), so N
rules cost one scan, one projection and no union.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch import config


@dataclass(frozen=True)
class Rule:
    """Emit an issue when ``applies`` and ``fails`` are both true.

    Every part is a Spark SQL expression over the input row (text, as a user
    writes a predicate): all rules of a set compile into ONE projection.
    ``attribute`` is a plain name; ``fails`` defaults to "expected differs
    from actual" (a missing actual differs).
    """

    applies: str
    resource: str
    attribute: str
    expected: str
    actual: str
    fails: str | None = None

    def as_sql(self) -> str:
        fails = self.fails if self.fails is not None else f"NOT (({self.expected}) <=> ({self.actual}))"
        return ("named_struct("
                f"'fire', coalesce(({self.applies}) AND ({fails}), false), "
                f"'resource', CAST({self.resource} AS STRING), "
                f"'attribute', '{self.attribute}', "
                f"'expected', CAST({self.expected} AS STRING), "
                f"'actual', CAST({self.actual} AS STRING))")


def assert_rules(df: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """``keep`` columns + ``resource, attribute, expected, actual`` per failed rule.

    One pass: an array of one struct per rule, filtered to the failed ones
    and exploded -- no union of per-rule scans.
    """
    arr = "array(" + ", ".join(r.as_sql() for r in rules) + ")"
    kept = [f"`{k}`" for k in keep]
    return (df.selectExpr(*kept, f"explode(filter({arr}, x -> x.fire)) AS i")
              .selectExpr(*kept, "i.resource", "i.attribute", "i.expected", "i.actual"))


# ------------------------------------------------------------------ credentials

# JavaScript-compatible parse of the report's dates and Math.round of days.
_DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd"]


def _age_sql(now, col: str) -> str:
    parsed = "coalesce(" + ", ".join(f'try_to_timestamp({col}, "{f}")' for f in _DATE_FORMATS) + ")"
    now_sql = f"TIMESTAMP '{now:%Y-%m-%d %H:%M:%S}'"
    return f"CAST(floor((unix_micros({now_sql}) - unix_micros({parsed})) / 86400000000.0 + 0.5) AS BIGINT)"


def credential_rules(now, max_age: int) -> list[Rule]:
    """B17-B21 over credential-report rows (B15 splits root from the rest)."""
    root = f"`user` = '{config.ROOT_USER}'"
    nonroot = f"NOT ({root})"
    rules = [
        Rule(root, "arn", "access_key_1_active", "'false'", "access_key_1_active"),
        Rule(root, "arn", "access_key_2_active", "'false'", "access_key_2_active"),
        Rule(root, "arn", "mfa_active", "'true'", "mfa_active"),
        Rule(f"{nonroot} AND password_enabled = 'true'", "arn", "mfa_active", "'true'", "mfa_active"),
    ]
    expected = f"'less than {int(max_age)} days ago'"
    for enabled, attr in [("password_enabled", "password_last_changed"),
                          ("access_key_1_active", "access_key_1_last_rotated"),
                          ("access_key_2_active", "access_key_2_last_rotated")]:
        age = _age_sql(now, attr)
        rules.append(Rule(f"{nonroot} AND {enabled} = 'true'", "arn", attr, expected,
                          f"coalesce(CAST({age} AS STRING), 'NaN')",
                          fails=f"{age} IS NULL OR {age} >= {int(max_age)}"))
    return rules


ROOT_MARK = "rootUsers"  # a finding that is no issue: the account has a root row


def credential_findings(report: DataFrame, now, max_age: int) -> DataFrame:
    """One pass over the report: the issues of its rows (B17-B21), and a mark for each root row, from which B16 follows."""
    mark = Rule(f"`user` = '{config.ROOT_USER}'", f"'{ROOT_MARK}'", "length", "'> 0'", "'1'", fails="true")
    return assert_rules(report, [*credential_rules(now, max_age), mark], keep=["accountId"])


def missing_root_issues(findings: DataFrame, accounts: DataFrame) -> DataFrame:
    """One issue per listed account whose report has no root row (an empty
    report counts too, hence from the account list)."""
    have = findings.where(F.col("resource") == ROOT_MARK).select("accountId").distinct()
    return (accounts.select("accountId").distinct().join(have, on="accountId", how="left_anti")
            .select("accountId",
                    F.lit(ROOT_MARK).alias("resource"), F.lit("length").alias("attribute"),
                    F.lit("> 0").alias("expected"), F.lit("0").alias("actual")))


def issues_of_findings(findings: DataFrame, accounts: DataFrame) -> DataFrame:
    """All credential issues ``(accountId, resource, attribute, expected, actual, pk)``. Reads the findings twice: write
    them first (:func:`skywatch.session.materialize`) where the report is large."""
    rows = findings.where(F.coalesce(F.col("resource") != ROOT_MARK, F.lit(True)))
    out = missing_root_issues(findings, accounts).unionByName(rows)
    return out.withColumn("pk", F.concat_ws("-", "accountId", "resource", "attribute", "expected"))


def credential_issues(report: DataFrame, accounts: DataFrame, now, max_age: int) -> DataFrame:
    """:func:`issues_of_findings` of a report."""
    return issues_of_findings(credential_findings(report, now, max_age), accounts)


def credential_issue_text() -> Column:
    """G10 for credential issues."""
    return F.format_string("%s: %s.%s should be '%s' but was '%s'",
                           "accountId", "resource", "attribute", "expected", "actual")


# ------------------------------------------------------------------ templates

_SSE = "array<struct<ServerSideEncryptionByDefault:struct<SSEAlgorithm:string>>>"


def template_rules() -> list[Rule]:
    """B35-B37 per resource row ``(template, logicalId, Type, DeletionPolicy,
    UpdateReplacePolicy, Properties)``; ``Properties`` is JSON text parsed as VARIANT."""
    desc = "try_variant_get(try_parse_json(Properties), '$.Description', 'string')"
    sse = f"try_variant_get(try_parse_json(Properties), '$.BucketEncryption.ServerSideEncryptionConfiguration', '{_SSE}')"
    encrypted = f"exists({sse}, x -> x.ServerSideEncryptionByDefault.SSEAlgorithm = 'AES256')"
    return [
        Rule("true", "logicalId", "DeletionPolicy", "'Delete'", "DeletionPolicy",
             fails="NOT (DeletionPolicy IS NULL OR DeletionPolicy = 'Delete')"),
        Rule("true", "logicalId", "UpdateReplacePolicy", "'Delete'", "UpdateReplacePolicy",
             fails="NOT (UpdateReplacePolicy IS NULL OR UpdateReplacePolicy = 'Delete')"),
        Rule("Type = 'AWS::IAM::ManagedPolicy'", "logicalId", "Description", "'.+'", desc,
             fails=f"NOT coalesce({desc} RLIKE '.+', false)"),
        Rule("Type = 'AWS::S3::Bucket'", "logicalId", "SSEAlgorithm", "'AES256'", f"to_json({sse})",
             fails=f"NOT coalesce({encrypted}, false)"),
    ]


def template_violations(resources: DataFrame) -> DataFrame:
    """``(template, resource, attribute, expected, actual)`` per failed check.

    B38 (no secret-store resource) is a per-template count.
    """
    per_resource = assert_rules(resources, template_rules(), keep=["template"])
    secrets = (resources.groupBy("template")
               .agg(F.count_if(F.col("Type") == "AWS::SecretsManager::Secret").alias("n"))
               .where(F.col("n") > 0)
               .select("template", F.lit(None).cast("string").alias("resource"),
                       F.lit("AWS::SecretsManager::Secret").alias("attribute"),
                       F.lit("0").alias("expected"), F.col("n").cast("string").alias("actual")))
    return per_resource.unionByName(secrets)


def explode_template(templates: DataFrame) -> DataFrame:
    """M14 map ``logicalId -> resource`` to one row per resource."""
    return (templates.select("template", F.explode("resources").alias("logicalId", "r"))
            .select("template", "logicalId", "r.*"))
