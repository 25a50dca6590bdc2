"""Stack drift posture.

Per resource drift, four false-positive rules decide acceptability; per
stack, all drifts must be acceptable (``bool_and``, partial aggregation).
The per-stack flags are then joined to the stack list on the stack key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch import config

# ---- fixed values that must equal the reference's for the same results ----
# Properties whose null actual value is a known false drift on API integrations,
# and the patterns of the scheduled-rule retry-policy false drift.
NULL_INTEGRATION_PATHS = ["/PayloadFormatVersion", "/IntegrationUri", "/IntegrationType"]
RETRY_POLICY_PATH = r"/Targets/\d+/RetryPolicy"
RETRY_POLICY_EXPECTED = r'\{"MaximumRetryAttempts":\d+\}'
# ---------------------------------------------------------------------------

_EMPTY = "array<struct<PropertyPath:string,ExpectedValue:string,ActualValue:string,DifferenceType:string>>"


def _diffs() -> Column:
    return F.coalesce(F.col("PropertyDifferences"), F.array().cast(_EMPTY))


def _all(pred) -> Column:
    """JavaScript ``every``: true on an empty list; a NULL comparison counts as false."""
    return F.forall(_diffs(), lambda d: F.coalesce(pred(d), F.lit(False)))


def _null_actual(d) -> Column:
    return d["ActualValue"] == "null"


def is_missing_tags() -> Column:
    """Every difference is ``/Tags`` with actual ``'null'`` (any resource type)."""
    return _all(lambda d: (d["PropertyPath"] == "/Tags") & _null_actual(d))


def is_api_null_body() -> Column:
    """B25."""
    return (F.col("ResourceType") == "AWS::ApiGatewayV2::Api") & _all(
        lambda d: (d["PropertyPath"] == "/Body") & _null_actual(d))


def is_api_null_props() -> Column:
    """B26."""
    return ((F.col("ResourceType") == "AWS::ApiGatewayV2::Integration")
            & _all(_null_actual)
            & _all(lambda d: d["PropertyPath"].isin(*NULL_INTEGRATION_PATHS)))


def is_schedule_retry_policy() -> Column:
    """Unanchored pattern tests, as ``RegExp.test``."""
    return (F.col("ResourceType") == "AWS::Events::Rule") & _all(
        lambda d: d["PropertyPath"].rlike(RETRY_POLICY_PATH)
        & d["ExpectedValue"].rlike(RETRY_POLICY_EXPECTED) & _null_actual(d))


def drift_acceptable() -> Column:
    """A resource drift is acceptable when any of the four rules holds."""
    return F.coalesce(is_missing_tags() | is_api_null_body() | is_schedule_retry_policy()
                      | is_api_null_props(), F.lit(False))


def stack_acceptability(drifts: DataFrame, keys: list[str], include_deleted: bool = False) -> DataFrame:
    """Per stack, true when every MODIFIED drift is acceptable.

    The reference fetches MODIFIED drifts only, so a stack whose only drift
    is a deleted resource ends up in sync (kept as the default). With
    ``include_deleted=True`` a DELETED resource is never acceptable.
    """
    status = F.coalesce(F.col("StackResourceDriftStatus"), F.lit("MODIFIED"))
    wanted = status.isin("MODIFIED", "DELETED") if include_deleted else (status == "MODIFIED")
    ok = F.when(status == "DELETED", F.lit(False)).otherwise(drift_acceptable())
    return drifts.where(wanted).groupBy(*keys).agg(F.bool_and(ok).alias("acceptable"))


def checked_stacks(stacks: DataFrame) -> DataFrame:
    """Drop the listed states; unknown and NULL states are kept."""
    return stacks.where(~F.coalesce(F.col("StackStatus").isin(*config.IGNORED_STACK_STATES), F.lit(False)))


def drift_status(stacks: DataFrame, drifts: DataFrame, keys: list[str], include_deleted: bool = False) -> DataFrame:
    """B29 + B30: effective status per stack, issue flag, key (G9) and text.

    ``stacks`` has ``keys`` + ``accountId, StackName, StackStatus, StackDriftStatus``;
    a stack without drift rows is acceptable.
    """
    acc = stack_acceptability(drifts, keys, include_deleted)
    s = checked_stacks(stacks).join(acc, on=keys, how="left")
    detected = F.col("StackDriftStatus")
    acceptable = F.coalesce(F.col("acceptable"), F.lit(True))
    effective = (F.when(detected.isin("DRIFTED", "UNKNOWN") & acceptable, F.lit("IN_SYNC"))
                  .otherwise(detected))
    return (s.select("accountId", F.col("StackName").alias("stackName"),
                     detected.alias("detectedStatus"), acceptable.alias("acceptable"),
                     effective.alias("driftStatus"))
             .withColumn("is_issue", ~F.col("driftStatus").eqNullSafe(F.lit("IN_SYNC")))
             .withColumn("pk", F.concat_ws("-", "accountId", "stackName"))
             .withColumn("text", F.format_string("%s: %s is '%s'", F.col("accountId"), F.col("stackName"),
                                                 F.coalesce(F.col("driftStatus"), F.lit("null")))))
