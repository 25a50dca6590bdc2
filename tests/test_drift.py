"""Drift rules (B23-B30): vacuous truth, NULL handling, false-positive patterns."""

from skywatch.operators import drift

DIFF = "array<struct<PropertyPath:string,ExpectedValue:string,ActualValue:string,DifferenceType:string>>"


def d(path, actual, expected='{"MaximumRetryAttempts":2}'):
    return (path, expected, actual, "NOT_EQUAL")


def run(spark, stacks, drifts):
    s = spark.createDataFrame(stacks, "accountId string, StackName string, StackStatus string, StackDriftStatus string")
    r = spark.createDataFrame(drifts, f"StackName string, ResourceType string, StackResourceDriftStatus string, PropertyDifferences {DIFF}")
    return {x.stackName: x for x in drift.drift_status(s, r, keys=["StackName"]).collect()}


def test_rules(spark):
    stacks = [("a", n, "UPDATE_COMPLETE", "DRIFTED") for n in
              ["tags", "body", "props", "retry", "mixed", "empty", "nullarr", "nullactual", "none", "badretry"]]
    stacks += [("a", "gone", "DELETE_COMPLETE", "DRIFTED"), ("a", "new", "SOME_NEW_STATE", "NOT_CHECKED"),
               ("a", "unk", "UPDATE_COMPLETE", "UNKNOWN")]
    drifts = [("tags", "AWS::Any::Thing", "MODIFIED", [d("/Tags", "null"), d("/Tags", "null")]),
              ("body", "AWS::ApiGatewayV2::Api", "MODIFIED", [d("/Body", "null")]),
              ("props", "AWS::ApiGatewayV2::Integration", "MODIFIED", [d("/IntegrationUri", "null"), d("/IntegrationType", "null")]),
              ("retry", "AWS::Events::Rule", "MODIFIED", [d("/Targets/12/RetryPolicy", "null")]),
              ("mixed", "AWS::ApiGatewayV2::Api", "MODIFIED", [d("/Body", "null"), d("/Tags", "null")]),
              ("empty", "AWS::X::Y", "MODIFIED", []),
              ("nullarr", "AWS::X::Y", "MODIFIED", None),
              ("nullactual", "AWS::X::Y", "MODIFIED", [d("/Tags", None)]),
              ("badretry", "AWS::Events::Rule", "MODIFIED", [d("/Targets/0/RetryPolicy", "null", expected="{}")]),
              ("unk", "AWS::X::Y", "MODIFIED", [d("/Tags", "null")])]
    r = run(spark, stacks, drifts)
    assert "gone" not in r and r["new"].driftStatus == "NOT_CHECKED" and r["new"].is_issue
    ok = {k for k, v in r.items() if v.driftStatus == "IN_SYNC"}
    # empty and NULL difference lists are vacuously acceptable; stacks without rows too
    assert ok == {"tags", "body", "props", "retry", "empty", "nullarr", "none", "unk"}
    assert r["mixed"].text == "a: mixed is 'DRIFTED'" and r["mixed"].pk == "a-mixed"


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_TYPES = ["AWS::ApiGatewayV2::Api", "AWS::ApiGatewayV2::Integration", "AWS::Events::Rule", "AWS::SQS::Queue"]
_PATHS = ["/Tags", "/Body", "/IntegrationUri", "/IntegrationType", "/PayloadFormatVersion",
          "/Targets/12/RetryPolicy", "/X", None]
_diff = st.tuples(st.sampled_from(_PATHS), st.sampled_from(['{"MaximumRetryAttempts":3}', "{}", None]),
                  st.sampled_from(["null", "x", None]))
_drift = st.tuples(st.sampled_from(_TYPES), st.one_of(st.none(), st.lists(_diff, max_size=3)))


def _model_acceptable(rtype, diffs):
    """The four false-positive rules, as the reference states them."""
    import re
    ds = diffs or []
    null = lambda d: d[2] == "null"
    tags = all(d[0] == "/Tags" and null(d) for d in ds)
    body = rtype == "AWS::ApiGatewayV2::Api" and all(d[0] == "/Body" and null(d) for d in ds)
    props = (rtype == "AWS::ApiGatewayV2::Integration" and all(null(d) for d in ds)
             and all(d[0] in ("/PayloadFormatVersion", "/IntegrationUri", "/IntegrationType") for d in ds))
    retry = rtype == "AWS::Events::Rule" and all(
        d[0] is not None and re.search(r"/Targets/\d+/RetryPolicy", d[0])
        and d[1] is not None and re.search(r'\{"MaximumRetryAttempts":\d+\}', d[1]) and null(d) for d in ds)
    return bool(tags or body or props or retry)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(_drift, max_size=3), min_size=1, max_size=12))
def test_drift_rules_match_model(spark, stacks):
    stack_rows = [("a", f"s{i}", "UPDATE_COMPLETE", "DRIFTED") for i in range(len(stacks))]
    drift_rows = [(f"s{i}", t, "MODIFIED", None if ds is None else [(p, e, a, "NOT_EQUAL") for p, e, a in ds])
                  for i, drifts in enumerate(stacks) for t, ds in drifts]
    s = spark.createDataFrame(stack_rows, "accountId string, StackName string, StackStatus string, StackDriftStatus string")
    r = spark.createDataFrame(drift_rows, f"StackName string, ResourceType string, StackResourceDriftStatus string, "
                                          f"PropertyDifferences {DIFF}")
    got = {x.stackName: x.driftStatus for x in drift.drift_status(s, r, keys=["StackName"]).collect()}
    want = {f"s{i}": "IN_SYNC" if all(_model_acceptable(t, ds) for t, ds in drifts) else "DRIFTED"
            for i, drifts in enumerate(stacks)}
    assert got == want


def test_drift_files_are_compressed_and_hold_every_drift(spark, tmp_path):
    """Resource drifts go out as gzip JSON, joined with their stack while narrow; the rows are those of the tables."""
    from skywatch.plans import shims
    from skywatch.sources import reports
    spark.createDataFrame([(k, "1-URGENT" if k % 2 else None, "FO"[k % 2]) for k in range(6)] + [(5, "2-HIGH", "F")],
                          "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, n, None if k in (3, None) else 97 * n + k, "AR"[n % 2], "F") for k in [*range(8), None] for n in (1, 4, 7)],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    base = shims.write_drift_results(spark, str(tmp_path), str(tmp_path / "drift"))
    data = [p.name for p in (tmp_path / "drift").rglob("part-*")]
    assert data and all(n.endswith(".json.gz") for n in data)
    stacks, drifts = reports.read_drift_results(spark, f"{base}/stacks", f"{base}/drifts")
    assert stacks.count() == 7
    owner = shims.drift_stacks(spark, str(tmp_path)).select("stackKey", "accountId")
    want = shims.resource_drifts(spark, str(tmp_path)).join(owner, "stackKey").selectExpr("accountId", "concat('stack', stackKey) AS StackName", *drifts.columns[2:])
    flat = lambda df: sorted(df.selectExpr("to_json(struct(*)) AS j").toPandas()["j"])
    assert drifts.columns[:2] == ["accountId", "StackName"] and flat(drifts) == flat(want) and len(flat(drifts)) == 21
