"""Hot keys: one key holding most rows must give whole, right results, and
the plans must keep hot keys on splittable sides or reduce them map-side."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skywatch.operators import issues as iss
from skywatch.operators import usage

FIELDS = StructType([StructField("thingName", StringType()), StructField("note", StringType())])
MON = iss.Monitor("uptime-checker", "uptime", FIELDS, text=lambda: F.col("thingName"), pk=lambda: F.col("thingName"))


def test_hot_issue_key(spark):
    rows = [("hot", f"n{i}") for i in range(3000)] + [("cold", "x"), ("new", "y")]
    cur = iss.with_keys(MON, spark.createDataFrame(rows, FIELDS).repartition(8))
    prev = spark.createDataFrame(
        [("uptime-checker", k, json.dumps({"thingName": k, "note": "old"})) for k in ("hot", "gone")],
        "monitor string, pk string, obj string")
    states = iss.issue_states(MON, cur, prev)
    counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}
    assert counts == {"existing": 3000, "raised": 2, "fixed": 1}
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan  # a full outer join could not be split by AQE
    snap = {r.pk: json.loads(r.obj)["note"] for r in iss.next_snapshot(MON, cur, prev).collect()}
    assert snap == {"hot": "old", "cold": "x", "new": "y"}


def test_hot_address_counts(spark):
    d = dt.date(2024, 1, 12)
    rows = [(d, "9.9.9.9", "GET", "/a/x", 200, "Hit", "s", "r")] * 5000 + [(d, "1.1.1.1", "GET", "/a/x", 200, "Hit", "s", "r")]
    cdn = spark.createDataFrame(rows, "date date, request_ip string, method string, uri string, status int, "
                                      "x_edge_detailed_result_type string, stackName string, stackResourceName string")
    out = usage.cdn_usage(cdn.repartition(8), dt.date(2024, 1, 10), dt.date(2024, 1, 17))
    got = {r.request_ip: r["count"] for r in out.collect()}
    assert got == {"9.9.9.9": 5000, "1.1.1.1": 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan  # reduced map-side before the shuffle
