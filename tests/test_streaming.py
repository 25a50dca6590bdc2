"""Streaming equals batch (I1, I3); a second run resumes without repeats."""

import uuid

from pyspark.sql import functions as F

from skywatch.plans import queries as q
from skywatch.plans import shims
from skywatch.session import scratch_path
from skywatch.streaming import logins as sl


def test_login_stream_equals_batch(spark, sf_small):
    streamed = sorted(tuple(r) for r in q.q_login_stream(spark, sf_small).collect())
    batch = sorted(tuple(r) for r in q.q_login_alerts(spark, sf_small).collect())
    assert streamed == batch and len(batch) > 0


def test_login_stream_no_repeats_on_rerun(spark, sf_small):
    base = scratch_path(spark, f"test_stream/{uuid.uuid4().hex}")
    recs = shims.trail_records(spark, sf_small).withColumn("event_id", F.col("eventID").cast("bigint"))
    sl.trail_documents(recs).select("Records").write.json(f"{base}/in/d0")
    for _ in range(2):  # the second run finds no new files
        sl.start_login_alert_stream(spark, f"{base}/in/*", shims.IP_RANGES, f"{base}/out", f"{base}/ck",
                                    multi_line=False).awaitTermination()
    alerts = spark.read.parquet(f"{base}/out/alerts")
    assert alerts.count() == alerts.select("eventID").distinct().count() > 0
    msgs = spark.read.json(f"{base}/out/notifications")
    assert msgs.count() == 1


def test_device_stream_equals_batch(spark, sf_small):
    streamed = sorted(tuple(r) for r in q.q_device_stream(spark, sf_small).select("thing", "connected", "n_events").collect())
    batch = sorted(tuple(r) for r in q.q_device_latest(spark, sf_small).select("thing", "connected", "n_events").collect())
    assert streamed == batch


def test_stream_over_gzipped_multiline_documents(spark, tmp_path):
    import gzip
    import json

    from tests.test_golden_login import TRAIL
    src = tmp_path / "trail"
    src.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for i in range(2):  # two drops, one pretty-printed gzip document each
        with gzip.open(src / f"f{i}.json.gz", "wt") as f:
            json.dump(TRAIL, f, indent=2)
        sl.start_login_alert_stream(spark, str(src), [], out, ck, multi_line=True).awaitTermination()
    alerts = spark.read.parquet(f"{out}/alerts")
    assert alerts.count() == 4  # 2 records per file, each file processed once
    assert alerts.select("trailFile").distinct().count() == 2


def test_file_delivered_twice_gives_one_message(spark, tmp_path):
    import gzip
    import json
    import shutil

    from tests.test_golden_login import TRAIL
    src, out, ck = tmp_path / "trail", str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        sl.start_login_alert_stream(spark, str(src), [], out, ck).awaitTermination()
        return spark.read.json(f"{out}/notifications")

    (src / "day1").mkdir(parents=True)
    with gzip.open(src / "day1" / "f1.json.gz", "wt") as f:
        json.dump(TRAIL, f)
    assert run().count() == 1
    (src / "again").mkdir()
    shutil.copy(src / "day1" / "f1.json.gz", src / "again" / "f1.json.gz")  # delivered again
    shutil.copy(src / "day1" / "f1.json.gz", src / "again" / "f2.json.gz")  # another file of equal content
    msgs = run()
    assert msgs.count() == 2 == msgs.select("invocation_id").distinct().count()
    assert spark.read.parquet(f"{out}/alerts").select("trailFile").distinct().count() == 2


def test_login_messages_query(spark, sf_small):
    got = {r.doc: r.n_alerts for r in q.q_login_messages(spark, sf_small).collect()}
    batch = q.q_login_alerts(spark, sf_small).groupBy((F.col("eventID").cast("bigint") / 250).cast("bigint").alias("doc")).count()
    assert got == {r.doc: r["count"] for r in batch.collect()} and got


def test_device_batches_write_what_changed(spark, tmp_path):
    import datetime as dt

    from skywatch.sources import files
    from skywatch.streaming import devices as sd
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "thing string, ts timestamp, event_id long, connected boolean"

    def deliver(k, rows):
        spark.createDataFrame([(t, dt.datetime(2024, 1, 1, 0, s), s, c) for t, s, c in rows], schema).coalesce(1).write.parquet(f"{src}/f{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        sd.start_device_state_stream(spark, stream, out, str(tmp_path / "ck"), compact_every=2).awaitTermination()
        return {r.thing: (r.connected, r.n_events) for r in sd.read_device_state(spark, out).collect()}

    assert deliver(0, [(f"t{k}", 1, True) for k in range(50)]) == {f"t{k}": (True, 1) for k in range(50)}
    state = deliver(1, [("t3", 2, False)])
    assert state["t3"] == (False, 2) and len(state) == 50
    assert spark.read.parquet(f"{out}/delta/batch=1").count() == 1  # only the device that changed
    # a batch that is still being written is not read
    spark.read.parquet(f"{out}/delta/batch=1").withColumn("connected", F.lit(True)).write.partitionBy("bucket").parquet(f"{out}/delta/batch=7")
    assert {r.thing: r.connected for r in sd.read_device_state(spark, out).collect()}["t3"] is False
    for k in range(2, 6):
        state = deliver(k, [("t3", 1 + k, k % 2 == 0), (f"new{k}", 1, True)])
    assert state["t3"] == (False, 6) and len(state) == 54
    assert [r.connected for r in sd.read_device_state(spark, out, thing="t3").collect()] == [False]
    assert "base-1" not in files.names(spark, f"{out}/complete") and "base-5" in files.names(spark, f"{out}/complete")


def test_failing_stream_leaves_one_notice(spark, tmp_path):
    import time

    import pytest

    from skywatch.streaming.notices import FailureNotices
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "in"))
    listener = FailureNotices(spark, str(tmp_path / "notifications"), {"uptime": "uptime check"})
    spark.streams.addListener(listener)
    try:
        bad = spark.readStream.schema("x int").parquet(str(tmp_path / "in")).withColumn("y", F.raise_error(F.lit("broken feed")))
        query = bad.writeStream.format("noop").queryName("uptime").option("checkpointLocation", str(tmp_path / "ck")).start()
        with pytest.raises(Exception, match="broken feed"):
            query.awaitTermination()
        for _ in range(60):
            if (tmp_path / "notifications").exists() and list((tmp_path / "notifications").glob("invocation_id=*/part*")):
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    got = spark.read.json(str(tmp_path / "notifications")).collect()
    assert len(got) == 1 and got[0].subject == "AWS account uptime check alert" and "broken feed" in got[0].message


def test_device_stream_batches_do_not_follow_the_files(spark, tmp_path, monkeypatch):
    """However many files the events come in, four batches take them, and each writes a file per bucket."""
    import datetime as dt

    from skywatch.operators.devices import latest_state
    from skywatch.plans import shims
    from skywatch.sources import files
    from skywatch.streaming import devices as sd
    rows = [(k, k % 7 if k % 5 else None, ["click", "error"][k % 2], dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k // 2)) for k in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(sd, "scratch_path", lambda spark, name: str(tmp_path / "run"))
    flat = lambda df: sorted(map(str, df.select("thing", "connected", "last_ts", "n_events").collect()))
    assert flat(sd.run_device_state_stream(spark, str(tmp_path))) == flat(latest_state(shims.device_events(spark, str(tmp_path)), tiebreak="event_id"))
    done = files.names(spark, str(tmp_path / "run" / "out" / "complete"))
    assert len(list((tmp_path / "run" / "in").rglob("*.parquet"))) > 4
    assert [n for n in done if n.startswith("delta")] == [f"delta-{k}" for k in range(4)] and "base-2" in done
    assert all(len(list(b.glob("*.parquet"))) == 1 for b in (tmp_path / "run" / "out" / "delta").rglob("bucket=*"))
