"""Login alerting as a Structured Streaming job.

New trail files land in a directory; the file source picks them up, documents
that are delivered again (the same file name and content under another folder)
are dropped by state, and each micro-batch runs the same ``login_alerts``
function as the batch job. Output is written per batch id with overwrite
semantics, and each file's message under an invocation id of its own that
follows from the file's name and message, so a batch replayed after a failure replaces its
own output (exactly-once end to end with the checkpoint).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch import schemas
from skywatch.operators import logins
from skywatch.session import scratch_path
from skywatch.sources import sinks
from skywatch.sources.files import copy
from skywatch.sources.trail import explode_records, with_file


def trail_stream(spark: SparkSession, source_dir: str, multi_line: bool = True,
                 max_files_per_trigger: int | None = None, redelivery: str = "30 days") -> DataFrame:
    """A4 as a stream: one row per record of every new trail document.

    A document that came before within ``redelivery`` (of arrival, so that a late file is never too late) is left out.
    The state holds a name and a hash per document of that time."""
    r = spark.readStream.schema(schemas.TRAIL_FILE).option("multiLine", multi_line) \
        .option("recursiveFileLookup", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = with_file(r.json(source_dir)).withColumn("trailName", trail_name("_file")) \
        .withColumn("_document", F.xxhash64(F.to_json("Records"))).withColumn("_arrived", F.current_timestamp())
    once = docs.withWatermark("_arrived", redelivery).dropDuplicatesWithinWatermark(["trailName", "_document"])
    return explode_records(once)


def trail_name(file_col: str) -> Column:
    """File name of a trail file, which the delivering service makes unique."""
    return F.regexp_extract(file_col, "[^/]*$", 0)


def file_messages(alerts: DataFrame) -> DataFrame:
    """H6: one message per trail file; its invocation id follows from the file's name and the message."""
    msgs = logins.alert_messages(alerts, "trailFile")
    return msgs.withColumn("invocation_id", F.concat(F.lit("login-"), F.sha1(F.concat(trail_name("trailFile"), "message").cast("binary"))))


def start_login_alert_stream(spark: SparkSession, source_dir: str, ip_ranges: list[str], out_dir: str,
                             checkpoint: str, multi_line: bool = True, available_now: bool = True,
                             max_files_per_trigger: int | None = None, name: str | None = None):
    """Start I1 + I2: alerts to ``out_dir/alerts/batch=<id>``, one message per
    trail file to ``out_dir/notifications``. Returns the StreamingQuery."""
    stream = trail_stream(spark, source_dir, multi_line, max_files_per_trigger)
    alerts = logins.login_alerts(spark, stream, ip_ranges, keep=["eventID", "trailFile"])

    def per_batch(df: DataFrame, batch_id: int) -> None:
        path = f"{out_dir}/alerts/batch={batch_id}"
        df.write.mode("overwrite").parquet(path)
        written = df.sparkSession.read.schema(df.schema).parquet(path)  # the batch runs once; messages read what it wrote
        sinks.write_notifications(file_messages(written), f"{out_dir}/notifications")

    w = alerts.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.queryName(name) if name else w
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def trail_documents(records: DataFrame, records_per_file: int = 250) -> DataFrame:
    """Group records into trail documents of bounded size (test input writer)."""
    doc = F.floor(F.col("event_id") / records_per_file)
    rec_cols = [f.name for f in schemas.TRAIL_RECORD.fields]
    return (records.withColumn("doc", doc)
            .groupBy("doc").agg(F.collect_list(F.struct(*rec_cols)).alias("Records")))


def run_login_stream_over_drops(spark: SparkSession, sf_dir: str, ip_ranges: list[str]) -> DataFrame:
    """Registered query ``login_stream``: trail files derived from ``events``
    land in two drops; the stream runs to completion after each drop (the
    second run resumes from the checkpoint). Returns every alert written."""
    from skywatch.plans import shims

    base = scratch_path(spark, f"login_stream/{uuid.uuid4().hex}")
    recs = shims.trail_records(spark, sf_dir).withColumn("event_id", F.col("eventID").cast("bigint"))
    docs = trail_documents(recs).withColumn("drop", (F.col("doc") % 2).cast("int")).persist()
    for drop in (0, 1):
        (docs.where(F.col("drop") == drop).select("Records")
         .write.mode("overwrite").json(f"{base}/in/drop{drop}"))
        q = start_login_alert_stream(spark, f"{base}/in", ip_ranges, f"{base}/out",
                                     f"{base}/checkpoint", multi_line=False)
        q.awaitTermination()
    docs.unpersist()
    return spark.read.parquet(f"{base}/out/alerts")


def run_login_messages(spark: SparkSession, sf_dir: str, ip_ranges: list[str]) -> DataFrame:
    """Registered query ``login_messages``: one trail document a file, some delivered a second time in a later drop;
    the messages written, by document: (doc, subject, n_alerts)."""
    from skywatch.plans import shims

    base = scratch_path(spark, f"login_messages/{uuid.uuid4().hex}")
    recs = shims.trail_records(spark, sf_dir).withColumn("event_id", F.col("eventID").cast("bigint"))
    docs = trail_documents(recs)
    docs.repartition("doc").write.partitionBy("doc").json(f"{base}/in/first")
    run = lambda: start_login_alert_stream(spark, f"{base}/in", ip_ranges, f"{base}/out", f"{base}/checkpoint", multi_line=False).awaitTermination()
    run()
    for k in (0, 1, 3):
        copy(spark, f"{base}/in/first/doc={k}", f"{base}/in/again/doc={k}")
    run()
    ids = file_messages(spark.read.parquet(f"{base}/out/alerts")) \
        .select(F.regexp_extract("trailFile", "doc=([0-9]+)", 1).cast("bigint").alias("doc"), "invocation_id")
    messages = spark.read.json(f"{base}/out/notifications")
    body = F.expr(f"substring(message, {len(logins.ALERT_INTRO) + 1})")
    return messages.join(ids, "invocation_id").select("doc", "subject", F.json_array_length(body).cast("bigint").alias("n_alerts"))
