"""Device connectivity state as a stream.

Connection events arrive as files; a streaming aggregation keeps the latest
state per device (``max_by`` over ``(ts, event_id)``). The state store holds
one row per device, so it grows with the fleet, not with the events. A batch
writes only the devices that changed in it (update mode), as a delta dealt out
by a hash of the device; every tenth batch the deltas are merged into a new
base. Deltas and bases count once their mark is there, which is created after
their files, so a reader never sees half of one. Reading takes the newest base
and, per device, the row of the newest delta after it.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.operators.devices import latest_state
from skywatch.session import scratch_path
from skywatch.sources import files


DEVICE_BUCKETS = 16
COMPACT_EVERY = 10
DROPS = 4  # of the registered query


def _bucket(thing: Column) -> Column:
    return F.pmod(F.xxhash64(thing), F.lit(DEVICE_BUCKETS)).cast("int")


def _complete(spark: SparkSession, out_dir: str, kind: str) -> list[int]:
    """Batches whose delta or base is whole, ascending."""
    return sorted(int(n.partition("-")[2]) for n in files.names(spark, f"{out_dir}/complete") if n.startswith(f"{kind}-"))


def _write(df: DataFrame, out_dir: str, kind: str, batch_id: int) -> None:
    spark = df.sparkSession
    rows = df.withColumn("bucket", _bucket(F.col("thing"))).repartition(DEVICE_BUCKETS, "bucket")  # a file per bucket, not one per task and bucket
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{out_dir}/{kind}/batch={batch_id}")
    files.create_new(spark, f"{out_dir}/complete/{kind}-{batch_id}", df.schema.json())  # there already after a replay


def _merged(spark: SparkSession, out_dir: str, last: int | None = None, thing=None) -> DataFrame:
    bases = [b for b in _complete(spark, out_dir, "base") if last is None or b <= last]
    since = bases[-1] if bases else -1
    deltas = [b for b in _complete(spark, out_dir, "delta") if b > since and (last is None or b <= last)]
    found = [("base", b) for b in bases[-1:]] + [("delta", b) for b in deltas]
    if not found:
        raise FileNotFoundError(f"no whole batch of device state in {out_dir}")
    # a mark holds the columns of what it completes
    schema = T.StructType.fromJson(json.loads(files.read_text(spark, f"{out_dir}/complete/{found[-1][0]}-{found[-1][1]}"))).add("bucket", T.IntegerType())
    rows = spark.createDataFrame([], T.StructType([*schema, T.StructField("batch", T.LongType())]))
    for kind, b in found:
        part = spark.read.schema(schema).parquet(f"{out_dir}/{kind}/batch={b}")
        rows = rows.unionByName(part.withColumn("batch", F.lit(b).cast("bigint")))
    if thing is not None:  # one device: its bucket alone is read
        rows = rows.where((F.col("bucket") == _bucket(F.lit(thing).cast(schema["thing"].dataType))) & (F.col("thing") == thing))
    newest = rows.groupBy("thing").agg(F.max_by(F.struct("connected", "last_ts", "n_events"), "batch").alias("s"))
    return newest.select("thing", "s.*")


def start_device_state_stream(spark: SparkSession, events: DataFrame, out_dir: str, checkpoint: str,
                              available_now: bool = True, compact_every: int = COMPACT_EVERY, name: str | None = None):
    """Latest state per device: each micro-batch writes the devices it changed; read with :func:`read_device_state`."""
    state = latest_state(events, tiebreak="event_id")

    def per_batch(df: DataFrame, batch_id: int) -> None:
        _write(df, out_dir, "delta", batch_id)
        if batch_id % compact_every == compact_every - 1:
            _write(_merged(spark, out_dir, last=batch_id), out_dir, "base", batch_id)
            # the base before this one and its deltas stay for readers that began with them
            old = [b for b in _complete(spark, out_dir, "base") if b < batch_id][:-1]
            for kind, upto in (("base", max(old, default=-1)), ("delta", max(old, default=-1))):
                for b in [b for b in _complete(spark, out_dir, kind) if b <= upto]:
                    files.remove(spark, f"{out_dir}/complete/{kind}-{b}")
                    files.remove(spark, f"{out_dir}/{kind}/batch={b}")

    w = (state.writeStream.outputMode("update").foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint))
    w = w.queryName(name) if name else w
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_device_state(spark: SparkSession, out_dir: str, thing=None) -> DataFrame:
    """The latest state of every device (or of one), from whole batches only."""
    return _merged(spark, out_dir, thing=thing)


def run_device_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query ``device_stream``: ``events`` split into four drops of
    files, streamed one drop's number of files per trigger; the final state equals the batch result.
    A batch costs the same few jobs however little it holds, so the number of batches does not follow that of the files."""
    from skywatch.plans import shims

    base = scratch_path(spark, f"device_stream/{uuid.uuid4().hex}")
    ev = shims.device_events(spark, sf_dir)
    (ev.withColumn("part", (F.col("event_id") % DROPS).cast("int"))
     .write.mode("overwrite").partitionBy("part").parquet(f"{base}/in"))
    found = [n for part in files.names(spark, f"{base}/in") for n in files.names(spark, f"{base}/in/{part}") if part.startswith("part=") and n.endswith(".parquet")]
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", max(1, math.ceil(len(found) / DROPS))).option("recursiveFileLookup", True).parquet(f"{base}/in")
    q = start_device_state_stream(spark, stream, f"{base}/out", f"{base}/checkpoint", compact_every=3)
    q.awaitTermination()
    return read_device_state(spark, f"{base}/out")
