"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. Dates are computed as UTC midnights and ANSI
# mode stays on (Spark 4 default): bad input goes through try_* functions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast decisions: static from size estimates (upper bounds without
    # CBO), then re-checked by AQE against the measured shuffle size.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def cluster_conf(executors: int, cores_per_executor: int) -> dict[str, str]:
    """Settings for a large cluster run (pass as ``extra`` to :func:`get_spark`
    or to spark-submit). Shuffle partitions start at ~3 per core and AQE
    coalesces them to ~128 MB each; many small gzip log files are packed into
    read tasks by ``openCostInBytes``; skewed partitions over 256 MB and 5x
    the median are split.
    """
    cores = executors * cores_per_executor
    return {
        "spark.sql.shuffle.partitions": str(max(200, 3 * cores)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.files.openCostInBytes": str(8 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.task.maxFailures": "8",
        "spark.stage.maxConsecutiveAttempts": "8",
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "skywatch", extra: dict | None = None) -> SparkSession:
    """Return a session with the base settings.

    On a cluster, ``master`` is left to spark-submit and the shuffle partition
    count to the cluster config (AQE coalesces small ones). Locally (tests,
    bench) pass ``master='local[8]'`` and a partition count near the cores.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("SKYWATCH_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect client."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return None


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir`` (None if unset)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    sc = _context(spark)
    return sc.getCheckpointDir() if sc is not None else None


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint folder; only when none is configured
    (local tests) create a scratch one under /tmp."""
    d = checkpoint_dir(spark)
    if not d:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        d = tempfile.mkdtemp(prefix="skywatch-ckpt-", dir=os.environ.get("SKYWATCH_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    sc = _context(spark)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_scratch: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch_removed(spark: SparkSession):
    """Intermediate tables written within are removed at its end. For jobs that write their results; frames that read
    such a table must not leave the block."""
    _scratch.append([])
    try:
        yield
    finally:
        from skywatch.sources import files
        for path in _scratch.pop():
            files.remove(spark, path)


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Used where a frame has several consumers (a report built from one
    enriched frame, the lifecycle joins over one issue set): the upstream
    scans and shuffles run once, the lineage is cut (a lost executor does
    not recompute it), and later broadcast decisions see the real file size.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def folders_listed(spark: SparkSession):
    """Readers of trees of many folders are created within: Spark lists a folder's children in one job, with a task for
    each child unless told otherwise, which takes longer to schedule than to list. Here a job gets a few tasks per core."""
    before = spark.conf.get(LISTING_TASKS, None)
    spark.conf.set(LISTING_TASKS, str(min(int(before or 10_000), 2 * max(default_parallelism(spark), 8))))
    try:
        yield
    finally:
        spark.conf.unset(LISTING_TASKS) if before is None else spark.conf.set(LISTING_TASKS, before)


def write_tasks(spark: SparkSession) -> int:
    """Tasks for writing a file per folder: the work is in the number of files and not in their bytes, by which a
    shuffle would be coalesced to a few tasks."""
    return 4 * max(default_parallelism(spark), 2)


def prepare_session(spark: SparkSession) -> SparkSession:
    """Make a caller's session fit the library: dates are UTC midnights, and
    scratch tables need a checkpoint folder (created only when unset)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark
