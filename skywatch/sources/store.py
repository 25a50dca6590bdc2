"""Issue store (A9, A10): versioned Parquet snapshots, one pointer per monitor.

The reference keeps ``(pk = '<monitor>--<key>', obj = JSON)`` in a key/value
table. Here a run writes the monitor's snapshot to a *new* version folder,
bucketed and sorted by ``pk``, and then commits by creating the pointer file
``pointers/monitor=<m>/seq=<n>/pointer``. Nothing is ever overwritten: readers
always see a whole snapshot, and a failed run leaves the previous one in
place. The pointer is created without overwrite, so of two runs that start
from the same snapshot one commits and the other gets :class:`CommitConflict`;
:func:`update` then repeats it from the snapshot that won. A snapshot is read
with its buckets, so the daily diff by ``pk`` shuffles the current issues only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch import schemas
from skywatch.sources import files

BUCKETS = 32


class CommitConflict(RuntimeError):
    """Another run committed this monitor's next snapshot first."""


def _pointers(spark: SparkSession, root: str) -> dict[str, tuple[int, str]]:
    """Newest (sequence number, version) of each monitor; empty only where no pointer was ever written."""
    try:
        rows = spark.read.option("basePath", f"{root.rstrip('/')}/pointers").text(f"{root.rstrip('/')}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    if "seq" not in rows.columns:
        return {}
    newest = rows.groupBy(F.col("monitor").cast("string").alias("monitor")).agg(F.max(F.struct(F.col("seq").cast("long").alias("seq"), "value")).alias("p"))
    return {r["monitor"]: (r["p"]["seq"], r["p"]["value"]) for r in newest.collect()}  # one row per monitor


def current_version(spark: SparkSession, root: str, monitor: str) -> str | None:
    return _pointers(spark, root).get(monitor, (0, None))[1]


def _snapshot(spark: SparkSession, root: str, monitor: str, pointer: str) -> DataFrame:
    """One monitor's stored rows, with the buckets they were written in (the pointer names version and buckets)."""
    version, _, buckets = pointer.partition(" ")
    whole = f"{root.rstrip('/')}/versions/{version}"
    if not files.exists(spark, f"{whole}/_SUCCESS"):
        raise FileNotFoundError(f"the current snapshot of {monitor} is not whole: {whole}")
    folder = f"{whole}/monitor={monitor}"
    if not files.exists(spark, folder):  # no issues
        return spark.createDataFrame([], schemas.ISSUE_STORE)
    if not buckets:
        return spark.read.schema("pk string, obj string").parquet(folder).select(F.lit(monitor).alias("monitor"), "pk", "obj")
    table = f"issues_{uuid.uuid4().hex}"
    location = files.qualified(spark, folder).replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} (pk string, obj string) USING parquet CLUSTERED BY (pk) SORTED BY (pk) INTO {int(buckets)} BUCKETS LOCATION '{location}'")
    rows = spark.table(table).select(F.lit(monitor).alias("monitor"), "pk", "obj")
    rows.schema  # resolved: the files stay when the name goes
    spark.sql(f"DROP TABLE {table}")
    return rows


def read_issues(spark: SparkSession, root: str, monitor: str | None = None) -> DataFrame:
    """The current snapshot of one monitor, or of all; empty if none yet."""
    found = _pointers(spark, root) if root else {}
    if monitor is not None:
        return _snapshot(spark, root, monitor, found[monitor][1]) if monitor in found else spark.createDataFrame([], schemas.ISSUE_STORE)
    df = spark.createDataFrame([], schemas.ISSUE_STORE)
    for name in sorted(found):
        df = df.unionByName(_snapshot(spark, root, name, found[name][1]))
    return df


def write_snapshot(spark: SparkSession, root: str, snapshot: DataFrame, monitors: list[str] | None = None,
                   commit: bool = True, buckets: int = BUCKETS) -> str:
    """A10: write ``snapshot (monitor, pk, obj)`` as a new version and (unless
    ``commit=False``) make it current for ``monitors`` (default: those that
    have rows in it; name a monitor whose last issue is fixed). Returns what a pointer to it holds.

    Rows are dealt out by ``pk``, so that a bucket is one file and a monitor that holds most rows is written by all tasks."""
    version = f"v-{uuid.uuid4().hex}"
    rows = snapshot.select("monitor", "pk", "obj")
    if monitors:
        rows = rows.where(F.col("monitor").isin(*monitors))
    table, path = f"issues_{uuid.uuid4().hex}", files.qualified(spark, f"{root.rstrip('/')}/versions/{version}")
    (rows.repartition(buckets, "pk").write.partitionBy("monitor").bucketBy(buckets, "pk").sortBy("pk")
     .option("path", path).format("parquet").saveAsTable(table))
    spark.sql(f"DROP TABLE {table}")  # the files stay: the table is external
    pointer = f"{version} {buckets}"
    if commit:
        commit_version(spark, root, pointer, monitors)
    return pointer


def next_seq(spark: SparkSession, root: str, monitor: str) -> int:
    """The sequence number that a run starting now commits."""
    return _pointers(spark, root).get(monitor, (0, None))[0] + 1


def commit_version(spark: SparkSession, root: str, pointer: str, monitors: list[str] | None = None, seq: int | None = None) -> None:
    """Make a written version current (the last step of a run). ``seq``: the number that :func:`next_seq` gave when
    the run read its snapshot; if it has been taken since, :class:`CommitConflict`."""
    if not monitors:
        stored = files.names(spark, f"{root.rstrip('/')}/versions/{pointer.partition(' ')[0]}")
        monitors = [n.partition("=")[2] for n in stored if n.startswith("monitor=")]
    for m in monitors:
        n = next_seq(spark, root, m) if seq is None else seq
        if not files.create_new(spark, f"{root.rstrip('/')}/pointers/monitor={m}/seq={n}/pointer", pointer):
            raise CommitConflict(f"snapshot {n} of {m} was committed by another run")


def update(spark: SparkSession, root: str, monitor: str, build: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
    """Replace a monitor's snapshot by ``build(previous)``; repeated from the snapshot that won if another run commits
    first. Returns the sequence number committed."""
    for left in range(attempts - 1, -1, -1):
        seq = next_seq(spark, root, monitor)
        pointer = write_snapshot(spark, root, build(read_issues(spark, root, monitor)), [monitor], commit=False)
        try:
            commit_version(spark, root, pointer, [monitor], seq)
            return seq
        except CommitConflict:
            if not left:
                raise
    raise ValueError("attempts must be at least 1")
