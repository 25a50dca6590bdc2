"""Issue lifecycle against a stored snapshot.

``current`` issues are compared with the previous snapshot by key:
raised = current keys not stored (C3), existing = current keys stored (C5),
fixed = stored keys no longer current (C4, reported with the *stored*
object). Duplicate current keys are all reported; the snapshot keeps one
row per key. A key repeated across a third of the current rows is only
ever on a splittable side (the streamed side of a left join, which AQE
splits) or reduced map-side first (distinct keys, per-key aggregates).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skywatch.functions.scalars import is_monday

HEADINGS = [("raised", 1, "newly raised issues"),
            ("existing", 2, "previously raised issues"),
            ("fixed", 3, "issues resolved")]


@dataclass(frozen=True)
class Monitor:
    """What a monitor plugs into the lifecycle.

    ``fields`` is the issue shape stored as JSON; ``text`` formats one issue
    (a Column over those fields) and ``pk`` builds its key.
    """

    type: str
    label: str
    fields: StructType
    text: Callable[[], Column]
    pk: Callable[[], Column]


def with_keys(monitor: Monitor, issues: DataFrame) -> DataFrame:
    """Add ``pk``, the JSON ``obj`` (nulls kept) and the message ``text``."""
    names = [f.name for f in monitor.fields.fields]
    obj = F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"})
    return issues.select(*names, monitor.pk().alias("pk"), obj.alias("obj"), monitor.text().alias("text"))


def _stored(monitor: Monitor, previous: DataFrame) -> DataFrame:
    return (previous.where(F.col("monitor") == monitor.type)
            .select(F.col("pk").alias("_ppk"), F.col("obj").alias("_pobj")))


def issue_states(monitor: Monitor, current: DataFrame, previous: DataFrame) -> DataFrame:
    """H3: ``(state, pk, obj, text)`` for raised, existing and fixed issues.

    ``current`` comes from :func:`with_keys`; ``previous`` is the store
    ``(monitor, pk, obj)`` with one row per key. Current rows are left-joined
    to the stored keys (raised when unmatched, existing when matched): a key
    repeated over a third of the current rows is on the streamed side, which
    AQE's skew handling splits. Fixed issues are stored keys anti-joined with
    the *distinct* current keys (collapsed map-side), reported with the
    stored object, formatted by the monitor from its JSON.
    """
    prev = _stored(monitor, previous)
    cur = current.select("pk", "obj", "text")
    matched = cur.join(prev.select("_ppk"), on=F.col("pk") == F.col("_ppk"), how="left")
    live = matched.select(F.when(F.col("_ppk").isNull(), F.lit("raised")).otherwise(F.lit("existing")).alias("state"),
                          "pk", "obj", "text")
    gone = prev.join(cur.select(F.col("pk").alias("_ppk")).distinct(), on="_ppk", how="left_anti")
    stored = gone.select(F.col("_ppk").alias("pk"), F.col("_pobj").alias("obj"),
                         F.from_json(F.col("_pobj"), monitor.fields).alias("_o"))
    # monitor.text() refers to issue fields by name: expose the stored fields
    fixed = stored.select("pk", "obj", "_o.*").select(F.lit("fixed").alias("state"), "pk", "obj",
                                                      monitor.text().alias("text"))
    return live.unionByName(fixed)


def next_snapshot(monitor: Monitor, current: DataFrame, previous: DataFrame) -> DataFrame:
    """A10 input: stored rows still current keep their first stored object;
    new keys are added once each (the smallest object text of a repeated
    key). Current rows are reduced to one per key first (partial aggregate),
    so the join has unique keys on both sides."""
    keys = current.groupBy("pk").agg(F.min("obj").alias("_cobj"))
    j = keys.join(_stored(monitor, previous), on=F.col("pk") == F.col("_ppk"), how="left")
    return j.select(F.lit(monitor.type).alias("monitor"), "pk", F.coalesce("_pobj", "_cobj").alias("obj"))


def state_counts(states: DataFrame) -> DataFrame:
    """Number of issues per state, all three states present."""
    spark = states.sparkSession
    heads = spark.createDataFrame([(s, o) for s, o, _ in HEADINGS], "state string, ord int")
    counts = states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(heads).join(counts, on="state", how="left")
            .select("state", "ord", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def should_notify(counts: DataFrame, today) -> DataFrame:
    """H4: send when anything was raised or fixed, or anything exists on a Monday."""
    monday = is_monday(F.lit(today).cast("date"))
    c = counts.groupBy().agg(
        F.sum(F.when(F.col("state") == "raised", F.col("n")).otherwise(0)).alias("raised"),
        F.sum(F.when(F.col("state") == "existing", F.col("n")).otherwise(0)).alias("existing"),
        F.sum(F.when(F.col("state") == "fixed", F.col("n")).otherwise(0)).alias("fixed"))
    return c.withColumn("notify", (F.col("raised") > 0) | (F.col("fixed") > 0)
                        | ((F.col("existing") > 0) & monday))


def message_lines(monitor: Monitor, states: DataFrame) -> DataFrame:
    """H5: the message as ordered rows ``(section, kind, line)``.

    Section 0 is the title; sections 1-3 hold a heading (kind 0) -- or
    ``No <heading>.`` when empty -- then one line per issue (kind 1, ordered
    by text). Rendering orders by ``(section, kind, line)``; nothing is
    collected into one row.
    """
    spark = states.sparkSession
    counts = state_counts(states)
    names = spark.createDataFrame([(s, h) for s, _, h in HEADINGS], "state string, heading string")
    heads = (counts.join(F.broadcast(names), on="state")
             .select(F.col("ord").alias("section"), F.lit(0).alias("kind"),
                     F.when(F.col("n") > 0, F.concat(F.col("heading"), F.lit(":")))
                      .otherwise(F.concat(F.lit("No "), F.col("heading"), F.lit(".")))
                      .alias("line")))
    ords = spark.createDataFrame([(s, o) for s, o, _ in HEADINGS], "state string, section int")
    items = (states.join(F.broadcast(ords), on="state")
             .select("section", F.lit(1).alias("kind"), F.col("text").alias("line")))
    title = spark.createDataFrame([(0, 0, f"{monitor.label} issues found.")], "section int, kind int, line string")
    return title.unionByName(heads).unionByName(items)
