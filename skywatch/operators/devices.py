"""Device uptime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch import config
from skywatch.functions.scalars import js_date_text


def disconnected_devices(devices: DataFrame, group: str = config.UPTIME_GROUP) -> DataFrame:
    """Disconnected devices of the group, as issues (pk G9, text G10).

    A NULL group list never matches. The text keeps the reference's stray
    trailing quote and prints the time as a JavaScript date does in UTC.
    """
    groups = F.col("thingGroupNames")
    member = F.coalesce(F.array_contains(groups, F.lit(group)), F.lit(False))
    down = F.col("connectivity.connected") == F.lit(False)
    ts = F.col("connectivity.timestamp")
    since = F.coalesce(js_date_text(ts), F.lit("[unknown]"))
    text = F.concat(F.col("thingName"), F.lit(" ("), F.col("thingId"),
                    F.lit(") was disconnected since "), since, F.lit("'"))
    return (devices.where(down & member)
            .select("thingName", "thingId",
                    F.col("connectivity.connected").alias("connected"),
                    ts.alias("timestamp"), F.col("thingName").alias("pk"), text.alias("text")))


def latest_state(events: DataFrame, thing: str = "thing", ts: str = "ts",
                 tiebreak: str | None = None, connected: str = "connected") -> DataFrame:
    """Latest connectivity per device from connect / disconnect events.

    ``max_by`` is a partial aggregate: a device with a third of all events
    is reduced map-side before the shuffle. Ties on ``ts`` are broken by
    ``tiebreak`` when given.
    """
    order: Column = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return (events.groupBy(thing)
            .agg(F.max_by(F.col(connected), order).alias("connected"),
                 F.max(F.col(ts)).alias("last_ts"),
                 F.count(F.lit(1)).alias("n_events")))
